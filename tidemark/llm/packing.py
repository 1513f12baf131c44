"""Best-fit packing of documents into sequences under conflicts.

A sequence (bin) holds at most ``capacity`` units, at most one piece of a source and at most
one of a duplicate cluster.  A source with more pieces than full bins are needed in all is
first dealt, by id, into as many shares as its pieces go into those bins, and a share counts as
a source: so no source repeats in a bin more than its size asks for.  A document longer than
the capacity is cut into full pieces and a rest; its pieces count as copies of each other, so
they go to different bins.

Rows are dealt to groups by a hash of the document id; a group's pieces come longest first
(ties by id, then piece).  A group keeps its open bins ordered by what is left in them, with a
64-bit map of hashed sources and one of hashed clusters for each.  For a piece the search goes
from the first bin with enough room to the next larger ones until none of the piece's bits is
set, or until a set bit turns out to be another name's; so it ends at the tightest bin that may
take the piece.  A group has near ``rows`` rows whatever the table's size; a source or cluster
with a third of all rows is spread over the groups like any other.

A null or empty text has length 0 and still gets a place.  A null source or cluster conflicts
with nothing.  A null id is dealt by its text.  Repeated rows each get a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast
from .words import freeing

CAPACITY = 2048
GROUP_ROWS = 20_000
PACKED = "doc_id long, piece int, length int, bin_id long, place int, source string, cluster long"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What ``pack`` needs of documents: id, length in words, source, and the hash of the words as cluster."""
    words = F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    words = F.trim(words)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long").alias("length"),
        F.col(source_col).cast("string").alias("source"),
        F.when(words != "", F.xxhash64(F.lower(words))).alias("cluster"),
    )


class Bins:
    """The open bins of one group, ordered by room left and then by number."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room = np.zeros(1024, np.int64)  # sorted; parallel to the next three
        self.number = np.zeros(1024, np.int64)
        self.sources = np.zeros(1024, np.uint64)
        self.clusters = np.zeros(1024, np.uint64)
        self.open = 0
        self.names: list[tuple[set, set]] = []
        self.filled: list[int] = []
        self.seen: dict = {}

    def bits(self, source, cluster) -> tuple[np.uint64, np.uint64]:
        """The bit of a source (its own, while there are no more than 64) and of a cluster."""
        place = None if source is None else self.seen.setdefault(source, len(self.seen)) % 64
        return tuple(np.uint64(0 if x is None else 1 << x) for x in (place, None if cluster is None else hash(cluster) % 64))

    def tightest(self, length: int, source, cluster, bits: tuple[np.uint64, np.uint64]) -> int:
        """Index of the first bin with room that may take the piece, or -1; looks at growing blocks of successors."""
        at, block, sure = int(np.searchsorted(self.room[: self.open], length)), 64, len(self.seen) <= 64
        while at < self.open:
            end = min(self.open, at + block)
            hit = self.clusters[at:end] & bits[1]
            source_hit = self.sources[at:end] & bits[0]
            if sure:
                free = np.flatnonzero(source_hit == 0)
            else:
                hit, free = hit | source_hit, np.arange(end - at)
            clear = np.flatnonzero(hit[free] == 0)[:1]
            for i in free[: clear[0] if len(clear) else None]:  # a bit is shared: ask for the names
                own = self.names[self.number[at + i]]
                if source not in own[0] and cluster not in own[1]:
                    return at + int(i)
            if len(clear):
                return at + int(free[clear[0]])
            at, block = end, 4 * block
        return -1

    def add(self, length: int, source, cluster) -> tuple[int, int]:
        """(number of the bin, units before the piece)."""
        bits = self.bits(source, cluster)
        i = self.tightest(length, source, cluster, bits)
        if i < 0:
            number, room, own = len(self.names), self.capacity, bits
            self.names.append((set(), set()))
            self.filled.append(0)
        else:
            number, room = int(self.number[i]), int(self.room[i])
            own = (self.sources[i] | bits[0], self.clusters[i] | bits[1])
            for a in (self.room, self.number, self.sources, self.clusters):
                a[i : self.open - 1] = a[i + 1 : self.open]
            self.open -= 1
        for name, names in zip((source, cluster), self.names[number], strict=True):
            if name is not None:
                names.add(name)
        place = self.filled[number]
        self.filled[number] += length
        if room - length > 0:
            self._insert(room - length, number, own)
        else:
            self.names[number] = (set(), set())
        return number, place

    def _insert(self, room: int, number: int, own: tuple) -> None:
        if self.open == len(self.room):
            for name in ("room", "number", "sources", "clusters"):
                setattr(self, name, np.resize(getattr(self, name), 2 * self.open))
        low = int(np.searchsorted(self.room[: self.open], room))
        high = int(np.searchsorted(self.room[: self.open], room, "right"))
        i = low + int(np.searchsorted(self.number[low:high], number))
        for a, value in ((self.room, room), (self.number, number), (self.sources, own[0]), (self.clusters, own[1])):
            a[i + 1 : self.open + 1] = a[i : self.open]
            a[i] = value
        self.open += 1


def pack(items: DataFrame, capacity: int = CAPACITY, rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece of each item (doc_id, length, source, cluster): its bin, and its place in the bin."""
    items = cut_lineage(items, "sizes")  # read four times below
    all_of = items.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("units")).first()
    groups, needed = max(1, -(-all_of["n"] // rows)), max(1, -(-(all_of["units"] or 0) // capacity))
    hashed = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.struct("source", "cluster", "length")))
    dealt = items.withColumn("g", F.pmod(hashed, F.lit(groups)))
    pieces_of = F.greatest(F.lit(1), F.ceil(F.col("length") / capacity))
    large = items.groupBy("source").agg(F.sum(pieces_of).alias("n")).where((F.col("n") > needed) & F.col("source").isNotNull())
    large = large.select(F.col("source").alias("large_source"), F.ceil(F.col("n") / needed).cast("int").alias("shares"))
    dealt = dealt.join(maybe_broadcast(large), F.col("source") == F.col("large_source"), "left")
    share = F.pmod(F.xxhash64(hashed, F.lit("share")), F.col("shares"))
    dealt = dealt.withColumn("party", F.when(F.col("shares").isNull(), F.col("source")).otherwise(F.concat_ws("/", "source", share.cast("string"))))
    full = F.floor(F.col("length") / capacity).cast("int")
    rest = F.col("length") - full * capacity
    piece = F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full), F.when((rest > 0) | (full == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>"))))
    # the pieces of a cut document conflict even if its cluster is unknown
    own = F.when(F.col("length") > capacity, F.coalesce("cluster", F.xxhash64("doc_id", F.lit("own")))).otherwise(F.col("cluster"))
    pieces = dealt.select("g", "doc_id", "source", "party", own.alias("cluster"), piece.alias("piece", "size"))
    order = [F.col("size").desc(), "doc_id", "piece", "cluster", "source"]
    ready = pieces.repartition(groups, "g").sortWithinPartitions("g", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, Bins(capacity)
        for batch in batches:
            got, number, place = batch.to_pydict(), [], []
            for g, size, party, cluster in zip(got["g"], got["size"], got["party"], got["cluster"], strict=True):
                if g != group:
                    group, bins = g, Bins(capacity)
                n, p = bins.add(size, party, cluster)
                number.append(g << 32 | n)
                place.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["piece"], batch["size"].cast(pa.int32()), pa.array(number, pa.int64()), pa.array(place, pa.int32()), batch["source"], batch["cluster"]],
                [x.strip().split(" ")[0] for x in PACKED.split(",")],
            )

    return ready.mapInArrow(freeing(run), PACKED)
