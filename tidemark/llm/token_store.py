"""Token ids as Parquet list columns that can be read by column, by range and by row group.

``encode`` turns texts into rows of ids in ascending id order, ``write`` stores them,
``read`` gives them back with their place in the whole stream.  A store has two tables:

``tokens``  one row per document, ordered by id over all files: doc_id, part, part_start
            (ids before it in its part), n_tokens, tokens.  Row groups, pages and the
            encoding of the id column (dictionary, or delta without one) are parameters;
            the Parquet writer adds page indexes, so a range of doc_id or a read of
            metadata alone touches few pages.
``parts``   one row per part: ids before it in the whole stream.

Null texts count as empty.  A null doc_id sorts first; repeated doc_ids are kept, ordered by
the hash of their text.  An empty table gives an empty store that can be read.  Columns other
than the two named ones are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, shared_folder
from .chunks import ChunkTable
from .spread import bytes_of, parts
from .words import freeing, segments

_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, tokens array<int>"
PART_BYTES = 24 << 20
CHUNKS = 700_000


class Encoder:
    """The ids of whole texts by the tokenizers library, asked once for each distinct chunk.

    Chunks are cut where the byte-level pre-tokenizer always starts a token: before a space
    after anything but white space, between a letter and an ASCII mark, and around a line
    feed between printable characters.  So a text's ids are its chunks' ids in order.
    Chunks are found, hashed (64 bits) and looked up for a whole batch at once; the library
    sees only those not seen before.  Texts in which a space has other white space beside it
    go to the library whole, and so do texts that hold an added token, which the library takes
    out before it cuts.  With ``plain`` an added token's string is text like any other.  The table
    of chunks is emptied when it holds ``limit``: some 50 bytes a chunk.
    """

    def __init__(self, model: str, limit: int = CHUNKS, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.alphabet = str.maketrans({b: chr(b if b in printable else next(spare)) for b in range(256)})
        self.table = ChunkTable(self.learn, limit)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def chunk(self, text: str) -> list[int] | None:
        """Ids of one chunk, or None if its ends are not sure to be token borders."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [x.id for x in self.tokenizer.model.tokenize(text.encode().decode("latin1").translate(self.alphabet))]
        if text != "\n" and (text[-1].isspace() or text[0].isspace() and (text[0] != " " or text[1:2].isspace())):
            return None
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.chunk(x) for x in texts]
        lengths = np.array([-1 if x is None else len(x) for x in found], np.int32)
        return np.array([i for x in found if x is not None for i in x], np.int32), lengths

    def holding(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows that hold an added token."""
        raw, rows = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                end = int(offsets[row + 1])
                if at + len(token) <= end:
                    rows.append(row)
                    at = end - 1
                at = raw.find(token, at + 1)
        return np.array(rows, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows of one segment, and how many each row has."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        starts = np.flatnonzero(_cuts(data, offsets))
        ids, lengths = self.table(data, starts, np.r_[starts[1:], len(data)])
        firsts = np.searchsorted(starts, offsets)
        unsure = np.union1d(np.searchsorted(firsts, np.flatnonzero(lengths < 0), "right") - 1, self.holding(data, offsets))
        counts = np.diff(np.r_[0, np.cumsum(np.maximum(lengths, 0))][firsts])
        if len(unsure):
            at = np.r_[0, np.cumsum(counts)]
            each = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            for r in unsure:
                each[r] = self.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode())
            ids, counts = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, counts


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_for(model: str, plain: bool = False) -> Encoder:
    """This worker process's encoder: workers serve many tasks, and the library does not give all memory back."""
    key = (model, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model, plain=plain)
    return _ENCODERS[key]


_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 ASCII letter or digit, 4 ASCII mark other than the apostrophe, 8 printable ASCII
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_KIND[33:127] = 12
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 10
_KIND[39] = 8


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a chunk starts at each byte."""
    kind = _KIND[data]
    before, twice = np.r_[np.uint8(1), kind[:-1]], np.r_[np.uint8(0), np.uint8(0), data[:-2]][: len(data)]
    last = np.r_[np.uint8(0), data[:-1]]
    after = np.r_[kind[1:], np.uint8(1)]
    letter = (before & 2 > 0) | (twice == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    feed = (data == 10) & (before & 8 > 0) & (after & 8 > 0)
    out = (data == 32) & (before != 1) | (kind & 4 > 0) & letter | feed
    out[1:] |= feed[:-1]
    out[offsets[:-1][offsets[:-1] < len(data)]] = True
    return out


def encode(docs: DataFrame, model: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document in ascending id order; ``end_id`` closes each document's ids.

    Rows are dealt by range of id (and text hash, should one id hold many rows), a part's
    rows in order.  The number of parts follows the bytes of text.
    """
    n = parts(docs, bytes_of(docs, text_col)[1], PART_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base, encoder = TaskContext.get().partitionId(), 0, encoder_for(model)
        close = 0 if end_id is None else 1
        for batch in batches:
            for row, data, offsets in segments(batch["text"]):
                ids, counts = encoder.encode(data, offsets)
                ends = np.cumsum(counts)
                if close:
                    ids = np.insert(ids, ends, end_id)
                    counts = counts + 1
                    ends = np.cumsum(counts)
                some = batch.slice(row, len(counts))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], pa.array(np.full(len(counts), part, np.int32)), pa.array(base + ends - counts), pa.array(counts, pa.int32()), lists],
                    ["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )
                base += int(ends[-1])

    return rows.mapInArrow(freeing(run), _SCHEMA)


def write(
    tokens: DataFrame,
    path: str,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    codec: str = "zstd",
) -> None:
    """Store encoded rows under ``path``.  ``encoding``: dictionary, or delta (binary-packed differences)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    (
        tokens.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .option("compression", codec)
        .parquet(f"{path}/tokens")
    )
    sums = tokens.sparkSession.read.schema(_SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per part: a running total over these needs no more than one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and the ids if ``tokens``."""
    rows = spark.read.schema(_SCHEMA).parquet(f"{path}/tokens")
    bases = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    out = rows.join(maybe_broadcast(bases), "part")
    return out.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *["tokens"] * tokens)


def with_crc32(rows: DataFrame) -> DataFrame:
    """Puts ids_crc32 in place of tokens: the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            offsets = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(), "<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    kept = [c for c in rows.columns if c != "tokens"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "tokens")
    return rows.mapInArrow(freeing(run), f"{schema}, ids_crc32 long")


def store(docs: DataFrame, model: str, **options) -> str:
    """Encode and write to a new place in the shared folder; returns that place."""
    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    write(encode(docs, model), path, **options)
    return path
