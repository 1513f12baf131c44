"""Groups of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Texts are lower-cased (A-Z), cut into words, and a document's set is its distinct runs of
``N`` words, as 64-bit hashes (the whole text, if it has fewer words).  Documents with equal
sets form a class; its smallest document stands for it, so copies cost one row each.

1. Signatures: a class has ``BANDS`` keys, each from ``BAND`` of its permuted minima.  Two
   classes at 0.8 miss each other in all keys with a probability under 1e-9.
2. Stars: of the classes that share a key, each is paired with the smallest one; the smallest
   of its partners of fitting size is verified exactly, and links form first components.
3. Tiles: where a key still holds several components, its classes are laid out in bands of
   size (two sets can link only if neither is a quarter larger), in blocks of ``BLOCK`` rows.
   In a tile, bit counts of 1,024-bit signatures bound every overlap from above; pairs of
   different components that pass are verified.  So a group of near copies, however large,
   costs about one pair for each member, and no link between components is left out.

Verifying computes the sets of the documents in question again from their texts, sends each to
its partner, and intersects sorted arrays.  Partners with very many are split by salt.

Null or wordless texts have an empty set and link with nothing.  Null ids stand as the largest
id; repeated ids take the smallest row's class.  Very long texts count whole, empty tables give
empty results, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast
from .components import connected
from .words import bounds, freeing, mix, segments, window_hashes, word_hashes

N = 5
SHARE = 80  # percent
BANDS, BAND = 56, 5
BITS = 1024
BLOCK = 512
SALT_ROWS = 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST = (1 << 63) - 1
_FACTORS = mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """For each text of a column its distinct shingles' hashes, sorted."""
    for _, data, offsets in segments(column):
        data = _LOWER[data]
        starts, ends, firsts = bounds(data, offsets)
        h = word_hashes(data, starts, ends)
        runs = window_hashes(h, n, 4)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield mix(window_hashes(h[a:b], b - a, 5) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def keys_of(s: np.ndarray) -> np.ndarray:
    """The signature keys of a set that is not empty."""
    low = np.full(BANDS * BAND, ~np.uint64(0))
    for start in range(0, len(s), 2048):
        part = s[start : start + 2048]
        np.minimum(low, ((part[None, :] ^ (part[None, :] >> np.uint64(31))) * _FACTORS[:, None]).min(axis=1), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        out = mix(out + low[k::BAND])
    return out.view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Which of ``BITS`` values the hashes of a set have."""
    bits = np.zeros(BITS, bool)
    bits[(mix(s) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fits(a, b, share: int = SHARE):
    """Whether two set sizes allow the similarity; works on columns and arrays."""
    return (100 * a >= share * b) & (100 * b >= share * a)


def _signatures(plain: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                size, first, second, keys, bits = [], [], [], [], []
                for s in shingle_sets(some["text"], n):
                    size.append(len(s))
                    first.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    second.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    keys.append(keys_of(s) if len(s) else None)
                    bits.append(bitmap(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], pa.array(size, pa.int64()), pa.array(first), pa.array(second), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["doc_id", "n", "s1", "s2", "keys", "bits"],
                )

    return plain.mapInArrow(freeing(run), "doc_id long, n long, s1 long, s2 long, keys array<long>, bits binary")


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """Adds the sorted set of each row's text, as bytes, in place of the text (the last column)."""
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                sets = pa.array([s.tobytes() for s in shingle_sets(some["text"], n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], sets], [*(f.name for f in kept), "set"])

    return rows.mapInArrow(freeing(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", set binary")


def verify(plain: DataFrame, pairs: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """Of distinct pairs (u, v) of document ids, those whose sets have the similarity.

    The set of u travels to v.  A v with many partners is salted; its own set goes to each salt.
    """
    count = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    pairs = cut_lineage(pairs.join(count, "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int")), "pairs")
    guests = pairs.groupBy(F.col("u").alias("doc_id")).agg(F.collect_list(F.struct("v", "salt")).alias("to"))
    hosts = pairs.select(F.col("v").alias("doc_id"), F.array(F.struct("v", "salt")).alias("to")).distinct()
    hosts = hosts.withColumn("host", F.lit(True))
    routed = plain.join(maybe_broadcast(guests.withColumn("host", F.lit(False)).unionByName(hosts)), "doc_id")
    sets = _sets(routed.select("doc_id", "host", "to", "text"), n)
    rows = sets.select("doc_id", "host", F.explode("to").alias("to"), "set").select("to.v", "to.salt", "host", "doc_id", "set")
    rows = rows.repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("host").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            sets = batch["set"]
            for i, (to, host, doc) in enumerate(zip(*(batch[c].to_pylist() for c in ("v", "host", "doc_id")), strict=True)):
                s = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if host:
                    now, own = to, s.copy()
                    continue
                if to != now:
                    raise ValueError(f"the set of {to} is missing")
                both = _common(own, s)
                if 100 * both >= share * (len(own) + len(s) - both):
                    u.append(doc)
                    v.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(freeing(run), "u long, v long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _tiles(members: DataFrame, share: int) -> DataFrame:
    """Pairs (u, v) of ``members`` (key, id, n, comp, bits) that share a key, differ in component and pass the bound."""
    step = float(np.log(100 / share))
    band = F.floor(F.log(F.col("n")) / step).cast("int")
    # a row lies in its own band and, as one of the smaller, in the next
    laid = members.withColumn("place", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))))
    laid = laid.select("key", "place.band", "place.own", "id", "n", "comp", "bits")
    size = laid.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.max("own").alias("any"), F.count_distinct("comp").alias("comps"))
    laid = laid.join(size.where("any and comps > 1"), ["key", "band"])
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    laid = laid.withColumn("block", block).withColumn("other", F.explode(others))
    laid = laid.select("key", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "own", "id", "n", "comp", "bits")

    def run(keys, frame):
        x, y = keys[2].as_py(), keys[3].as_py()
        ids, n, comp, own, block = (frame[c].to_numpy() for c in ("id", "n", "comp", "own", "block"))
        bits = np.frombuffer(b"".join(frame["bits"].to_pylist()), np.uint64).reshape(len(ids), BITS // 64)
        u, v = [], []
        for i in range(len(ids)):
            if block[i] != x:
                continue
            fit = fits(n, n[i], share) & (comp != comp[i]) & (own | own[i]) & (block == y)
            if x == y:
                fit &= ids > ids[i]
            j = np.flatnonzero(fit)
            if not len(j):
                continue
            more_i = np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1)
            more_j = np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1)
            most = np.minimum(n[i] - more_i, n[j] - more_j)
            j = j[100 * most >= share * (n[i] + n[j] - most)]
            u += np.maximum(ids[j], ids[i]).tolist()
            v += np.minimum(ids[j], ids[i]).tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return laid.groupBy("key", "band", "x", "y").applyInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = cut_lineage(_signatures(plain, n), "signatures")
    same = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    # rows of a repeated id belong together, so the smallest row of an id speaks for it
    classes = cut_lineage(rows.where("n > 0").join(same, ["n", "s1", "s2"]).select("doc_id", "id", "n"), "classes")
    leaders = rows.join(classes.where("doc_id = id").select("doc_id").distinct(), "doc_id", "left_semi")
    leaders = leaders.where("n > 0").select(F.col("doc_id").alias("id"), "n", "keys", "bits").dropDuplicates(["id"])
    keyed = leaders.select("id", "n", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high")).where("low.id < high")
    shared = cut_lineage(keyed.join(first.select("key", "low"), "key").select("key", "id", "n", F.col("low.id").alias("low"), F.col("low.n").alias("low_n")), "shared-keys")

    stars = shared.where((F.col("id") != F.col("low")) & fits(F.col("n"), F.col("low_n"), share)).groupBy(F.col("id").alias("u")).agg(F.min("low").alias("v"))
    links = cut_lineage(verify(plain, stars, n, share), "star-links")
    repeats = classes.where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct()
    found = connected(links)

    named = found.withColumnRenamed("node", "id").withColumnRenamed("component", "named")
    members = shared.select("key", "id", "n").join(maybe_broadcast(named), "id", "left").withColumn("comp", F.coalesce("named", "id"))
    open_keys = members.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    members = members.join(open_keys, "key", "left_semi").join(leaders.select("id", "bits"), "id").select("key", "id", "n", "comp", "bits")
    more = verify(plain, cut_lineage(_tiles(members, share), "tile-pairs"), n, share)

    components = connected(links.unionByName(more).unionByName(repeats))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(components, rows.doc_id == components.node, "left")
    key = F.coalesce("component", "doc_id")
    return out.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_shingles", F.nullif(key, F.lit(_LAST)).alias("component_id"))
