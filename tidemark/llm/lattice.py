"""Near copies among vectors: hashing to cells of the E8 lattice, then exact cosine.

Vectors are scaled to length one and projected to eight random directions, once for each
table.  A projection falls into the cell of its nearest E8 lattice point and is also laid, as a
probe, into the ``PROBES`` neighbouring cells (among the 240 around) that it is nearest to.  Two
vectors meet if one's cell or a probe of it is the other's cell, in any table; at a cosine of
0.98 they miss each other in all tables once in some five million cases.

A cell is compared in blocks: matrix products of at most ``BLOCK`` rows a side, so no task holds
a whole cell however full it is, and only counts and a spanning forest leave a block pair, not
the pairs.  A pair that meets more than once is counted where it meets first.

Only equal labels and equal dimensions are compared.  Vectors null, empty, zero or with null
or non-finite components, and rows with a null label, link with nothing.  Rows of one id are
one vector (the smallest row); each still gets its row in the result.  A null id gets no links
and a null component.  Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected
from .vectors import distinct_vectors, matrix
from .words import freeing, mix

TABLES = 6
PROBES = 2
CELL = 0.6
BLOCK = 1024
COSINE = 0.98


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of its two cosets' nearest points."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _code(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name for lattice points of a table."""
    h = np.full(points.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        h = mix(h + (2 * points[..., k]).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int, probes: int, cell: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the own cells (rows, tables) and of the probed ones (rows, tables, probes)."""
    unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    dim = x.shape[1]
    rng = np.random.default_rng([seed, dim])
    home, probed = np.zeros((len(x), tables), np.int64), np.zeros((len(x), tables, probes), np.int64)
    for t in range(tables):
        directions = rng.normal(size=(max(dim, 8), 8))
        directions = np.linalg.qr(directions)[0][:dim] * np.sqrt(max(dim, 8) / 8)
        y = unit @ directions / cell
        point = nearest_point(y)
        home[:, t] = _code(point, t)
        if probes:
            toward = (y - point) @ ROOTS.T
            best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
            probed[:, t] = _code(point[:, None, :] + ROOTS[best], t)
    return home, probed


def laid_out(vectors: DataFrame, tables: int, probes: int, cell: float) -> DataFrame:
    """One row per vector and cell it lies in or probes, with all its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch["vector"]).to_numpy()
            for size in np.unique(sizes):
                for rows in np.array_split(np.flatnonzero(sizes == size), max(1, len(sizes) // 512)):
                    if not len(rows):
                        continue
                    some = batch.take(pa.array(rows))
                    x = matrix(some["vector"])
                    home, probed = cells(x, tables, probes, cell)
                    codes = np.concatenate([home[:, :, None], probed], axis=2).reshape(len(rows), -1)
                    raw = pa.array([v.tobytes() for v in codes], pa.binary())
                    for k in range(codes.shape[1]):
                        flags = [pa.array(np.full(len(rows), v)) for v in (k // (1 + probes), k % (1 + probes) == 0)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(codes[:, k]), flags[0].cast(pa.int32()), flags[1], some["label"], some["id"], some["vector"], raw],
                            ["cell", "level", "home", "label", "id", "vector", "codes"],
                        )

    return vectors.mapInArrow(freeing(run), "cell long, level int, home boolean, label string, id long, vector array<double>, codes binary")


def linked(rows: DataFrame, tables: int, probes: int, least: float) -> DataFrame:
    """(u, v, n): n new links of u (v null), or u and v in one component (n null)."""
    key = ["cell", "level", "label", "dim"]
    rows = rows.withColumn("dim", F.size("vector"))
    own = F.col("home").cast("int")
    size = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum(own).alias("homes"))
    size = size.where("rows > 1 and homes > 0").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    laid = rows.join(size.select(*key, "blocks"), key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    across = F.transform(every, lambda y: F.struct(F.col("block").alias("x"), y.alias("y"), F.lit(True).alias("row"), (F.col("home") & (y == F.col("block"))).alias("column")))
    down = F.transform(
        F.filter(every, lambda x: F.col("home") & (x != F.col("block"))),
        lambda x: F.struct(x.alias("x"), F.col("block").alias("y"), F.lit(False).alias("row"), F.lit(True).alias("column")),
    )
    laid = laid.withColumn("place", F.explode(F.concat(across, down))).select(*key, "place.*", "home", "id", "vector", "codes")

    def run(keys, frame):
        level = keys[1].as_py()
        ids, home, row, column = (frame[c].to_numpy() for c in ("id", "home", "row", "column"))
        x = matrix(frame["vector"])
        norm = np.linalg.norm(x, axis=1)
        codes = np.frombuffer(b"".join(frame["codes"].to_pylist()), np.int64).reshape(len(ids), tables, 1 + probes)
        r, c = np.flatnonzero(row), np.flatnonzero(column)
        near = x[r] @ x[c].T / norm[r][:, None] / norm[c][None, :] >= least
        near &= ids[r][:, None] != ids[c][None, :]
        near &= ~home[r][:, None] | (ids[r][:, None] < ids[c][None, :])
        i, j = np.nonzero(near)
        i, j = r[i], c[j]
        if not len(i):
            return _EMPTY
        new = np.concatenate([_first_meeting(codes, ids, home, i[s : s + 65536], j[s : s + 65536], level) for s in range(0, len(i), 65536)])
        count = np.bincount(np.r_[i[new], j[new]], minlength=len(ids))
        label, at = np.arange(len(ids)), None
        while at is None or (label != at).any():
            at = label.copy()
            np.minimum.at(label, i, at[j])
            np.minimum.at(label, j, at[i])
            label = label[label]
        tied, told = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(count)
        nothing = np.zeros(len(tied) + len(told), bool)
        nothing[len(tied) :] = True
        return pa.table(
            {
                "u": pa.array(np.r_[ids[tied], ids[told]]),
                "v": pa.array(np.r_[ids[label[tied]], ids[told]], mask=nothing),
                "n": pa.array(np.r_[np.zeros(len(tied), np.int64), count[told]], mask=~nothing),
            }
        )

    return laid.groupBy(*key, "x", "y").applyInArrow(run, "u long, v long, n long")


_EMPTY = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})


def _first_meeting(codes: np.ndarray, ids: np.ndarray, home: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
    """Whether pairs (row i, own cell of j) meet in no earlier table, nor earlier in this one.

    Within a table the order is: equal cells, the smaller id probes, the larger id probes.
    """
    a, b = codes[i], codes[j]
    early_a, early_b = a[:, :level], b[:, :level]
    met = (early_a[:, :, :1] == early_b).any(axis=(1, 2)) | (early_b[:, :, :1] == early_a).any(axis=(1, 2))
    larger_probes = ~home[i] & (ids[i] > ids[j])
    smaller_probed = (b[:, level, 1:] == a[:, level, :1]).any(axis=1)
    return ~met & ~(larger_probes & smaller_probed)


def near_copies(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    cell: float = CELL,
) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    ``cell`` is the scale of the lattice for vectors of length one: smaller cells hold fewer
    vectors, and need more tables or probes for the same recall.
    """
    known = df.where(F.col(label_col).isNotNull()).select(id_col, vector_col, F.col(label_col).cast("string").alias("label"))
    vectors = distinct_vectors(known, id_col, vector_col, "label").select("id", "label", "vector")
    found = cut_lineage(linked(laid_out(vectors, tables, probes, cell), tables, probes, cosine), "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n_links"))
    groups = connected(found.where("v is not null").select("u", "v"))
    out = df.select(F.col(id_col).cast("long").alias("id")).join(counts, F.col("id") == F.col("u"), "left").join(groups, F.col("id") == F.col("node"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
