"""Repeated passages: words covered by a window that also starts in an earlier document go.

A window is ``size`` consecutive words of one document.  First pass: every partition counts, in
a count-min sketch, the anchors of its windows.  The anchor of a window is the run of ``ANCHOR``
words within it that hashes lowest; equal windows have equal anchors and windows next to each
other mostly share one, so a sketch holds some thirteen times fewer entries.  An anchor occurs
at least as often as any window that has it, so the merged sketch overestimates every window's
count and none that repeats is lost.  Second pass: only windows whose estimate is two or more
are grouped, exactly, by two independent hashes (96 bits) of their words; the group's smallest
document keeps them, the others lose them.

Windows that very many documents share (``hot`` by the sketch) are first settled in salted
shares; each share then sends its smallest document alone.  A document meets its removed
positions by its id.

Null texts have no words.  A null id counts as larger than all others.  Rows with the same id
(told apart by a hash of their text) take nothing from each other, and each loses what an
earlier id has.  Very long texts count whole, an empty table gives an empty result, other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import sketch
from .spread import bytes_of, clear_of
from .words import bounds, freeing, segments, whole_windows, window_hashes, word_hashes

SIZE = 50
ANCHOR = 24
HOT = 2000
SHARES = 32
_LAST = (1 << 63) - 1


def _windows(data: np.ndarray, offsets: np.ndarray, size: int):
    """Hashes of the words and, for each whole window: its first word, its row and its anchor's hash and place."""
    starts, ends, firsts = bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    run = min(ANCHOR, size)
    short = window_hashes(h, run, 1)
    at, rows = whole_windows(firsts, size, max(len(h) - size + 1, 0))
    if not len(at):
        return h, firsts, at, rows, np.zeros(0, np.uint64), at
    # place of the lowest short run among those of each window, by doubling spans
    span, low = 1, np.arange(len(short))
    need = size - run + 1
    while 2 * span <= need:
        a, b = low[:-span], low[span:]
        low = np.where(short[b] < short[a], b, a)
        span *= 2
    a, b = low[at], low[at + need - span]
    place = np.where(short[b] < short[a], b, a)
    return h, firsts, at, rows, short[place], place


def count_anchors(docs: DataFrame, width: int, size: int = SIZE) -> DataFrame:
    """Blocks of the partitions' sketches over the anchors of column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sketch.Counter(width)
        for batch in batches:
            for _, data, offsets in segments(batch["text"]):
                *_, anchors, place = _windows(data, offsets, size)
                counter.add(anchors[np.unique(place, return_index=True)[1]])  # an occurrence counts once
        yield from counter.batches()

    return docs.select("text").mapInArrow(freeing(run), sketch.CELLS)


def candidates(docs: DataFrame, width: int, repeated, hot, size: int = SIZE) -> DataFrame:
    """(w1, w2, share, doc_id, tag, at) of windows estimated to repeat; share is 0 but for hot ones.

    ``repeated`` and ``hot`` are broadcast bits of the merged sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, many = repeated.value, hot.value
        any_hot = bool(many.any())
        for batch in batches:
            for row, data, offsets in segments(batch["text"]):
                h, firsts, at, rows, anchors, _ = _windows(data, offsets, size)
                keep = np.flatnonzero(sketch.reaches(anchors, two, width))
                if not len(keep):
                    continue
                ids = batch["doc_id"].slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)
                tags = batch["tag"].slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)
                at, rows, anchors = at[keep], rows[keep], anchors[keep]
                w1 = window_hashes(h, size, 2)[at].view(np.int64)
                w2 = (window_hashes(h, size, 3)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc, tag = ids[rows], tags[rows]
                share = np.zeros(len(at), np.int32)
                if any_hot:
                    warm = sketch.reaches(anchors, many, width)
                    share[warm] = 1 + (doc[warm] % SHARES)
                for low in range(0, len(at), 1 << 18):
                    s = slice(low, low + (1 << 18))
                    columns = [w1[s], w2[s], share[s], doc[s], tag[s], (at[s] - firsts[rows[s]]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w1", "w2", "share", "doc_id", "tag", "at"])

    return docs.select("doc_id", "tag", "text").mapInArrow(freeing(run), "w1 long, w2 int, share int, doc_id long, tag int, at int")


def later(found: DataFrame) -> DataFrame:
    """(doc_id, tag, at) of the windows that a smaller document has too."""
    so_far = Window.partitionBy("w1", "w2", "share").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = found.withColumn("first", F.first("doc_id").over(so_far))
    goes = F.col("doc_id") > F.col("first")
    open_ = ~goes & (F.col("share") > 0)
    kept = first.where(goes | open_).select("doc_id", "tag", "at", *[F.when(open_, F.col(c)).alias(c) for c in ("w1", "w2")])
    kept = cut_lineage(kept, "later-windows")
    # the smallest documents of the shares of a hot window: SHARES of them at most
    among = Window.partitionBy("w1", "w2").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = kept.where("w1 is not null").withColumn("first", F.first("doc_id").over(among)).where("doc_id > first")
    return kept.where("w1 is null").select("doc_id", "tag", "at").unionByName(rest.select("doc_id", "tag", "at"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, digest: bool = False) -> DataFrame:
    """Adds n_words, n_removed and kept (the words left, joined by one space), or with ``digest`` kept_sha256.

    ``size`` is 2 words at least.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    tag = F.hash(text_col)
    plain = docs.select(key.alias("doc_id"), tag.alias("tag"), F.col(text_col).alias("text"))
    # some six bytes a word; one anchor in (size - anchor + 2) / 2 words
    amount = bytes_of(docs, text_col)[1] // 6 * 2 // max(size - min(ANCHOR, size) + 2, 2)
    width = sketch.width_for(amount)
    repeated, hot = sketch.busy(count_anchors(plain, width, size), width, (2, HOT))
    repeated, hot = spark.sparkContext.broadcast(repeated), spark.sparkContext.broadcast(hot)
    gone = later(candidates(plain, width, repeated, hot, size))
    key_, tag_, text_, gone_ = (clear_of(docs, x) for x in ("_key", "_tag", "_text", "_gone"))
    gone = gone.groupBy(F.col("doc_id").alias(key_), F.col("tag").alias(tag_)).agg(F.collect_set("at").alias(gone_))
    new = ["n_words", "n_removed", "kept_sha256" if digest else "kept"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    rows = docs.select("*", key.alias(key_), tag.alias(tag_), F.col(text_col).alias(text_)).join(gone, [key_, tag_], "left")
    rows = rows.select(*[f"`{f.name}`" for f in kept], text_, gone_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch, out = whole.slice(low, 512), []
                texts, places = batch[len(kept)], batch[len(kept) + 1]
                for i in range(batch.num_rows):
                    words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                    left, gone = words, 0
                    if places[i].is_valid:
                        at = places[i].values.to_numpy()
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, at, 1)
                        np.add.at(step, at + size, -1)
                        stays = np.cumsum(step)[:-1] == 0
                        left, gone = list(compress(words, stays)), len(words) - int(stays.sum())
                    text = b" ".join(left)
                    out.append((len(words), gone, hashlib.sha256(text).hexdigest() if digest else text.decode()))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*(f.name for f in kept), *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(freeing(run), f"{schema}, n_words long, n_removed long, {new[-1]} string")
