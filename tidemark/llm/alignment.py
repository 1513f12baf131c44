"""Which tokens of one tokenizer cover which tokens of another, for every document.

``align`` encodes space + text by a byte-level BPE (side A) and text by a piece model that puts
the space there itself (side B).  Both sides' tokens then tile the same bytes.  For each batch,
``pandas.merge_asof`` keyed by document finds for every token's start the other side's token
that covers it; the two directions together are all overlaps, and offsets where both sides end
a token cut the tokens into groups.  ``pair_counts`` counts the documents that hold an id pair
linked, and ``scored`` sums these counts over each document's links.

A row is a document: repeated ids, and null ones, are counted row by row.  A text that is null
or empty, or whose tokens do not spell space + text byte by byte on both sides (as U+2581 in a
text, which side B spells as a space), has no tokens: zeros and ''.  Strings of special tokens
are plain text.  An empty table gives an empty table.  Columns other than the two named ones
are not looked at.  Memory follows a segment of a megabyte, or the longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast
from .chunks import ChunkTable, ragged
from .token_store import CHUNKS, Encoder, encoder_for
from .words import freeing, segments

SEGMENT = 1 << 20
_PROBE = "a  b \t\n é é ﬁ 　A  "


class PieceEncoder:
    """Ids of whole texts by the sentencepiece library, asked once for each distinct chunk.

    Where no piece has a space after anything but spaces, and the model's normaliser leaves
    text as it is, no merge crosses the border before a space that follows something else: a
    text's ids are those of its chunks.  Other models get every text whole.
    """

    def __init__(self, model: str, limit: int = CHUNKS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        free = not any("▁" in x.lstrip("▁") for x in names)
        self.cuts = free and self.library.normalize(_PROBE) == "▁" + _PROBE.replace(" ", "▁")
        self.entries = [
            bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)
        ]
        # a space at a text's end; by itself the library takes it for no text at all
        self.last = self.library.encode("a ")[len(self.library.encode("a")) :]
        self.table = ChunkTable(self.learn, limit)

    def learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [y if x != " " else self.last for x, y in zip(texts, self.library.encode([x[1:] for x in texts], num_threads=1), strict=True)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows that each begin with the space the model puts there, and how many each row has."""
        first = np.zeros(len(data), bool)
        if self.cuts:
            first[1:] = (data[1:] == 32) & (data[:-1] != 32)
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first)
        ids, lengths = self.table(data, starts, np.r_[starts[1:], len(data)])
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, offsets)])


class Spelling:
    """The bytes, and the decimal digits, of every id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(entries), np.uint8)
        self.n_digits = np.char.str_len(np.arange(self.size).astype("U"))
        wide = np.arange(self.size).astype(f"S{len(str(self.size)) + 1}")
        self.digits = np.frombuffer(wide.tobytes(), np.uint8).reshape(self.size, -1)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.starts[ids], self.lengths[ids])]


def _byte_entries(encoder: Encoder) -> list[bytes]:
    back = {chr(v) if isinstance(v, int) else v: k for k, v in encoder.alphabet.items()}
    names = {v: k for k, v in encoder.tokenizer.get_vocab(with_added_tokens=True).items()}
    return [bytes(back.get(c, 32) for c in names.get(i, "")) for i in range(max(names) + 1)]


_READY: dict[tuple[str, str], tuple] = {}


def _encoders(model_a: str, model_b: str) -> tuple[Encoder, Spelling, PieceEncoder, Spelling]:
    """This worker process's encoders, kept from task to task."""
    key = (model_a, model_b)
    if key not in _READY:
        a, b = encoder_for(model_a, plain=True), PieceEncoder(model_b)
        _READY[key] = a, Spelling(_byte_entries(a)), b, Spelling(b.entries)
    return _READY[key]


def covering(doc: np.ndarray, start: np.ndarray, other_doc: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """For each token of one side, the number of the other side's token that covers its start."""
    left = pd.DataFrame({"doc": doc, "at": start}, copy=False)
    right = pd.DataFrame({"doc": other_doc, "at": other_start, "token": np.arange(len(other_start))}, copy=False)
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy()


def _good_rows(data: np.ndarray, offsets: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, Spelling]]) -> np.ndarray:
    """Rows that hold more than the space before them and that both sides spell byte by byte."""
    lengths = np.diff(offsets)
    good = lengths > 1
    for ids, counts, spelling in sides:
        of = np.repeat(np.arange(len(counts)), counts)
        good &= np.bincount(of, spelling.lengths[ids], len(counts)) == lengths
    for ids, counts, spelling in sides:
        used = np.flatnonzero(good)
        there = data[ragged(offsets[used], lengths[used])]
        wrong = np.flatnonzero(spelling.spelt(ids[np.repeat(good, counts)]) != there)
        good[used[np.searchsorted(np.cumsum(lengths[used]), wrong, "right")]] = False
    return good


def _segment(data: np.ndarray, offsets: np.ndarray, encoders: tuple, digest: bool) -> list[pa.Array]:
    a, spell_a, b, spell_b = encoders
    (ids_a, count_a), (ids_b, count_b) = a.encode(data, offsets), b.encode(data, offsets)
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    good = _good_rows(data, offsets, [(ids_a, count_a, spell_a), (ids_b, count_b, spell_b)])
    ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
    count_a, count_b, rows = np.where(good, count_a, 0), np.where(good, count_b, 0), len(count_a)
    doc_a, doc_b = np.repeat(np.arange(rows), count_a), np.repeat(np.arange(rows), count_b)
    end_a, end_b = np.cumsum(spell_a.lengths[ids_a]), np.cumsum(spell_b.lengths[ids_b])
    start_a, start_b = end_a - spell_a.lengths[ids_a], end_b - spell_b.lengths[ids_b]

    # overlaps: where both tokens start together, the two directions give the same link
    over, under = covering(doc_a, start_a, doc_b, start_b), covering(doc_b, start_b, doc_a, start_a)
    later = np.flatnonzero(start_a[under] != start_b) if len(ids_b) else np.zeros(0, np.int64)
    linked_a, linked_b = np.r_[np.arange(len(ids_a)), under[later]], np.r_[over, later]
    n_links = count_a + np.bincount(doc_b[later], minlength=rows)

    # groups: offsets where both sides end a token
    ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
    ends[end_b] = True
    shared_a = ends[end_a]
    ends[:] = False
    ends[end_a] = True
    shared_b = ends[end_b]
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    n_groups = np.bincount(doc_a[shared_a], minlength=rows)

    # text of the groups: A's ids of a group, then B's
    groups = int(shared_a.sum())
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    wide = max(spell_a.digits.shape[1], spell_b.digits.shape[1])
    letters, used = np.zeros((len(ids_a) + len(ids_b), wide), np.uint8), np.zeros(len(ids_a) + len(ids_b), np.int64)
    for ids, place, spelling, shared, mark in ((ids_a, place_a, spell_a, shared_a, "|"), (ids_b, place_b, spell_b, shared_b, ";")):
        letters[place, : spelling.digits.shape[1]] = spelling.digits[ids]
        letters[place, spelling.n_digits[ids]] = np.where(shared, ord(mark), ord(","))
        used[place] = spelling.n_digits[ids] + 1
    text = letters[letters != 0]
    at = np.r_[0, np.cumsum(used)][np.r_[0, np.cumsum(count_a + count_b)]].tolist()
    each = [text[x : max(y - 1, x)].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
    told = [(hashlib.sha256(x).hexdigest() if x else "") if digest else x.decode() for x in each]

    # id pairs of each document and how often they are linked there
    pair = ids_a[linked_a] * spell_b.size + ids_b[linked_b]
    span = spell_a.size * spell_b.size
    keys, times = np.unique(doc_a[linked_a] * span + pair, return_counts=True)
    lists = pa.array(np.searchsorted(keys, np.arange(rows + 1) * span), pa.int32())
    numbers = [pa.array(x, pa.int64()) for x in (count_a, count_b, n_groups, n_links)]
    return [*numbers, pa.array(told, pa.string()), pa.ListArray.from_arrays(lists, pa.array(keys % span)), pa.ListArray.from_arrays(lists, pa.array(times, pa.int32()))]


def align(docs: DataFrame, model_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids, or with ``digest`` its sha256 as groups_sha256.
    ``pairs`` holds the linked id pairs as A's id times the size of B's vocabulary plus B's id, ``times``
    how often each is linked.  The result is stored, so its rows keep their numbers.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256" if digest else "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(model_a, model_b)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                texts = pc.binary_join_element_wise(pa.scalar(" "), some["text"], pa.scalar(""))
                for row, data, offsets in segments(texts, SEGMENT):
                    yield pa.RecordBatch.from_arrays([some["doc_id"].slice(row, len(offsets) - 1), *_segment(data, offsets, encoders, digest)], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {names[5]} string, pairs array<long>, times array<int>"
    return cut_lineage(plain.mapInArrow(freeing(run), schema).withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether none of its A id is in more.

    Counted before the shuffle, so a pair of every document costs one row a task.  An A id has
    at most ``size_b`` pairs.
    """
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / size_b))
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds n_best and count_sum over each document's links, in place of pairs and times.

    ``counts`` is broadcast when its measured size allows (``limit`` bytes); else both sides
    shuffle by pair, and a pair that many documents hold is split by the join.
    """
    counts = maybe_broadcast(counts, limit) if limit is not None else maybe_broadcast(counts)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    each = each.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times")).join(counts, "pair")
    sums = each.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    kept = [c for c in aligned.columns if c not in ("row", "pairs", "times")]
    return aligned.join(sums, "row", "left").select(*kept, *zero)


def aligned_counts(docs: DataFrame, model_a: str, model_b: str, digest: bool = False, limit: int | None = None) -> DataFrame:
    """``align``, then ``scored`` by counts over all the documents."""
    import sentencepiece

    rows = align(docs, model_a, model_b, digest=digest)
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_b).get_piece_size()
    return scored(rows, cut_lineage(pair_counts(rows, size_b), "pair-counts"), limit)
