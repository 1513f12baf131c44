"""Groups of spelling variants: rare words that differ by one letter from a far more frequent one.

Every word's edits by one letter are hashed and looked up in Bloom filters over the vocabulary;
only the edits that a filter lets through are written out as text, shuffled, and joined with the
vocabulary itself, which removes the false ones.  Half of the edits suffice: deletions, and
replacements by a greater letter; the pair's other word need not find it again.

The filters have blocks of 512 bits, some 16 bits a word, laid out by word length.  One pass
broadcasts at most ``PASS_BYTES`` of them, a part of the blocks; a larger vocabulary takes more
passes over the words, each looking up only the edits whose block is in its part.

``word_counts`` makes a vocabulary from texts; null and empty texts have no words, and each row
of the table is a document of its own.  ``near_words`` and ``variants`` take any table of
distinct words (column word) and counts (column n); an empty one gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spread import parts
from .words import _A, freeing, mix, powers

RUNS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
LONGEST_SHARD = 48  # longer words share the last length's filter
BLOCK_BITS, PROBES, WORD_BITS = 512, 6, 16
CHUNK = 1024  # blocks that are filled, stored and broadcast together
PASS_BYTES = 32 << 20
SLICE = 1 << 17  # letters handled at once
PART_LETTERS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, LEAST_LETTERS long and found LEAST_COUNT times at least.

    With ``drop_one_in``, a run loses one letter in the documents that the crc32 of
    ``<id>:<run>`` chooses: a made source of misspellings.  A null id counts as no text.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUNS), F.lit(0))).alias("word"))
    runs = runs.where(F.length("word") >= LEAST_LETTERS)
    lower = F.translate("word", string.ascii_uppercase, string.ascii_lowercase)
    word: Column = F.when(F.col("word").rlike("[A-Z]"), lower).otherwise(F.col("word"))
    runs = runs.select("id", word.alias("word"))
    if drop_one_in:
        told = runs.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary")))
        told = told.withColumn("k", F.pmod(F.col("h"), F.length("word")).cast("int"))
        cut = F.expr("concat(substr(word, 1, k), substr(word, k + 2))")
        runs = told.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


class Layout:
    """Where the filters of all word lengths lie in one row of blocks."""

    def __init__(self, counts: dict[int, int]):
        sizes = [-(-counts.get(k, 0) * WORD_BITS // BLOCK_BITS) for k in range(LONGEST_SHARD + 1)]
        self.blocks = np.array(sizes, np.uint64)
        self.firsts = np.cumsum(sizes) - np.array(sizes)
        self.total = int(sum(sizes))

    def place(self, key: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The block of each hashed word of the given length; -1 where no word has that length."""
        shard = np.clip(length, 0, LONGEST_SHARD)
        some = self.blocks[shard]
        return np.where(some > 0, self.firsts[shard] + (((key >> np.uint64(32)) * some) >> np.uint64(32)).astype(np.int64), -1)


def _bits(key: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th bit, within its block, of each key."""
    return ((mix(key ^ _A) >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


class Letters:
    """The code points of some words one after the other, and what their edits' hashes are made of."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(x) for x in words], np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(self.lengths)
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(self.points)) - (ends - self.lengths)[self.word]
        self.power = powers(_BASE, int(self.lengths.max(initial=0)) + 1)[self.at]
        upto = np.r_[np.uint64(0), np.cumsum(self.points.astype(np.uint64) * self.power)]
        self.sums = upto[ends] - upto[ends - self.lengths]
        self.before = upto[:-1] - upto[ends - self.lengths][self.word]
        self.through = upto[1:] - upto[ends - self.lengths][self.word]

    def keys(self) -> np.ndarray:
        return _key(self.sums, self.lengths)

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """Places whose letter can go (the first of equal neighbours), and the hashes of what is left."""
        again = (self.at > 0) & (self.points == np.r_[np.uint32(0), self.points[:-1]][: len(self.points)])
        i = np.flatnonzero(~again)
        left = self.before[i] + (self.sums[self.word[i]] - self.through[i]) * _BACK
        return i, _key(left, self.lengths[self.word[i]] - 1)

    def replaced(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of smaller letters, and the hashes of the words with ``letter`` there."""
        i = np.flatnonzero(self.points < letter)
        new = self.sums[self.word[i]] + (np.uint64(letter) - self.points[i].astype(np.uint64)) * self.power[i]
        return i, _key(new, self.lengths[self.word[i]])


def _key(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums + lengths.astype(np.uint64) * _A)


def _slices(words: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, words) of consecutive rows of some SLICE letters."""
    texts, low, held = words.to_pylist(), 0, 0
    for k, x in enumerate(texts):
        held += len(x)
        if held >= SLICE:
            yield low, texts[low : k + 1]
            low, held = k + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def filters(words: DataFrame, layout: Layout) -> DataFrame:
    """(chunk, bits): the filters' blocks, CHUNK of them a row; stored.  The words of a chunk meet in one task, some 32,000."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch["word"]):
                letters = Letters(texts)
                key = letters.keys()
                block = layout.place(key, letters.lengths)
                yield pa.RecordBatch.from_arrays([pa.array((block // CHUNK).astype(np.int32)), pa.array(block), pa.array(key.view(np.int64))], ["chunk", "block", "key"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(CHUNK * BLOCK_BITS, bool)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            chunk, block, key = (batch[c].to_numpy() for c in ("chunk", "block", "key"))
            for a in np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else ():
                b = a + np.searchsorted(chunk[a:], chunk[a], "right")
                if chunk[a] != now:
                    if now is not None:
                        yield row()
                    now, bits[:] = int(chunk[a]), False
                for k in range(PROBES):
                    bits[(block[a:b] - now * CHUNK) * BLOCK_BITS + _bits(key[a:b].view(np.uint64), k)] = True
        if now is not None:
            yield row()

    n = max(1, -(-layout.total // CHUNK))
    placed = words.select("word").mapInArrow(freeing(place), "chunk int, block long, key long")
    return cut_lineage(placed.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(freeing(fill), "chunk int, bits binary"), "word-filters")


def near_words(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words one letter apart.

    ``words`` is a stored table of distinct words (word, n).
    """
    spark = words.sparkSession
    sized = words.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("c")).collect()
    layout = Layout({r["k"]: r["n"] for r in sized})
    # letters of all words: as many as the alphabet has at most
    alphabet = sorted(ord(r["x"]) for r in words.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct().collect())
    n = parts(words, sum(r["c"] for r in sized), PART_LETTERS)
    dealt = words.select("word", F.col("n").cast("long").alias("n")).repartition(n, "word")
    chunks = filters(words, layout)
    step = max(1, pass_bytes * 8 // BLOCK_BITS // CHUNK)  # chunks of one pass
    found = None
    for first in range(0, max(1, -(-layout.total // CHUNK)), step):
        low, high = first * CHUNK, min(layout.total, (first + step) * CHUNK)
        bits = np.zeros(max(0, high - low) * BLOCK_BITS // 8, np.uint8)
        for row in chunks.where(F.col("chunk").between(first, first + step - 1)).toLocalIterator():  # pass_bytes at most
            at = (row["chunk"] - first) * CHUNK * BLOCK_BITS // 8
            part = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(bits) - at]
            bits[at : at + len(part)] = part
        some = dealt.mapInArrow(_looked_up(spark.sparkContext.broadcast(bits), layout, low, high, alphabet), "edit string, word string, n long")
        some = cut_lineage(some, "positive-edits")
        found = some if found is None else found.unionByName(some)
    real = found.join(words.select(F.col("word").alias("edit"), F.col("n").cast("long").alias("edit_n")), "edit")
    names = ("word", "n", "other", "other_n")
    both = [F.struct(*[F.col(c).alias(x) for c, x in zip(side, names, strict=True)]) for side in (("word", "n", "edit", "edit_n"), ("edit", "edit_n", "word", "n"))]
    return real.select(F.explode(F.array(*both)).alias("p")).select("p.*")


def _looked_up(shared, layout: Layout, low: int, high: int, alphabet: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def passed(key: np.ndarray, length: np.ndarray) -> np.ndarray:
            block = layout.place(key, length)
            left = np.flatnonzero((block >= low) & (block < high))
            for k in range(PROBES):
                at = (block[left] - low) * BLOCK_BITS + _bits(key[left], k)
                left = left[bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1]
            return left

        for batch in batches:
            for row, texts in _slices(batch["word"]):
                letters, edits, origin = Letters(texts), [], []
                for letter in (None, *alphabet):
                    i, key = letters.shorter() if letter is None else letters.replaced(letter)
                    i = i[passed(key, letters.lengths[letters.word[i]] - (letter is None))]
                    put = "" if letter is None else chr(letter)
                    for w, at in zip(letters.word[i].tolist(), letters.at[i].tolist(), strict=True):
                        edits.append(texts[w][:at] + put + texts[w][at + 1 :])
                        origin.append(w)
                of = pa.array([row + w for w in origin], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), batch["word"].take(of), batch["n"].take(of)], ["edit", "word", "n"])

    return freeing(run)


def variants(words: DataFrame, ratio: int = RATIO, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a stored table (word, n).

    A word's form is its near word of largest n (ties: first in code-point order), if that n is
    ``ratio`` times its own at least (2 or more).  The root is where the forms lead.
    """
    near = near_words(words, pass_bytes)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other")))
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.select("word", F.col("n").cast("long").alias("n")).join(near, "word", "left")
    enough = -F.col("best.minus") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
    )
    rows = cut_lineage(rows, "word-forms")
    # each step multiplies n, so chains are short, and every round doubles how far a word has followed its own
    to = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        to = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return rows.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
