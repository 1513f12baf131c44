"""Language of whole texts: the family first, then one-versus-one linear classifiers within it.

A text is the square root of its counts of hashed byte trigrams (ASCII lower-cased, all but
letters blank), scaled to length one.  Linear support vector machines (squared hinge) are
trained between every two families and between every two languages of a family; the side with
most wins is chosen, larger margins first among equals.  The score is the logistic of the
winner's smallest margin, multiplied over both levels.

Training takes at most ``PER_LANGUAGE`` labelled texts of a language and ``SAMPLE`` in all, evenly
by language, those whose id hashes lowest, and never a row whose crc32 of the id as text leaves 0 by 5.  Prediction sees text alone.

Null texts and texts without a letter are ``und`` with score 0; so is everything if no row has
a language.  One known language only is predicted with score 1.  A null id is never held out
and never learned from.  Very long texts count whole.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .words import freeing, release, segments

DIMENSIONS = 4096
SAMPLE = 5000
PER_LANGUAGE = 500
# Which languages are close; a language that is not listed is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it la oc pt ro",
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa sd ur",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123, dtype=np.uint8)
_PLAIN[128:] = np.arange(128, 256, dtype=np.uint8)


@dataclass
class Model:
    """Family -> its languages, and the weights (with a bias last) between two names of a level."""

    families: dict[str, list[str]]
    weights: dict[tuple[str, str], np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a segment."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, DIMENSIONS), np.float32)
    lengths = np.diff(offsets) + 2
    at = np.cumsum(lengths) - lengths
    padded = np.full(int(lengths.sum()), 32, np.uint8)
    place = np.ones(len(padded), bool)
    place[at] = place[at + lengths - 1] = False
    padded[place] = _PLAIN[data]
    if len(padded) < 3:
        return counts
    wide = padded.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    blank = padded == 32
    row = np.repeat(np.arange(rows, dtype=np.int64), lengths)
    good = (row[:-2] == row[2:]) & ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    slot = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    flat = np.bincount(row[:-2][good] * DIMENSIONS + slot[good], minlength=rows * DIMENSIONS)
    counts = np.sqrt(flat.reshape(rows, DIMENSIONS).astype(np.float32))
    size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return counts / np.maximum(size, 1e-9)


def blocks(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, features, whether a text has a letter, ids of rows) for slices of a text column."""
    for start in range(0, len(column), rows):
        part = column.slice(start, rows)
        for row, data, offsets in segments(part):
            first = start + row
            ascii_letters = np.r_[0, np.cumsum((data | 32) - 97 < 26)]
            letters = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                letters[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
            yield first, vectors(data, offsets), letters, np.arange(first, first + len(letters))


def _separate(x: np.ndarray, sign: np.ndarray, loss: float = 20.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias (the last, whose column of ``x`` is one) of the squared-hinge linear machine.

    Classes are weighted evenly; accelerated gradient steps.
    """
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)) * loss
    pull = (2 * share * sign).astype(np.float32)
    sign = sign.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (1 + 4 * loss))
    for k in range(rounds):
        lack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - step * (ahead - (pull * lack) @ x)
        ahead, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample: per language the texts whose ids hash lowest."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.where(~held_out(F.col("id"))).withColumn("h", F.xxhash64("id"))
    each = min(PER_LANGUAGE, SAMPLE // max(1, known.select("lang").distinct().count()))
    lowest = Window.partitionBy("lang").orderBy("h")
    picked = known.select("lang", "h").withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= each)
    bounds = picked.groupBy("lang").agg(F.max("h").alias("top"))
    chosen = known.join(maybe_broadcast(bounds), "lang").where("h <= top").select("lang", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, letters, rows in blocks(batch["text"]):
                some = pa.array(rows[letters])
                raw = [v.tobytes() for v in x[letters].astype(np.float16)]
                yield pa.RecordBatch.from_arrays([batch["lang"].take(some), batch["id"].take(some), pa.array(raw, pa.binary())], ["lang", "id", "x"])

    rows = chosen.mapInArrow(freeing(run), "lang string, id long, x binary").orderBy("id", "lang").limit(SAMPLE).toArrow()
    lang = np.array(rows["lang"].to_pylist(), object)
    x = np.ones((len(lang), DIMENSIONS + 1), np.float32)
    at = 0
    for chunk in rows["x"].chunks:  # row by row, so that no second copy of the sample is held
        for v in chunk:
            x[at, :-1] = np.frombuffer(v.as_buffer(), np.float16)
            at += 1
    del rows
    family = np.array([_FAMILY.get(c.lower().split("-")[0].split("_")[0], c) for c in lang], object)
    families = {f: sorted(set(lang[family == f])) for f in sorted(set(family))}
    weights = {}
    for labels, groups in ((family, [sorted(families)]), (lang, families.values())):
        for group in groups:
            for a, b in combinations(group, 2):
                some = (labels == a) | (labels == b)
                weights[_key(labels is family, a, b)] = _separate(x[some], np.where(labels[some] == a, 1.0, -1.0))
    del x
    release()
    return Model(families, weights)


def _key(is_family: bool, a: str, b: str) -> tuple[str, str]:
    return (f"family {a}", b) if is_family else (a, b)


def _choose(x: np.ndarray, names: list[str], is_family: bool, weights: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning name for each row, and the logistic of its smallest margin."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    margin = np.zeros((len(names), len(names), len(x)))
    for i, j in combinations(range(len(names)), 2):
        w = weights[_key(is_family, names[i], names[j])]
        margin[i, j] = x @ w[:-1] + w[-1]
        margin[j, i] = -margin[i, j]
    wins = (margin > 0).sum(axis=1) + 0.5 * np.tanh(margin.sum(axis=1) / len(names))
    best = wins.argmax(axis=0)
    margin[np.arange(len(names)), np.arange(len(names))] = np.inf
    least = margin[best, :, np.arange(len(x))].min(axis=1)
    return best, 1 / (1 + np.exp(-4 * np.clip(least, -10, 10)))


def classify(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = sorted(model.families)
    out, score = np.full(len(x), "und", object), np.zeros(len(x))
    if not names:
        return out, score
    family, sure = _choose(x, names, True, model.weights)
    for k, name in enumerate(names):
        rows = np.flatnonzero(family == k)
        if len(rows):
            best, own = _choose(x[rows], model.families[name], False, model.weights)
            out[rows] = np.array(model.families[name], object)[best]
            score[rows] = sure[rows] * own
    return out, score


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score; columns already called so are replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for _, x, letters, rows in blocks(batch[text_col]):
                lang[rows[letters]], score[rows[letters]] = classify(model, x[letters])
            new = [pa.array(lang, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), *new], [*(f.name for f in kept), "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(freeing(run), f"{schema}, lang_pred string, score double")


def accepted(lang: Column, score: Column, least: float = 0.25) -> Column:
    """Whether a language was told: not ``und``, and not a coin's toss on both levels."""
    return (lang != "und") & (score >= least)
