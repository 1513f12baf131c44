"""Quality rules as a ledger: measured once, judged by versioned policies, ablated by bits.

``ledger`` reads every text once, measures it, evaluates every rule and stores one row per
document: its measurements and a bit mask of the rules it fails.  ``judged`` applies a
policy to the stored masks, so a new policy reads no text.  ``ablations`` first counts the
documents of each mask (2 ** rules masks at most, whatever the input's size) and works out
from these counts what each rule does in each policy.

A null text counts as a text without words.  Null ids and repeated rows stay, row by row.  An
empty table gives an empty ledger.  Equal lines and equal windows of one text are told by
64-bit hashes.  Columns other than the two named ones are not looked at.  Memory follows a
segment of two megabytes, or the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import _SPACE, bounds, freeing, mix, segments, whole_windows, window_hashes, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_ROW = np.uint64(0xA0761D6478BD642F)


# name and the condition under which a document fails; the place in this list is the rule's bit,
# so rules are only ever added at the end.  All compare whole numbers.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is dropped if it fails any rule of ``hard``, or more than ``most`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    most: int = 0

    def masks(self) -> tuple[int, int]:
        return sum(BIT[x] for x in self.hard), sum(BIT[x] for x in self.soft)

    def drops(self, failed: Column, without: Column | None = None) -> Column:
        """Whether a mask is dropped; ``without`` is a mask of rules that are left out."""
        if without is not None:
            failed = failed.bitwiseAND(F.bitwise_not(without))
        hard, soft = self.masks()
        return (failed.bitwiseAND(F.lit(hard).cast("long")) != 0) | (F.bit_count(failed.bitwiseAND(F.lit(soft).cast("long"))) > self.most)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("1", ("few_words", "repeated_windows", "symbols", "repeated_lines"), ("short_words", "long_words", "capitals"), 0)
POLICIES = (BASE, STRICT)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated(h: np.ndarray, firsts: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each row in a window of ``size`` words that the row holds twice or more."""
    windows = window_hashes(h, size, 5)
    at, rows = whole_windows(firsts, size, len(windows))
    key = mix(windows[at] + (rows + 1).astype(np.uint64) * _ROW)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    covered = np.zeros(len(h), bool)
    for half in (order[1:][same], order[:-1][same]):
        for k in range(size):
            covered[at[half] + k] = True
    return _per_row(covered, firsts)


def _lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its lines that hold a word, and those of them equal to an earlier one."""
    feeds = np.flatnonzero(data == 10)
    # the empty line after a row's last line feed starts where the next row does; it has no word, as all lines without width
    starts, ends = np.sort(np.r_[offsets[:-1], feeds + 1]), np.sort(np.r_[feeds, offsets[1:]])
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, "right") - 1
    key = mix(word_hashes(data, starts, ends) + (row + 1).astype(np.uint64) * _ROW)
    _, first = np.unique(key, return_index=True)
    n = len(offsets) - 1
    lines = np.bincount(row, minlength=n)
    return lines, lines - np.bincount(row[first], minlength=n)


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of the rows of one segment."""
    starts, ends, firsts = bounds(data, offsets)
    lines, again = _lines(data, offsets, starts)
    return {
        "n_words": np.diff(firsts),
        "word_chars": _per_row(~_SPACE[data] & (data & 0xC0 != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_lines": lines,
        "n_dup_lines": again,
        "n_repeat_words": _repeated(word_hashes(data, starts, ends), firsts),
        "n_capitals": _per_row(_CAPITAL[data], offsets),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bits of the rules each document fails; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in segments(batch["text"]):
                found = measured(data, offsets)
                columns = [batch["doc_id"].slice(row, len(offsets) - 1), *(pa.array(found[x], pa.int64()) for x in MEASURES)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *MEASURES])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = plain.mapInArrow(freeing(run), "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES))
    bits = [F.when(F.expr(condition), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, condition in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return cut_lineage(rows.withColumn("failed", failed), "ledger")


def judged(entries: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Adds base_failed and kept: what ``policy`` does with each stored row; no text is read."""
    base = BASE.drops(F.col("failed"))
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & ~policy.drops(F.col("failed")))


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One row per policy and rule: version, rule, n_docs, n_failed, n_dropped, n_back, words_back.

    ``n_failed`` documents fail the rule, ``n_dropped`` are dropped by the policy, ``n_back`` of
    them (with ``words_back`` words) would stay if the rule were left out.  A rule that a policy
    does not use brings none back.  An empty ledger has no rows.
    """
    masks = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    out = None
    for policy in policies:
        rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items()]))
        each = masks.select("failed", "n", "words", rule.alias("r")).select("failed", "n", "words", "r.rule", "r.bit")
        dropped = policy.drops(F.col("failed"))
        back = dropped & ~policy.drops(F.col("failed"), F.col("bit"))
        some = lambda condition, amount: F.coalesce(F.sum(F.when(condition, F.col(amount))), F.lit(0).cast("long"))
        told = each.groupBy(F.lit(policy.version).alias("version"), "rule").agg(
            F.sum("n").alias("n_docs"),
            some(F.col("failed").bitwiseAND(F.col("bit")) != 0, "n").alias("n_failed"),
            some(dropped, "n").alias("n_dropped"),
            some(back, "n").alias("n_back"),
            some(back, "words").alias("words_back"),
        )
        out = told if out is None else out.unionByName(told)
    return out
