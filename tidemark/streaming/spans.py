"""Stateful streams over spans of time, on ``transformWithState``.

Keys are dealt into slots by a hash, and time is cut into spans of many times the window that a row looks
back.  A row goes to its own span and, if the next one looks back at it, to that too; so all that a row's
answer needs is in one slot's span.  A state is a slot's span with the rows of all its keys, as most keys
have few rows and each state costs calls of its own; a busy key is still many states.  Its rows are list state.  Whenever rows come, in whatever order
and trigger, the answers of the span's own rows are worked out again and those that are new or changed
are emitted (output mode update).  So the last answer of each row is that of the batch form, whatever
the triggers were.  Rows behind the watermark are dropped, and so are kept rows that
none after it can look back at, when a state's next rows come; a timer at the end of the span, which only
fires once the watermark has passed it, drops the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, IntegralType, StructType

SPAN = 720  # windows a span is long
SLOTS = 32  # states a span's keys are dealt into
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class SpanProcessor(StatefulProcessor):
    """Keeps the rows of a slot's span and emits the answers that new rows make or change.

    A subclass gives ``answers``: for a frame of all rows of the state, one value per row from the rows of its
    key, which is ``nothing`` where there is none to tell; and ``told``, which makes output rows of some of them.
    """

    nothing: object = None

    def __init__(self, kept: StructType, micros: int):
        self.kept, self.micros = kept, micros

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.kept)

    def answers(self, rows: pd.DataFrame) -> list:
        raise NotImplementedError

    def told(self, rows: pd.DataFrame, values: list) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.kept.fieldNames()
        old = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=names)
        new = pd.concat(list(rows), ignore_index=True)[names]
        for field in self.kept.fields:  # arrays come as numpy's, which state does not take
            if isinstance(field.dataType, ArrayType):
                new[field.name] = [None if v is None else list(v) for v in new[field.name]]
            elif isinstance(field.dataType, IntegralType) and new[field.name].isna().any():  # floats, if some are null
                new[field.name] = pd.Series([None if pd.isna(v) else int(v) for v in new[field.name]], dtype=object)
        if old.empty:
            self.handle.registerTimer((int(key[-1]) + 1) * SPAN * self.micros // 1000)
        # rows that come later lie at the watermark or after it, and look back no further than a window
        since = timerValues.getCurrentWatermarkInMs() * 1000 - self.micros
        past = len(old) and (old["at"] < since).any()
        later = pd.concat([old[old["at"] >= since], new[new["at"] >= since]], ignore_index=True) if past else new
        if past and later.empty:
            self.rows.clear()
        elif past:
            self.rows.put([tuple(r) for r in later.itertuples(index=False)])
        else:
            self.rows.appendList([tuple(r) for r in later.itertuples(index=False)])
        every = pd.concat([old, new], ignore_index=True) if len(old) else new
        before = [*self.answers(old), *[self.nothing] * len(new)] if len(old) else [self.nothing] * len(new)
        after = self.answers(every)
        changed = [i for i, own in enumerate(every["own"]) if own and after[i] != before[i]]
        if changed:
            yield self.told(every.iloc[changed], [after[i] for i in changed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter([])

    def close(self) -> None:
        pass


class Rates(SpanProcessor):
    """How many of the key's requests lie in the window that ends with each."""

    nothing = 0

    def answers(self, rows):
        at = rows["at"].to_numpy(np.int64)
        if not len(at):
            return []
        # a key's times lie on a stretch of their own, further from the next than a row looks back
        places = at - at.min() + _codes(rows, ["key"]) * (at.max() - at.min() + self.micros + 1)
        order = np.sort(places)
        return (np.searchsorted(order, places, "right") - np.searchsorted(order, places - self.micros, "left")).tolist()

    def told(self, rows, values):
        return pd.DataFrame({"key": rows["key"].to_numpy(), "request_id": rows["id"].to_numpy(), "n_recent": values})


class Rephrases(SpanProcessor):
    """The question before each, where that is soon before, in other words and alike."""

    def __init__(self, kept: StructType, micros: int, threshold: float):
        super().__init__(kept, micros)
        self.threshold = threshold

    def answers(self, rows):
        out: list = [None] * len(rows)
        last = None
        order = rows.assign(who=_codes(rows, ["kb_id", "session_id"])).sort_values(["who", "at", "id"], kind="stable")
        for r in order.itertuples():
            terms = set(r.terms or ())  # none for a question that is null
            if last is not None and r.who == last.who and r.at - last.at <= self.micros and r.said != last.said:
                before = set(last.terms or ())
                alike = len(terms & before) / len(terms | before) if terms and before else 0.0
                if alike >= self.threshold:
                    out[r.Index] = (last.id, alike)
            last = r
        return out

    def told(self, rows, values):
        ids, alike = zip(*[v or (None, None) for v in values], strict=True)
        return pd.DataFrame(
            {
                "kb_id": rows["kb_id"].to_numpy(),
                "session_id": rows["session_id"].to_numpy(),
                "trace_id": rows["id"].to_numpy(),
                "rephrase_of": pd.array(ids, dtype=object),
                "similarity": pd.array(alike, dtype="Float64"),
            }
        )


def _codes(rows: pd.DataFrame, key: list[str]) -> np.ndarray:
    """A number for each row's key; nulls are a key like others."""
    return rows.groupby(key, sort=False, dropna=False).ngroup().to_numpy(np.int64)


def in_spans(rows: DataFrame, seconds: int, key: list[str]) -> DataFrame:
    """Each row in its own span and, within ``seconds`` of its end, also in the next, there not ``own``.

    Adds at (microseconds), slot, span, own.  Rows without a time go.
    """
    window, length = seconds * 1_000_000, SPAN * seconds * 1_000_000
    at = F.unix_micros("created_at")
    span = F.floor(at / F.lit(length)).cast("long")
    mine = F.struct(span.alias("span"), F.lit(True).alias("own"))
    after = F.struct((span + 1).alias("span"), F.lit(False).alias("own"))
    both = F.when(F.pmod(at, F.lit(length)) >= length - window, F.array(mine, after)).otherwise(F.array(mine))
    # rows with a null in their key are a slot of their own, so that no column of the others turns into floats
    whole = reduce(and_, [F.col(c).isNotNull() for c in key])
    slot = F.when(whole, F.pmod(F.xxhash64(*key), F.lit(SLOTS))).otherwise(F.lit(-1))
    return rows.where("created_at is not null").withColumns({"at": at, "slot": slot.cast("long")}).select("*", F.inline(both))
