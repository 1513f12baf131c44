"""Where greedy groups break, from sizes alone.  Texts stay in the JVM; only whole numbers come here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PLAN = "array<struct<first:int,rows:int,carried:boolean,trail:array<int>>>"


def fill_breaks(lengths, joint: int, limit: int, lead: int) -> list[int]:
    """First members of groups whose joined text, in characters, stays in ``limit``.

    Groups after the first start with a lead of that many characters (-1: none).  A negative
    length is a member that stands alone.
    """
    firsts, used = [], 0
    for at, n in enumerate(lengths):
        alone = n < 0 or at > 0 and lengths[at - 1] < 0
        if at == 0 or alone or used + joint + n > limit:
            used = abs(n) if at == 0 or lead < 0 else lead + joint + abs(n)
            firsts.append(at)
        else:
            used += joint + n
    return firsts


def group_firsts(lengths: Column, joints: Column, limits: Column, leads: Column) -> Column:
    """``fill_breaks`` for every list of an ``array<array<int>>``; the other columns are arrays beside it."""

    def run(many: pd.Series, joint: pd.Series, limit: pd.Series, lead: pd.Series) -> pd.Series:
        rows = zip(many, joint, limit, lead, strict=True)
        return pd.Series([[fill_breaks(a.tolist(), int(b), int(c), int(d)) for a, b, c, d in zip(*row, strict=True)] for row in rows])

    return F.pandas_udf(run, "array<array<int>>")(lengths, joints, limits, leads)


def plan_chunks(levels, sizes, tails, prose, target: int, most: int, least: int) -> list[dict]:
    """Runs of elements that become chunks.

    ``levels`` is 0 for text.  A heading closes a run that has ``least`` tokens; text closes one
    that has ``target`` or would pass ``most``.  Before prose the next run carries the tail (of
    ``tails`` tokens, 0 for none) of the element before it.  ``trail`` lists the headings in force.
    """
    runs, first, used, trail, start_trail, carried = [], 0, 0, [], [], False
    for at, (level, size) in enumerate(zip(levels, sizes, strict=True)):
        full = used >= least if level else used >= target or used + size > most
        if full and at > first:
            runs.append({"first": first, "rows": at - first, "carried": carried, "trail": start_trail})
            carried = bool(not level and prose[at] and tails[at - 1])
            first, used = at, int(tails[at - 1]) if carried else 0
        if level:
            while trail and levels[trail[-1]] >= level:
                trail = trail[:-1]
            trail = [*trail, at]
        if at == first and not carried:
            start_trail = trail
        used += size
    if len(sizes):
        runs.append({"first": first, "rows": len(sizes) - first, "carried": carried, "trail": start_trail})
    return runs


def chunk_plan(levels: Column, sizes: Column, tails: Column, prose: Column, target: int, most: int, least: int) -> Column:
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([plan_chunks(*(x.tolist() for x in row), target, most, least) for row in zip(a, b, c, d, strict=True)])

    return F.pandas_udf(run, PLAN)(levels, sizes, tails, prose)
