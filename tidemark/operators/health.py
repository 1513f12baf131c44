"""Health metrics and usage analytics over the trace log."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .ordered import running_total_by_bucket

STRETCHES = 1000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def recent(traces: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Live traces of the trailing window."""
    since = as_of - F.expr(f"interval {int(days)} days")
    return traces.where(~F.col("is_eval") & (F.col("created_at") >= since))


def answered() -> Column:
    return (F.col("route") != "direct") & (F.col("status") != "escalated")


def failing() -> Column:
    return F.col("status").isin("failed", "partial")


def status_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy("kb_id", "status").agg(F.count(F.lit(1)).alias("n"))


def rates(traces: DataFrame) -> DataFrame:
    """Shares of answered traces; the negative share is over all of them.

    ``verified_rate`` divides all verified traces by the answered ones.
    """
    a = answered()
    n = F.count_if(a)
    healed = F.count_if(a & F.col("healed"))
    return traces.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("queries"),
        ratio(F.count_if(F.col("status") == "verified"), n).alias("verified_rate"),
        ratio(F.count_if(a & (F.col("status") == "failed")), n).alias("abstention_rate"),
        ratio(healed, n).alias("heal_rate"),
        ratio(F.count_if(a & F.col("healed") & (F.col("status") == "verified")), healed).alias("heal_success_rate"),
        ratio(F.count_if("negative_signal"), F.count(F.lit(1))).alias("negative_signal_rate"),
    )


def means(traces: DataFrame) -> DataFrame:
    a = answered()
    return traces.groupBy("kb_id").agg(
        F.avg(F.when(a, F.col("groundedness"))).alias("groundedness"),
        F.avg(F.when(a, F.col("contradiction"))).alias("contradiction_rate"),
        F.avg(F.when(a, F.col("coverage"))).alias("coverage"),
        F.avg("llm_calls").alias("avg_llm_calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by position ``round_half_even(p * (n - 1))`` of the sorted values.

    Rows are first counted per distinct value.  A group's values are then cut into ``STRETCHES``
    equal stretches between its least and largest one: running counts are taken within a
    stretch, and one row per stretch carries them on, so no task sorts a whole group.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    share = (F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0))
    stretch = F.coalesce(F.floor(share * STRETCHES), F.lit(0))
    placed = running_total_by_bucket(counts.join(known, keys), keys, [value], stretch, "_n", "_upto")
    picks = [
        F.min(F.when(F.col("_upto") > F.bround(F.lit(p) * (F.col("_total") - 1)), F.col(value))).alias(name)
        for name, p in shares.items()
    ]
    return placed.groupBy(*keys).agg(*picks)


def repeat_failures(traces: DataFrame) -> DataFrame:
    """Share of failures whose question cluster had failed before.

    In each cluster every failure but the first is a repeat, so two counts suffice and
    no ordering is needed.
    """
    bad = traces.where(answered() & failing())
    per = bad.groupBy("kb_id", "query_cluster_id").agg(F.count(F.lit(1)).alias("n"))
    again = F.sum(F.when(F.col("query_cluster_id").isNotNull(), F.col("n") - 1).otherwise(0))
    return per.groupBy("kb_id").agg(
        F.sum("n").alias("failures"), again.alias("repeats"), ratio(again, F.sum("n")).alias("repeat_failure_rate")
    )


def daily_series(traces: DataFrame) -> DataFrame:
    return (
        traces.where(answered())
        .groupBy("kb_id", F.to_date("created_at").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.count_if(F.col("status") == "verified") / F.count(F.lit(1))).alias("verified_rate"),
            F.avg("groundedness").alias("groundedness"),
        )
    )


def time_to_heal(fixes: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Mean whole seconds from a diagnosis to its applied fix."""
    done = fixes.where((F.col("status") == "applied") & F.col("applied_at").isNotNull())
    created = diagnoses.select("diagnosis_id", F.col("created_at").alias("found_at"))
    seconds = F.col("applied_at").cast("double") - F.col("found_at").cast("double")
    return (
        done.join(created, "diagnosis_id")
        .groupBy("kb_id")
        .agg(F.floor(F.avg(seconds)).alias("mean_seconds"), F.count(F.lit(1)).alias("fixes"))
    )


def corpus_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per base and document status, plus active chunk and token totals."""
    by_status = docs.groupBy("kb_id", "status").agg(F.count(F.lit(1)).alias("documents"))
    live = (
        chunks.where(F.col("status") == "active")
        .groupBy("kb_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    )
    return by_status.join(live, "kb_id", "left").fillna(0, ["chunks", "tokens"])


def repair_backlog(diagnoses: DataFrame, fixes: DataFrame, golden: DataFrame) -> DataFrame:
    d = diagnoses.groupBy("kb_id").agg(
        F.count_if(F.col("status").isin("open", "fixing")).alias("open_diagnoses"),
        F.count_if(F.col("status") == "needs_human").alias("needs_human"),
    )
    f = fixes.groupBy("kb_id").agg(
        F.count_if(F.col("status") == "pending_approval").alias("pending_approval"),
        F.count_if((F.col("status") == "applied") & F.col("applied_at").isNotNull()).alias("applied_fixes"),
    )
    g = golden.groupBy("kb_id").agg(F.count_if("active").alias("golden_items"))
    return d.join(f, "kb_id", "full").join(g, "kb_id", "full").fillna(0)


def usage_daily(traces: DataFrame) -> DataFrame:
    """Questions, research runs and tokens per user and day; errors are not charged."""
    return (
        traces.where((F.col("status") != "error") & F.col("user_id").isNotNull())
        .groupBy("user_id", F.to_date("created_at").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.count_if(F.col("route") == "deep").alias("deep"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
        )
    )


def site_usage(usage: DataFrame, first_day: Column) -> DataFrame:
    return (
        usage.where(F.col("day") >= first_day)
        .groupBy("day")
        .agg(
            F.sum("questions").alias("questions"),
            F.sum("deep").alias("deep"),
            F.count("user_id").alias("active_users"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
        )
    )


def top_users(usage: DataFrame, users: DataFrame, day: Column, n: int = 10) -> DataFrame:
    return (
        usage.where(F.col("day") == day)
        .join(users.select("user_id", "email"), "user_id")
        .orderBy(F.col("questions").desc(), "email")
        .limit(n)
        .select("email", "questions")
    )


def effective_limits(users: DataFrame, plans: DataFrame, default_plan: str = "free") -> DataFrame:
    """Limits per user: own override, then the plan, then the default plan.

    ``plans``: plan, daily_questions, per_minute, deep_per_day.  0 means unlimited.
    """
    limits = ["daily_questions", "per_minute", "deep_per_day"]
    default = plans.where(F.col("plan") == default_plan).select(*limits).first()  # one row by its key
    out = users.join(plans.select("plan", *limits), "plan", "left")
    for c in limits:
        out = out.withColumn(c, F.coalesce(c, F.lit(default[c] if default else None)))
    return out.withColumn("daily_questions", F.coalesce("daily_limit_override", "daily_questions"))


def usage_summary(limits: DataFrame, usage_today: DataFrame) -> DataFrame:
    used = usage_today.select("user_id", F.col("questions").alias("used"), F.col("deep").alias("deep_used"))
    free = (F.col("role") == "admin") | (F.col("daily_questions") == 0)
    q = F.coalesce("used", F.lit(0))
    return limits.join(used, "user_id", "left").select(
        "user_id",
        "plan",
        q.alias("questions_today"),
        F.when(~free, F.col("daily_questions")).alias("daily_limit"),
        F.when(~free, F.greatest(F.lit(0), F.col("daily_questions") - q)).alias("remaining"),
        F.coalesce("deep_used", F.lit(0)).alias("deep_today"),
        F.when(F.col("role") != "admin", F.col("deep_per_day")).alias("deep_limit"),
        F.when(F.col("role") != "admin", F.col("per_minute")).alias("minute_limit"),
    )


def workspace_usage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    files = docs.groupBy("kb_id").agg(F.count_if(F.col("status") != "superseded").alias("files"))
    tokens = (
        chunks.where(F.col("status") == "active").groupBy("kb_id").agg(F.sum("token_count").alias("tokens"))
    )
    used = files.join(tokens, "kb_id", "left").fillna(0, ["tokens"])
    return used.withColumn("pages", F.bround(F.col("tokens") / fixed.TOKENS_PER_PAGE).cast("long"))


def objective_status(metrics: DataFrame, objectives: Iterable[tuple] = fixed.OBJECTIVES) -> DataFrame:
    """One row per base and objective: ok, warn or bad; null values have no status."""
    named = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
                F.lit(float(good)).alias("good"),
                F.lit(float(ok)).alias("ok"),
                F.lit(higher).alias("higher"),
            )
            for name, good, ok, higher in objectives
        ]
    )
    v = metrics.select("kb_id", F.inline(named))
    reaches = lambda bound: F.when(
        F.col("higher"), F.col("value") >= F.col(bound)
    ).otherwise(F.col("value") <= F.col(bound))
    status = F.when(F.col("value").isNull(), F.lit(None).cast("string")).when(reaches("good"), "ok").when(
        reaches("ok"), "warn"
    ).otherwise("bad")
    return v.select("kb_id", "metric", "value", status.alias("status"))


# ------------------------------------------------------------------ limit replay

_REPLAY_COLUMNS = "user_id, day, ts, request_id, deep, exempt, daily_limit, deep_limit, minute_limit".split(", ")


def replay_limits(
    requests: DataFrame, site_limit: int = 0, window_s: float = 60.0, max_passes: int = 40
) -> DataFrame:
    """Replay admission over a request log; a refused request counts for nothing.

    ``requests``: user_id, ts (seconds, double), request_id, deep, exempt, daily_limit,
    deep_limit, minute_limit (0 lifts a daily or minute limit).  Adds ``verdict``: ok,
    daily, deep, global or minute.

    Counters restart each day, so a user's day is one unit of work, read in time order
    with a state of at most ``minute_limit`` times.  Two things cross units: the last
    minute before midnight, and the moment the whole site reaches ``site_limit``.  Both
    are small tables found by repeating the pass until they no longer change; each pass
    settles at least one more day, and two passes are the usual number.
    """
    day = F.floor(F.col("ts") / 86400).cast("long")
    rows = requests.withColumn("day", day).select(*_REPLAY_COLUMNS)
    spark = requests.sparkSession
    carry = spark.createDataFrame([], "user_id long, day long, carried array<double>").withColumn(
        "user_id", F.col("user_id").cast(dict(rows.dtypes)["user_id"])
    )
    closing = spark.createDataFrame([], "day long, closes double, closes_id long")
    schema = rows.withColumn("verdict", F.lit("")).schema
    previous = None
    for _ in range(max_passes):
        verdicts = (
            rows.join(carry, ["user_id", "day"], "left")
            .join(closing, "day", "left")
            .repartition("user_id", "day")
            .sortWithinPartitions("user_id", "day", "ts", "request_id")
            .mapInPandas(_replayer(window_s), schema)
        )
        from ..session import cut_lineage

        verdicts = cut_lineage(verdicts, "replay")
        carry = _carried(verdicts, window_s)
        closing = _closing_times(verdicts, site_limit)
        mark = (
            carry.agg(F.sum(F.xxhash64("user_id", "day", "carried") % 1000003)).first()[0],
            closing.agg(F.sum(F.xxhash64("day", "closes", "closes_id") % 1000003)).first()[0],
        )
        if mark == previous:
            return verdicts
        previous = mark
    raise RuntimeError("limit replay did not settle")


def _carried(verdicts: DataFrame, window_s: float) -> DataFrame:
    """Admitted times in the last minute of a user's day, for the user's next day."""
    watched = ~F.col("exempt") & (F.col("minute_limit") > 0)
    late = watched & (F.col("verdict") == "ok") & ((F.col("day") + 1) * 86400 - F.col("ts") <= window_s)
    return (
        verdicts.where(late)
        .groupBy("user_id", (F.col("day") + 1).alias("day"))
        .agg(F.sort_array(F.collect_list("ts")).alias("carried"))
    )


def _closing_times(verdicts: DataFrame, site_limit: int) -> DataFrame:
    """When each day's admitted count reached the site limit, if it has one."""
    admitted = verdicts.where((F.col("verdict") == "ok") & F.lit(site_limit > 0))
    from .ordered import running_total_by_bucket

    counted = running_total_by_bucket(
        admitted.withColumn("_one", F.lit(1)), ["day"], ["ts", "request_id"], F.floor(F.col("ts") / 600), "_one", "nth"
    )
    return counted.where(F.col("nth") == site_limit).select(
        "day", F.col("ts").alias("closes"), F.col("request_id").cast("long").alias("closes_id")
    )


def _replayer(window_s: float):
    def run(batches):
        unit, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.user_id, r.day) != unit:
                    unit = (r.user_id, r.day)
                    carried = [] if r.carried is None else list(r.carried)
                    state = {"recent": carried, "used": 0, "deep": 0}
                out.append(_admit(r, state, window_s))
            yield pdf[_REPLAY_COLUMNS].assign(verdict=out)

    return run


def _admit(r, state: dict, window_s: float) -> str:
    state["recent"] = [x for x in state["recent"] if r.ts - x <= window_s]
    if not r.exempt:
        if r.daily_limit and state["used"] >= r.daily_limit:
            return "daily"
        if r.deep and state["deep"] >= r.deep_limit:
            return "deep"
        if not pd.isna(r.closes) and (r.ts, r.request_id) > (r.closes, r.closes_id):
            return "global"
        if r.minute_limit and len(state["recent"]) >= r.minute_limit:
            return "minute"
    state["used"] += 1
    state["deep"] += bool(r.deep)
    if r.minute_limit and not r.exempt:
        state["recent"].append(r.ts)
    return "ok"
