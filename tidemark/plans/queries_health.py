"""Catalog: health metrics and usage, over the whole event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health
from . import oracle as o
from .catalog import query
from .tables import as_of

DAYS = 14


def live(t):
    return health.recent(t.traces(), as_of(), DAYS)


def rounded(df, *columns, places=4):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


def longs(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


@query("h1_window", o.with_views("live_v", "SELECT trace_id, kb_id, status FROM live_v"))
def _(t):
    return live(t).select("trace_id", "kb_id", "status")


@query("h2_status_counts", o.with_views("live_v", "SELECT kb_id, status, count(*) AS n FROM live_v GROUP BY 1, 2"))
def _(t):
    return health.status_counts(live(t))


_RATES = """SELECT kb_id, count(*) AS queries,
  round(count(*) FILTER (status = 'verified') / count(*) FILTER (answered), 4) AS verified_rate,
  round(count(*) FILTER (answered AND status = 'failed') / count(*) FILTER (answered), 4) AS abstention_rate,
  round(count(*) FILTER (answered AND healed) / count(*) FILTER (answered), 4) AS heal_rate,
  round(count(*) FILTER (answered AND healed AND status = 'verified') / count(*) FILTER (answered AND healed), 4) AS heal_success_rate,
  round(count(*) FILTER (negative_signal) / count(*), 4) AS negative_signal_rate FROM live_v GROUP BY 1"""


@query("h3_rates", o.with_views("live_v", _RATES))
def _(t):
    names = "verified_rate abstention_rate heal_rate heal_success_rate negative_signal_rate".split()
    return rounded(health.rates(live(t)), *names)


@query(
    "h4_means",
    o.with_views(
        "live_v",
        """SELECT kb_id, round(avg(groundedness) FILTER (answered), 4) AS groundedness,
        round(avg(contradiction) FILTER (answered), 4) AS contradiction_rate, round(avg(coverage) FILTER (answered), 4) AS coverage,
        round(avg(llm_calls), 4) AS avg_llm_calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out
        FROM live_v GROUP BY 1""",
    ),
)
def _(t):
    return rounded(health.means(live(t)), "groundedness", "contradiction_rate", "coverage", "avg_llm_calls")


@query(
    "h5_percentiles",
    o.with_views(
        "live_v",
        """r AS (SELECT kb_id, latency_ms, row_number() OVER (PARTITION BY kb_id ORDER BY latency_ms) - 1 AS i,
               count(*) OVER (PARTITION BY kb_id) AS n FROM live_v)
        SELECT kb_id, max(latency_ms) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50,
          max(latency_ms) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95 FROM r GROUP BY 1""",
    ),
)
def _(t):
    return health.nearest_rank(live(t), ["kb_id"], "latency_ms", {"p50": 0.5, "p95": 0.95})


@query(
    "h6_repeat_failures",
    o.with_views(
        "live_v",
        """f AS (SELECT kb_id, row_number() OVER (PARTITION BY kb_id, query_cluster_id ORDER BY created_at, trace_id) > 1 AS again
               FROM live_v WHERE answered AND status IN ('failed', 'partial'))
        SELECT kb_id, count(*) AS failures, count(*) FILTER (again) AS repeats,
          round(count(*) FILTER (again) / count(*), 4) AS repeat_failure_rate FROM f GROUP BY 1""",
    ),
)
def _(t):
    return rounded(health.repeat_failures(live(t)), "repeat_failure_rate")


@query(
    "h7_daily_series",
    o.with_views(
        "live_v",
        """SELECT kb_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n,
        round(count(*) FILTER (status = 'verified') / count(*), 4) AS verified_rate, round(avg(groundedness), 4) AS groundedness
        FROM live_v WHERE answered GROUP BY 1, 2""",
    ),
)
def _(t):
    s = health.daily_series(live(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return rounded(s, "verified_rate", "groundedness")


@query(
    "h8_time_to_heal",
    o.with_views(
        "traces_v diagnoses_v",
        """SELECT f.kb_id, floor(avg(date_diff('microsecond', d.created_at, f.applied_at) / 1e6::DOUBLE))::BIGINT AS mean_seconds, count(*) AS fixes
        FROM fixes_v f JOIN diagnoses_v d USING (diagnosis_id) WHERE f.status = 'applied' GROUP BY 1""",
    ),
)
def _(t):
    return health.time_to_heal(t.fixes(), t.diagnoses())


@query(
    "h9_corpus_totals",
    o.with_views(
        "chunks_v",
        """c AS (SELECT kb_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunks_v GROUP BY 1)
        SELECT kb_id, status, count(*) AS documents, any_value(chunks) AS chunks, any_value(tokens) AS tokens
        FROM docs_v JOIN c USING (kb_id) GROUP BY 1, 2""",
    ),
)
def _(t):
    return health.corpus_totals(t.docs(), t.chunks())


@query(
    "h10_repair_backlog",
    o.with_views(
        "traces_v diagnoses_v golden_v",
        """SELECT k.kb_id,
        (SELECT count(*) FROM diagnoses_v d WHERE d.kb_id = k.kb_id AND status IN ('open', 'fixing')) AS open_diagnoses,
        (SELECT count(*) FROM diagnoses_v d WHERE d.kb_id = k.kb_id AND status = 'needs_human') AS needs_human,
        (SELECT count(*) FROM fixes_v d WHERE d.kb_id = k.kb_id AND status = 'pending_approval') AS pending_approval,
        (SELECT count(*) FROM fixes_v d WHERE d.kb_id = k.kb_id AND status = 'applied') AS applied_fixes,
        (SELECT count(*) FROM golden_v d WHERE d.kb_id = k.kb_id AND active) AS golden_items
        FROM (SELECT DISTINCT kb_id FROM traces_v) k""",
    ),
)
def _(t):
    return health.repair_backlog(t.diagnoses(), t.fixes(), t.golden())


def day_text(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "h11_usage_daily",
    o.with_views("usage_v", "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, questions, deep, tokens_in, tokens_out FROM usage_v"),
)
def _(t):
    return day_text(health.usage_daily(t.traces()))


@query(
    "h12_site_usage",
    o.with_views(
        "usage_v",
        """SELECT strftime(day, '%Y-%m-%d') AS day, sum(questions)::BIGINT AS questions, sum(deep)::BIGINT AS deep,
        count(user_id) AS active_users, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out
        FROM usage_v WHERE day >= DATE '2024-01-17' GROUP BY 1""",
    ),
)
def _(t):
    first = F.date_sub(F.to_date(as_of()), DAYS)
    return day_text(health.site_usage(health.usage_daily(t.traces()), first))


@query(
    "h13_top_users",
    o.with_views(
        "usage_v users_v",
        """SELECT email, questions FROM usage_v JOIN users_v USING (user_id) WHERE day = DATE '2024-01-30'
        ORDER BY questions DESC, email LIMIT 10""",
    ),
)
def _(t):
    yesterday = F.date_sub(F.to_date(as_of()), 1)
    return health.top_users(health.usage_daily(t.traces()), t.users(), yesterday)


@query(
    "h14_usage_summary",
    o.with_views(
        "usage_v users_v",
        """l AS (SELECT *, CASE plan WHEN 'pro' THEN 300 ELSE 30 END AS pd, CASE plan WHEN 'pro' THEN 15 ELSE 5 END AS pm,
               CASE plan WHEN 'pro' THEN 20 ELSE 2 END AS pp FROM users_v),
        m AS (SELECT l.*, coalesce(daily_limit_override, pd) AS lim, coalesce(u.questions, 0) AS used, coalesce(u.deep, 0) AS dused
              FROM l LEFT JOIN (SELECT * FROM usage_v WHERE day = DATE '2024-01-30') u USING (user_id))
        SELECT user_id, plan, used AS questions_today, CASE WHEN role <> 'admin' AND lim <> 0 THEN lim END::BIGINT AS daily_limit,
          CASE WHEN role <> 'admin' AND lim <> 0 THEN greatest(0, lim - used) END::BIGINT AS remaining, dused AS deep_today,
          CASE WHEN role <> 'admin' THEN pp END::BIGINT AS deep_limit, CASE WHEN role <> 'admin' THEN pm END::BIGINT AS minute_limit FROM m""",
    ),
)
def _(t):
    today = health.usage_daily(t.traces()).where(F.col("day") == F.date_sub(F.to_date(as_of()), 1))
    out = health.usage_summary(health.effective_limits(t.users(), t.plans()), today)
    return longs(out, "daily_limit", "remaining", "deep_limit", "minute_limit")


@query("h15_limit_replay")
def _(t):
    requests = t.traces().select(
        "user_id",
        F.col("created_at").cast("double").alias("ts"),
        F.col("trace_id").alias("request_id"),
        (F.col("route") == "deep").alias("deep"),
        (F.pmod("user_id", F.lit(50)) == 0).alias("exempt"),
        F.lit(3).alias("daily_limit"),
        F.lit(1).alias("deep_limit"),
        F.lit(1).alias("minute_limit"),
    )
    return health.replay_limits(requests, site_limit=300).select("request_id", "user_id", "verdict")


@query(
    "h16_workspace_usage",
    o.with_views(
        "chunks_v",
        """c AS (SELECT kb_id, sum(token_count)::BIGINT AS tokens FROM chunks_v GROUP BY 1)
        SELECT kb_id, count(*) AS files, any_value(tokens) AS tokens, round_even(any_value(tokens) / 500.0::DOUBLE, 0)::BIGINT AS pages
        FROM docs_v JOIN c USING (kb_id) GROUP BY 1""",
    ),
)
def _(t):
    return health.workspace_usage(t.docs(), t.chunks())


@query(
    "h17_objectives",
    o.with_views(
        "live_v",
        f"""a AS ({_RATES}),
        b AS (SELECT kb_id, avg(groundedness) FILTER (answered) AS groundedness, avg(contradiction) FILTER (answered) AS contradiction_rate FROM live_v GROUP BY 1),
        c AS (SELECT kb_id, 1 - count(DISTINCT query_cluster_id) / count(*) AS repeat_failure_rate FROM live_v
              WHERE answered AND status IN ('failed', 'partial') GROUP BY 1),
        m AS (SELECT kb_id, unnest(['verified_rate', 'groundedness', 'contradiction_rate', 'heal_success_rate', 'repeat_failure_rate', 'negative_signal_rate']) AS metric,
              unnest([verified_rate, groundedness, contradiction_rate, heal_success_rate, repeat_failure_rate, negative_signal_rate]) AS value,
              unnest([0.85, 0.9, 0.02, 0.7, 0.1, 0.05]) AS good, unnest([0.6, 0.75, 0.1, 0.4, 0.3, 0.15]) AS fair
              FROM a JOIN b USING (kb_id) JOIN c USING (kb_id))
        SELECT kb_id, metric, round(value, 4) AS value,
          CASE WHEN metric IN ('verified_rate', 'groundedness', 'heal_success_rate')
            THEN CASE WHEN value >= good THEN 'ok' WHEN value >= fair THEN 'warn' ELSE 'bad' END
            ELSE CASE WHEN value <= good THEN 'ok' WHEN value <= fair THEN 'warn' ELSE 'bad' END END AS status FROM m""",
    ),
)
def _(t):
    rows = live(t)
    m = health.rates(rows).join(health.means(rows), "kb_id").join(health.repeat_failures(rows), "kb_id")
    return rounded(health.objective_status(m), "value")
