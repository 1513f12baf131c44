"""Catalog: listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings, ordered
from . import oracle as o
from .catalog import query


def stamp(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


def _bases(t):
    return t.customer.select(
        F.col("c_custkey").alias("base_id"),
        F.when(F.col("c_acctbal") < 5000, F.col("c_nationkey").cast("long")).alias("owner_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admins").otherwise("all").alias("visibility"),
    )


@query(
    "l1_visible_bases",
    """WITH b AS (SELECT c_custkey AS base_id, CASE WHEN c_acctbal < 5000 THEN c_nationkey END AS owner,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admins' ELSE 'all' END AS visibility FROM customer)
    SELECT base_id, visibility FROM b WHERE owner = 7 OR (owner IS NULL AND visibility = 'all')""",
)
def _(t):
    return listings.visible_bases(_bases(t), 7, is_admin=False).select("base_id", "visibility")


@query(
    "l2_documents",
    o.with_views(
        "chunks_v",
        """SELECT d.doc_id, d.title, d.status, count(c.chunk_id) AS chunks FROM docs_v d LEFT JOIN chunks_v c USING (doc_id) GROUP BY 1, 2, 3""",
    ),
)
def _(t):
    return listings.documents_with_counts(t.docs(), t.chunks()).select("doc_id", "title", "status", "chunks")


@query(
    "l3_traces",
    o.with_views(
        "traces_v users_v",
        f"""SELECT trace_id, {o.stamp('created_at')} AS created_at, status, email FROM (
        SELECT * FROM traces_v WHERE NOT is_eval AND status IN ('failed', 'partial') AND healed
        ORDER BY created_at DESC, trace_id DESC LIMIT 50 OFFSET 50) JOIN users_v USING (user_id)""",
    ),
)
def _(t):
    rows = listings.filter_traces(t.traces(), ["failed", "partial"], healed=True)
    return stamp(listings.trace_page(rows, t.users(), 50, 50), "created_at").select("trace_id", "created_at", "status", "email")


@query(
    "l4_chats",
    o.with_views(
        "traces_v",
        f"""SELECT session_id, arg_min(query, created_at) AS title, {o.stamp('min(created_at)')} AS started_at,
        {o.stamp('max(created_at)')} AS updated_at, count(*) AS messages FROM traces_v WHERE NOT is_eval
        GROUP BY 1 """,
    ),
)
def _(t):
    return stamp(listings.chats(t.traces()), "started_at", "updated_at")


def _chat_rows(t):
    """One long chat per user, with few distinct questions so that reports repeat them."""
    rows = t.traces()
    return rows.select(
        "trace_id",
        F.col("user_id").alias("session_id"),
        "created_at",
        F.col("status").alias("query"),
        F.when(F.col("k") >= 40, "deep").otherwise("standard").alias("route"),
        F.when(F.pmod("k", F.lit(3)) != 0, F.concat(F.lit("job"), F.col("trace_id").cast("string"))).alias("job_id"),
    )


@query(
    "l5_chat_turns",
    o.with_views(
        "traces_v",
        """r AS (SELECT trace_id, user_id AS session_id, created_at, status AS query, k >= 40 AS deep,
               CASE WHEN k % 3 <> 0 THEN 'job' || trace_id END AS job_id FROM traces_v),
        s AS (SELECT *, CASE WHEN deep AND lag(query) OVER w = query AND lag(job_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh
              FROM r WINDOW w AS (PARTITION BY session_id ORDER BY created_at, trace_id)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at, trace_id) AS turn_no FROM s)
        SELECT session_id, turn_no::BIGINT AS turn_no, arg_min(query, trace_id) AS query, max(trace_id) AS answer_trace_id, count(*) AS n
        FROM g GROUP BY 1, 2""",
    ),
)
def _(t):
    return listings.chat_turns(_chat_rows(t)).select(
        "session_id", F.col("turn_no").cast("long").alias("turn_no"), "query", "answer_trace_id", F.col("rows").alias("n")
    )


@query(
    "l6_hide_chats",
    o.with_views(
        "traces_v",
        """SELECT trace_id, session_id IN (SELECT session_id FROM traces_v WHERE status = 'escalated') AS hidden FROM traces_v""",
    ),
)
def _(t):
    rows = t.traces()
    return listings.hide_chats(rows, rows.where(F.col("status") == "escalated")).select("trace_id", "hidden")


@query("l7_find_users", o.with_views("users_v", "SELECT user_id, email FROM users_v WHERE lower(email) LIKE '%r1%' OR lower(name) LIKE '%r1%'"))
def _(t):
    return listings.find_users(t.users(), " R1 ").select("user_id", "email")


@query(
    "l8_by_impact",
    o.with_views(
        "traces_v diagnoses_v",
        """SELECT diagnosis_id, root_cause, round(impact, 2) AS impact, status
        FROM diagnoses_v WHERE status IN ('open', 'fixing', 'needs_human')""",
    ),
)
def _(t):
    listed = listings.by_impact(t.diagnoses(), ["open", "fixing", "needs_human"])
    return listed.select("diagnosis_id", "root_cause", F.round("impact", 2).alias("impact"), "status")


@query(
    "l8_newest_fixes",
    o.with_views(
        "traces_v diagnoses_v",
        "SELECT fix_id, status FROM fixes_v WHERE status IN ('applied', 'canary') ORDER BY created_at DESC, fix_id LIMIT 10",
    ),
)
def _(t):
    return listings.newest(t.fixes(), "fix_id", 10, ["applied", "canary"]).select("fix_id", "status")


@query(
    "l9_trace_detail",
    o.with_views(
        "traces_v feedback_v",
        "SELECT t.trace_id, t.status, string_agg(f.kind || ':' || f.rating, ',' ORDER BY f.ts, f.kind, f.rating) AS feedback FROM traces_v t LEFT JOIN feedback_v f USING (trace_id) GROUP BY 1, 2",
    ),
)
def _(t):
    shown = F.array_join(F.transform("feedback", lambda f: F.concat(f["kind"], F.lit(":"), f["rating"].cast("string"))), ",")
    return listings.trace_detail(t.traces(), t.feedback()).select("trace_id", "status", shown.alias("feedback"))


@query(
    "l10_document_detail",
    o.with_views(
        "chunks_v",
        """SELECT doc_id, chunk_id, ord::BIGINT AS ord, title, count(*) OVER (PARTITION BY doc_id) AS live_chunks FROM chunks_v""",
    ),
)
def _(t):
    return listings.document_detail(t.docs(), t.chunks()).select(
        "doc_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "title", "live_chunks"
    )


@query(
    "l11_waterfall",
    """WITH s AS (SELECT conv_id AS trace_id, turn AS step, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS t_ms FROM conversations)
    SELECT trace_id, step, coalesce(lag(t_ms) OVER w, 0) AS start_ms, t_ms - coalesce(lag(t_ms) OVER w, 0) AS length_ms
    FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY step)""",
)
def _(t):
    block = F.floor(F.col("step") / 4)
    steps = t.conversations.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("step"), F.length("text").cast("long").alias("ms")
    )
    timed = ordered.running_total_by_bucket(steps, ["trace_id"], ["step"], block, "ms", "t_ms")
    return listings.waterfall(timed.drop("ms"), block).select("trace_id", "step", "start_ms", "length_ms")


@query(
    "l12_detach_users",
    o.with_views(
        "traces_v users_v",
        """SELECT trace_id, CASE WHEN u.role <> 'admin' THEN t.user_id END AS user_id, CASE WHEN u.role <> 'admin' THEN session_id END AS session_id
        FROM traces_v t JOIN users_v u USING (user_id)""",
    ),
)
def _(t):
    gone = t.users().where(F.col("role") == "admin")
    return listings.detach_users(t.traces(), gone, ["session_id", "user_id"]).select("trace_id", "user_id", "session_id")


@query(
    "l13_content_gaps",
    o.with_views(
        "traces_v diagnoses_v",
        "SELECT diagnosis_id, root_cause, status FROM diagnoses_v WHERE status IN ('open', 'fixing', 'needs_human') AND root_cause IN ('missing_content', 'stale_content')",
    ),
)
def _(t):
    return listings.content_gaps(t.diagnoses()).select("diagnosis_id", "root_cause", "status")


@query(
    "l14_find_documents",
    o.with_views("docs_v", "SELECT doc_id, uri FROM docs_v WHERE contains(lower(title), 'ea') OR contains(lower(uri), 'ea')"),
)
def _(t):
    return listings.find_documents(t.docs(), "EA").select("doc_id", "uri")
