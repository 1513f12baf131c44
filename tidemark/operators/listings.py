"""Listing queries of the question log, corpus and repair tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from .ordered import lag_by_bucket, running_total_by_bucket


def visible_bases(bases: DataFrame, user_id, is_admin: bool) -> DataFrame:
    """A private base is its owner's alone; others need admin rights or visibility ``all``."""
    mine = F.col("owner_id") == F.lit(user_id)
    shared = F.col("owner_id").isNull() & (F.lit(is_admin) | (F.col("visibility") == "all"))
    return bases.where(F.coalesce(mine, F.lit(False)) | shared)


def documents_with_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    live = chunks.where(F.col("status") == "active").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.join(live, "doc_id", "left").fillna(0, ["chunks"]).orderBy("title", "doc_id")


def find_documents(docs: DataFrame, needle: str) -> DataFrame:
    n = F.lit(needle.lower())
    return docs.where(F.lower("title").contains(n) | F.lower("uri").contains(n))


def document_detail(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of the documents, by status and position, with the live count."""
    live = chunks.where(F.col("status") == "active").groupBy("doc_id").agg(F.count(F.lit(1)).alias("live_chunks"))
    titles = docs.select("doc_id", "title").join(live, "doc_id", "left").fillna(0, ["live_chunks"])
    return chunks.drop("title").join(titles, "doc_id").orderBy("doc_id", "status", "ord")


def find_users(users: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    n = F.lit(needle.strip().lower())
    found = users.where(F.lower("email").contains(n) | F.lower("name").contains(n)).orderBy("email")
    return found if limit is None else found.limit(limit)


def filter_traces(
    traces: DataFrame,
    statuses: Sequence[str] = (),
    healed: bool | None = None,
    user_id=None,
    include_eval: bool = False,
) -> DataFrame:
    out = traces if include_eval else traces.where(~F.col("is_eval"))
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if healed is not None:
        out = out.where(F.col("healed") == healed)
    if user_id is not None:
        out = out.where(F.col("user_id") == user_id)
    return out


def trace_page(traces: DataFrame, users: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page, newest first, with the asker's email.  Count the input for the total."""
    page = traces.orderBy(F.col("created_at").desc(), F.col("trace_id").desc()).offset(offset).limit(limit)
    return page.join(users.select("user_id", "email"), "user_id", "left")


def trace_detail(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """Traces with their feedback in time order."""
    given = feedback.groupBy("trace_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", "kind", "rating", "correction"))).alias("feedback")
    )
    return traces.join(given, "trace_id", "left")


def chats(traces: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with first question, last activity and size, newest first; the first ``limit`` if given."""
    mine = traces.where(F.col("session_id").isNotNull() & ~F.col("is_eval") & ~F.col("hidden"))
    first = F.min_by("query", F.struct("created_at", "trace_id"))
    title = collapse(F.coalesce(F.col("_first"), F.lit("New chat")))
    listed = (
        mine.groupBy("session_id")
        .agg(
            first.alias("_first"),
            F.min("created_at").alias("started_at"),
            F.max("created_at").alias("updated_at"),
            F.count(F.lit(1)).alias("messages"),
        )
        .orderBy(F.col("updated_at").desc(), "session_id")
    )
    listed = listed if limit is None else listed.limit(limit)
    return listed.select("session_id", title.alias("title"), "started_at", "updated_at", "messages")


def chat_turns(traces: DataFrame) -> DataFrame:
    """Turns of every chat.  A research report replaces the answer it was started from.

    A deep trace repeating the question of a turn that has a job belongs to that turn;
    the last row of a turn gives its answer.
    """
    order = ["created_at", "trace_id"]
    day = F.to_date("created_at")
    seen = lag_by_bucket(traces, ["session_id"], order, day, ["query", "job_id"])
    report = (
        (F.col("route") == "deep")
        & F.col("prev.query").eqNullSafe(F.col("query"))
        & F.col("prev.job_id").isNotNull()
    )
    starts = seen.withColumn("_start", F.when(F.coalesce(report, F.lit(False)), 0).otherwise(1))
    numbered = running_total_by_bucket(starts, ["session_id"], order, day, "_start", "turn_no")
    at = F.struct(*order)
    return numbered.groupBy("session_id", "turn_no").agg(
        F.min_by("query", at).alias("query"),
        F.max_by("trace_id", at).alias("answer_trace_id"),
        F.min_by("job_id", at).alias("job_id"),
        F.count(F.lit(1)).alias("rows"),
    )


def hide_chats(traces: DataFrame, removed: DataFrame) -> DataFrame:
    """Mark the traces of removed chats as hidden; nothing is deleted."""
    gone = removed.select("session_id").distinct().withColumn("_gone", F.lit(True))
    return (
        traces.join(gone, "session_id", "left")
        .withColumn("hidden", F.col("hidden") | F.coalesce("_gone", F.lit(False)))
        .drop("_gone")
    )


def detach_users(rows: DataFrame, removed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null the given columns where ``user_id`` was removed; the rows stay."""
    gone = removed.select("user_id").distinct().withColumn("_gone", F.lit(True))
    out = rows.join(gone, "user_id", "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c)))
    return out.drop("_gone").select(*rows.columns)


def waterfall(steps: DataFrame, bucket: Column) -> DataFrame:
    """Start and length of each step from the cumulative ``t_ms`` it ended at."""
    seen = lag_by_bucket(steps, ["trace_id"], ["step"], bucket, ["t_ms"])
    start = F.coalesce(F.col("prev.t_ms"), F.lit(0))
    return seen.withColumn("start_ms", start).withColumn("length_ms", F.col("t_ms") - start).drop("prev")


def by_impact(diagnoses: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    out = diagnoses.where(F.col("status").isin(*statuses)) if statuses else diagnoses
    return out.orderBy(F.col("impact").desc(), "diagnosis_id")


def newest(rows: DataFrame, key: str, limit: int | None = None, statuses: Sequence[str] = ()) -> DataFrame:
    """Newest first: fixes, jobs, evaluation runs, golden items or audit rows."""
    out = rows.where(F.col("status").isin(*statuses)) if statuses else rows
    out = out.orderBy(F.col("created_at").desc(), key)
    return out.limit(limit) if limit else out


def content_gaps(diagnoses: DataFrame) -> DataFrame:
    live = F.col("status").isin("open", "fixing", "needs_human")
    return diagnoses.where(live & F.col("root_cause").isin("missing_content", "stale_content"))
