"""Versioned corpus: change detection, versions, staging, schedules, quotas, removal.

Plain parquet has no merge, so each function returns the new state of the rows it was
given; callers write the touched ``kb_id`` partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.embedding import hash_embedding


def detect_changes(incoming: DataFrame, docs: DataFrame, force: bool = False, stage: bool = False) -> DataFrame:
    """Outcome per incoming document: created, updated, unchanged, staged or error.

    ``incoming``: kb_id, uri, content_hash, parse_error.  ``docs`` adds the known state.
    """
    known = docs.select(
        "kb_id", "uri", "doc_id", F.col("content_hash").alias("known_hash"), F.col("status").alias("known_status"), "version"
    )
    rows = incoming.join(known, ["kb_id", "uri"], "left")
    same = (F.col("known_hash") == F.col("content_hash")) & F.col("known_status").isin("active", "quarantined")
    unchanged = F.coalesce(same, F.lit(False)) & F.lit(not force and not stage)
    outcome = (
        F.when(unchanged, "unchanged")
        .when(F.col("parse_error").isNotNull(), "error")
        .when(F.lit(stage), "staged")
        .when(F.col("doc_id").isNull(), "created")
        .otherwise("updated")
    )
    return rows.withColumn("outcome", outcome).drop("known_hash", "known_status")


def removed_from_source(docs: DataFrame, incoming: DataFrame) -> DataFrame:
    gone = docs.where(F.col("status") != "superseded").join(incoming.select("kb_id", "uri"), ["kb_id", "uri"], "left_anti")
    return gone.withColumn("status", F.lit("superseded")).withColumn("error", F.lit("removed from source"))


def ingest_report(outcomes: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per source and outcome, with ``removed`` as an outcome of its own."""
    counts = outcomes.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))
    gone = removed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("removed"))
    return counts.unionByName(gone.select(*counts.columns))


def ingest_errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "error").select("kb_id", "uri", F.col("parse_error").alias("error"))


# ------------------------------------------------------------------ versions


def next_versions(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbers are never reused, even for versions rolled back."""
    highest = chunks.groupBy("doc_id").agg(F.max("doc_version").alias("_v"))
    known = F.greatest(F.col("version"), F.coalesce("_v", F.lit(0)))
    return docs.join(highest, "doc_id", "left").withColumn("next_version", known + 1).drop("_v")


def _as_is(documents: DataFrame) -> DataFrame:
    return documents


def activate_versions(chunks: DataFrame, targets: DataFrame, held: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Make ``version`` live per document of ``targets``; keep what was live before it.

    Of the older versions only the one live until now stays, as retired.  Where none was
    live, the direct predecessor stays.  ``held`` may store or broadcast what is known of each document.
    """
    t = targets.select("doc_id", "version")
    live = (
        chunks.where(F.col("status") == "active").groupBy("doc_id").agg(F.max("doc_version").alias("_was"))
    )
    rows = chunks.join(t, "doc_id", "left").join(held(live), "doc_id", "left")
    chosen = F.col("doc_version") == F.col("version")
    status = F.when(chosen, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status"))
    moved = rows.withColumn("status", F.when(F.col("version").isNull(), F.col("status")).otherwise(status))
    keep = (
        F.col("version").isNull()
        | (F.col("status") != "retired")
        | (F.col("doc_version") == F.when(F.coalesce(F.col("_was") != F.col("version"), F.lit(False)), F.col("_was")).otherwise(F.col("version") - 1))
    )
    return moved.where(keep).select(*chunks.columns)


def staged_targets(chunks: DataFrame) -> DataFrame:
    staged = chunks.where(F.col("status") == "staged")
    return staged.groupBy("doc_id").agg(F.max("doc_version").alias("version"))


def promote_staged(chunks: DataFrame, held: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    return activate_versions(chunks, held(staged_targets(chunks)), held)


def discard_staged(chunks: DataFrame, doc_ids: DataFrame | None = None, held: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    if doc_ids is None:
        return chunks.where(F.col("status") != "staged")
    drop = held(doc_ids.select("doc_id").distinct())
    staged = chunks.where(F.col("status") == "staged").join(drop, "doc_id", "left_anti")
    return chunks.where(F.col("status") != "staged").unionByName(staged.select(*chunks.columns))


def roll_back(chunks: DataFrame, doc_ids: DataFrame, held: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Bring back the newest retired version; the version rolled away from is retired.

    ``held`` may store or broadcast what is known of each document.
    """
    wanted = held(doc_ids.select("doc_id").distinct())
    state = (
        chunks.join(wanted, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(
            F.max(F.when(F.col("status") == "retired", F.col("doc_version"))).alias("_back"),
            F.max(F.when(F.col("status") == "active", F.col("doc_version"))).alias("_now"),
        )
        .where(F.col("_back").isNotNull())
    )
    rows = chunks.join(held(state), "doc_id", "left")
    v = F.col("doc_version")
    touched = F.col("_back").isNotNull() & F.col("status").isin("active", "retired")
    status = F.when(v == F.col("_back"), "active").otherwise("retired")
    keep = ~F.coalesce(touched, F.lit(False)) | (v == F.col("_back")) | F.coalesce(v == F.col("_now"), F.lit(False))
    return (
        rows.where(keep)
        .withColumn("status", F.when(touched, status).otherwise(F.col("status")))
        .select(*chunks.columns)
    )


def stage_edited_copy(chunks: DataFrame, docs: DataFrame, edits: DataFrame, model: str, size: int = 512) -> DataFrame:
    """A staged copy of the live chunks of edited documents, with the edits applied.

    ``edits``: doc_id, chunk_id, aliases_add (array), context_append.  Only edited chunks
    are embedded again.  Returns the staged rows; a former staged copy is to be dropped.
    """
    versions = next_versions(docs.select("doc_id", "version", F.col("title").alias("doc_title")), chunks)
    live = (
        chunks.where(F.col("status") == "active")
        .join(edits.select("doc_id").distinct(), "doc_id", "left_semi")
        .join(versions.select("doc_id", "doc_title", "next_version"), "doc_id")
        .join(edits.drop("doc_id"), "chunk_id", "left")
    )
    none = F.array().cast("array<string>")
    edited = F.col("aliases_add").isNotNull() | F.col("context_append").isNotNull()
    added = F.filter(F.coalesce("aliases_add", none), lambda a: a != "")
    aliases = F.array_distinct(F.concat(F.coalesce("aliases", none), added))
    extra = F.trim(F.coalesce("context_append", F.lit("")))
    context = F.when(
        (extra != "") & ~F.col("context").contains(extra), F.trim(F.concat_ws(" ", "context", extra))
    ).otherwise(F.col("context"))
    rows = (
        live.withColumn("_edited", edited)
        .withColumn("aliases", F.when(edited, aliases).otherwise(F.col("aliases")))
        .withColumn("context", F.when(edited, context).otherwise(F.col("context")))
        .withColumn("status", F.lit("staged"))
        .withColumn("doc_version", F.col("next_version"))
    )
    head = F.concat(F.col("context"), F.lit(" "), F.array_join("aliases", " "))
    said = embedding_text(F.col("doc_title"), F.col("section_path"), head, F.col("text"))
    changed = hash_embedding(rows.where("_edited"), said, size).withColumn("embedding_model", F.lit(model))
    same = rows.where(~F.col("_edited"))
    out = changed.select(*chunks.columns).unionByName(same.select(*chunks.columns))
    return out.withColumn("chunk_id", F.concat_ws("@", "chunk_id", F.col("doc_version").cast("string")))


def heuristic_context(title: Column, section: Column) -> Column:
    part = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", section '"), section, F.lit("'"))).otherwise("")
    return F.concat(F.lit("From '"), title, F.lit("'"), part, F.lit("."))


def embedding_text(title: Column, section: Column, context: Column, body: Column) -> Column:
    head = F.when(F.coalesce(context, F.lit("")) != "", context).otherwise(heuristic_context(title, section))
    return F.concat(head, F.lit("\n\n"), body)


def reembed_outdated(chunks: DataFrame, model: str, size: int = 512) -> DataFrame:
    """Embed again only the rows of another model."""
    current = F.coalesce(F.col("embedding_model") == model, F.lit(False))
    said = embedding_text(
        F.col("title"), F.col("section_path"), F.trim(F.concat_ws(" ", "context", F.array_join("aliases", " "))), F.col("text")
    )
    redone = hash_embedding(chunks.where(~current), said, size).withColumn("embedding_model", F.lit(model))
    return chunks.where(current).unionByName(redone)


# ------------------------------------------------------------------ schedules, actions, removal


def reschedule(docs: DataFrame, now: Column, changed: str = "changed") -> DataFrame:
    """Halve the interval after a change, double it otherwise, within bounds."""
    current = F.when(F.coalesce("crawl_interval_s", F.lit(0)) == 0, fixed.RECRAWL_DEFAULT_SECONDS).otherwise(
        F.col("crawl_interval_s")
    )
    interval = F.when(
        F.col(changed), F.greatest(F.lit(fixed.RECRAWL_MIN_SECONDS), F.floor(current / 2))
    ).otherwise(F.least(F.lit(fixed.RECRAWL_MAX_SECONDS), current * 2)).cast("long")
    due = F.timestamp_seconds(F.unix_timestamp(now) + interval)
    return docs.withColumns({"crawl_interval_s": interval, "next_crawl_at": due})


def is_due(now: Column, force: bool = False) -> Column:
    """On a left join of what was found with what is known."""
    return F.lit(force) | F.col("doc_id").isNull() | F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= now)


def apply_document_actions(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest status, tier and authority action per document.

    ``actions``: doc_id, action (quarantine / unquarantine / update), tier, authority, ts.
    """
    state = F.when(F.col("action") == "quarantine", "quarantined").when(F.col("action") == "unquarantine", "active")
    update = F.col("action") == "update"
    bound = F.col("authority").between(0.1, 2.0)
    last = actions.withColumn("_s", state).groupBy("doc_id").agg(
        F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("ts"))).alias("_status"),
        F.max_by("tier", F.when(update & F.col("tier").isNotNull(), F.col("ts"))).alias("_tier"),
        F.max_by("authority", F.when(update & bound, F.col("ts"))).alias("_authority"),
    )
    return (
        docs.join(last, "doc_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("tier", F.coalesce("_tier", "tier"))
        .withColumn("authority", F.coalesce("_authority", "authority"))
        .select(*docs.columns)
    )


def remove(docs: DataFrame, chunks: DataFrame, removals: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the removed ``doc_id``, ``source_id`` or ``kb_id``."""
    kept = docs.join(removals.select(level).distinct(), level, "left_anti").select(*docs.columns)
    if level in chunks.columns:
        left = chunks.join(removals.select(level).distinct(), level, "left_anti")
    else:
        left = chunks.join(kept.select("doc_id"), "doc_id", "left_semi")
    return kept, left.select(*chunks.columns)


# ------------------------------------------------------------------ upload quotas

_UPLOAD = ["kb_id", "position", "name", "est_tokens", "file_budget", "token_budget", "files", "tokens", "exists"]


def admit_uploads(uploads: DataFrame, limits: DataFrame) -> DataFrame:
    """Accept or refuse uploads in order; a refused file uses nothing.

    ``uploads``: kb_id, position, name, size, est_tokens (null when unreadable), exists
    (the base already holds that name).  ``limits``: kb_id, max_bytes, file_budget,
    token_budget (null lifts a budget), files, tokens (in use).  Adds ``verdict``: saved,
    type, size, unreadable, full or pages.

    Type and size are row tests.  Only bases with a budget need order; their rows are
    read as a stream whose state is two counters and the names accepted so far, and the
    file budget bounds those.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    rows = uploads.join(limits, "kb_id", "left")
    known = suffix.isin(*fixed.FILE_TYPES)
    limited = F.col("file_budget").isNotNull() | F.col("token_budget").isNotNull()
    unreadable = F.col("token_budget").isNotNull() & F.col("est_tokens").isNull()
    first = (
        F.when(~known, "type")
        .when(F.col("size") > F.coalesce("max_bytes", F.lit(fixed.MAX_FILE_BYTES)), "size")
        .when(~limited, "saved")
    )
    marked = rows.withColumn("_first", first).withColumn("_bad", unreadable)
    done = marked.where(F.col("_first").isNotNull())
    ordered = marked.where(F.col("_first").isNull())
    plain = [*_UPLOAD, "verdict"]
    schema = ordered.select(*_UPLOAD).withColumn("verdict", F.lit("")).schema
    judged = (
        ordered.select(*_UPLOAD)
        .repartition("kb_id")
        .sortWithinPartitions("kb_id", "position")
        .mapInPandas(_admit_stream, schema)
    )
    return done.withColumn("verdict", F.col("_first")).select(*plain).unionByName(judged).select(
        "kb_id", "position", "name", "verdict"
    )


def _admit_stream(batches):
    base, files, tokens, names = None, 0, 0, set()
    for pdf in batches:
        verdicts = []
        for r in pdf.itertuples(index=False):
            if r.kb_id != base:
                base, files, tokens, names = r.kb_id, int(r.files), int(r.tokens), set()
            capped, metered = not pd.isna(r.file_budget), not pd.isna(r.token_budget)
            replaces = bool(r.exists) or r.name in names
            if capped and not replaces and files >= r.file_budget:
                verdicts.append("full")
            elif metered and pd.isna(r.est_tokens):
                verdicts.append("unreadable")
            elif metered and tokens + r.est_tokens > r.token_budget:
                verdicts.append("pages")
            else:
                tokens += int(r.est_tokens) if metered else 0
                if not replaces:
                    files += 1
                    if capped:
                        names.add(r.name)
                verdicts.append("saved")
        yield pdf.assign(verdict=verdicts)
