"""Failure mining: from the trace log to findings, diagnoses, proposed fixes and verdicts.

``findings``: kb_id, trace_id, root_cause, target, severity, summary, question, doc_id,
chunk_id, tier, url, user_words, doc_words, seen_at.  Every rule yields this shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.fixed import DEFAULTS, Tunables

OPEN = ("open", "fixing", "needs_human")
LIVE_FIX = ("proposed", "evaluating", "pending_approval", "canary")

_FINDING = {
    "kb_id": None, "trace_id": None, "root_cause": "string", "target": "string", "severity": "double",
    "summary": "string", "question": "string", "doc_id": "string", "chunk_id": "string", "tier": "string",
    "url": "string", "user_words": "array<string>", "doc_words": "array<string>", "seen_at": "timestamp",
}


def initially_diagnosed() -> Column:
    """A clean answer needs no mining."""
    return F.col("status").isin("verified", "direct", "escalated") & ~F.col("healed")


def severity() -> Column:
    hurt = F.col("status").isin("failed", "partial") | F.col("negative_signal")
    return F.when(hurt, 1.0).otherwise(0.5)


def worth_mining() -> Column:
    return (
        ~F.col("is_eval")
        & ~F.col("diagnosed")
        & (F.col("status").isin("failed", "partial") | F.col("negative_signal") | F.col("healed"))
    )


def mine_failures(traces: DataFrame, limit: int | None = None) -> DataFrame:
    """The traces worth learning from; with ``limit`` the oldest of each base, the rest wait a cycle."""
    worth = traces.where(worth_mining()).withColumn("severity", severity())
    if limit is None:
        return worth
    w = Window.partitionBy("kb_id").orderBy("created_at", "trace_id")
    return worth.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= limit).drop("_nth")


def bases_with_work(bases: DataFrame, traces: DataFrame) -> DataFrame:
    todo = traces.where(~F.col("diagnosed") & ~F.col("is_eval")).select("kb_id")
    return bases.join(todo, "kb_id", "left_semi")


def _finding(rows: DataFrame, cause, target, summary, **given) -> DataFrame:
    values = {"root_cause": cause, "target": target, "summary": summary, "seen_at": F.col("created_at")} | given
    columns = []
    for name, kind in _FINDING.items():
        value = values.get(name)
        if value is None:
            value = F.col(name) if name in ("kb_id", "trace_id", "severity") else F.lit(None)
        value = F.lit(value) if isinstance(value, str) else value
        columns.append((value if kind is None else value.cast(kind)).alias(name))
    return rows.select(*columns)


def rescue_findings(
    mined: DataFrame, rescues: DataFrame, rewrites: DataFrame, chunks: DataFrame, docs: DataFrame
) -> DataFrame:
    """One finding per rescued sub-question, by what rescued it.

    ``rescues``: trace_id, subq, origin, chunk_id, url, question.
    ``rewrites``: trace_id, subq, queries (array).
    """
    base = rescues.join(mined.select("trace_id", "kb_id", "severity", "created_at"), "trace_id")
    q = F.col("question")
    web = _finding(
        base.where(F.col("origin") == "web"),
        "missing_content",
        F.concat(F.lit("web:"), q),
        F.concat(F.lit("Only a web search could settle: "), q),
        question=q,
        url=F.col("url"),
    )
    meta = docs.select("doc_id", F.col("status").alias("doc_status"), F.col("tier").alias("doc_tier"), F.col("title").alias("doc_title"))
    body = chunks.select("chunk_id", "doc_id", "text", "context", "aliases")
    found = (
        base.where(F.col("origin") != "web")
        .join(body, "chunk_id")
        .join(meta, "doc_id", "left")
        .join(rewrites, ["trace_id", "subq"], "left")
    )
    seen = text.tokens(F.concat_ws(" ", "text", "context", F.array_join("aliases", " ")))
    own = text.tokens(F.concat_ws(" ", "text", "context"))
    none = F.array().cast("array<string>")
    worded = found.withColumn("user_words", text.missing_words(q, seen)).withColumn(
        "doc_words", text.present_words(F.coalesce("queries", none), own, text.raw_words(q))
    )
    by_chunk = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    by_doc = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    cold = F.col("origin") == "cold"
    shut_out = cold & (F.col("doc_status") == "quarantined")
    cold_tier = cold & (F.col("doc_tier") == "cold") & ~F.coalesce(shut_out, F.lit(False))
    cause = (
        F.when(F.col("origin") == "rewrite", "vocabulary_gap")
        .when(F.col("origin") == "widen", "ranking_miss")
        .when(F.col("origin") == "neighbor", "bad_chunking")
        .when(shut_out, "twiddler_error")
        .when(cold_tier, "ranking_miss")
        .when(F.col("origin").isin("exact", "cold"), "missing_context")
    )
    target = (
        F.when(F.col("origin") == "neighbor", by_doc)
        .when(shut_out, by_doc)
        .when(cold_tier, F.concat(F.lit("tier:"), F.col("doc_id").cast("string")))
        .otherwise(by_chunk)
    )
    keep_words = F.col("origin").isin("rewrite", "widen", "exact") | (cold & ~shut_out & ~cold_tier)
    quoted = F.concat(F.lit("'"), q, F.lit("'"))
    summary = (
        F.when(F.col("origin") == "rewrite", F.concat(F.lit("The document words this differently: "), quoted))
        .when(F.col("origin") == "widen", F.concat(F.lit("A helpful chunk came too low in the ranking of "), quoted))
        .when(F.col("origin") == "neighbor", F.concat(F.lit("Neighbouring chunks share the answer to "), quoted))
        .when(shut_out, F.concat(F.lit("Only a document set aside could answer "), quoted))
        .when(cold_tier, F.concat(F.lit("Only a document in the cold tier could answer "), quoted))
        .otherwise(F.concat(F.lit("Nothing but an exact identifier led to the chunk for "), quoted))
    )
    rest = _finding(
        worded.withColumn("_cause", cause).where(F.col("_cause").isNotNull()),
        F.col("_cause"),
        target,
        summary,
        question=q,
        doc_id=F.col("doc_id"),
        chunk_id=F.when(~F.coalesce(shut_out, F.lit(False)), F.col("chunk_id")),
        tier=F.when(cold_tier, "cold"),
        user_words=F.when(F.coalesce(keep_words, F.lit(False)), F.col("user_words")),
        doc_words=F.when(F.col("origin") == "rewrite", F.col("doc_words")),
    )
    return web.unionByName(rest)


def unsupported_findings(mined: DataFrame, dropped: DataFrame) -> DataFrame:
    """Statements without support in spite of evidence.  ``dropped``: trace_id, sentence."""
    n = dropped.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    rows = mined.join(n, "trace_id").withColumn("severity", F.col("severity") * 0.8)
    summary = F.concat(F.col("n").cast("string"), F.lit(" sentence(s) of the answer lacked support in what they cite"))
    return _finding(rows, "generation_error", "prompt:generate", summary, question=F.col("query"))


def conflict_findings(mined: DataFrame, conflict_claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Contradicted claims: the target names the documents involved."""
    docs = (
        evidence.where(F.col("doc_id").isNotNull())
        .groupBy("trace_id")
        .agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("doc_ids"))
    )
    rows = mined.join(conflict_claims.select("trace_id").distinct(), "trace_id").join(docs, "trace_id")
    target = F.concat(F.lit("docs:"), F.array_join("doc_ids", ","))
    return _finding(rows, "conflicting_sources", target, "The documents found do not agree", question=F.col("query"))


def gap_findings(mined: DataFrame, rescues: DataFrame, errors: DataFrame, unanswered: DataFrame) -> DataFrame:
    """Failed with nothing rescued and no error: the content is missing.

    ``unanswered``: trace_id, position, question.
    """
    first = unanswered.groupBy("trace_id").agg(F.min_by("question", "position").alias("_gap"))
    rows = (
        mined.where(F.col("status") == "failed")
        .join(rescues.select("trace_id"), "trace_id", "left_anti")
        .join(errors.select("trace_id"), "trace_id", "left_anti")
        .join(first, "trace_id", "left")
        .withColumn("_gap", F.coalesce("_gap", "query"))
    )
    target = F.concat(F.lit("gap:"), F.lower("_gap"))
    return _finding(rows, "missing_content", target, F.concat(F.lit("Nothing indexed covers: "), "_gap"), question=F.col("_gap"))


def injection_findings(mined: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    flagged = chunks.where(F.array_contains("flags", "injection_suspect")).select("chunk_id", "doc_id")
    rows = (
        evidence.select("trace_id", "chunk_id")
        .distinct()
        .join(flagged, "chunk_id")
        .join(mined.drop("severity"), "trace_id")
        .withColumn("severity", F.lit(1.0))
    )
    return _finding(
        rows,
        "injection",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")),
        "A chunk found for the question tries to give orders",
        doc_id=F.col("doc_id"),
        chunk_id=F.col("chunk_id"),
    )


def negative_findings(
    mined: DataFrame, citations: DataFrame, docs: DataFrame, source_hashes: DataFrame, others: DataFrame
) -> DataFrame:
    """Complaints: a source that changed, a wrong direct answer, else unexplained.

    ``source_hashes``: uri, source_hash as found at the source now.  ``others`` are the
    findings of the other rules.
    """
    unhappy = mined.where("negative_signal").drop("severity").withColumn("severity", F.lit(1.0))
    changed = docs.join(source_hashes, "uri").where(F.col("content_hash") != F.col("source_hash")).select("doc_id")
    cited = citations.where(F.col("doc_id").isNotNull()).select("trace_id", "doc_id").distinct()
    stale_rows = unhappy.join(cited.join(changed, "doc_id", "left_semi"), "trace_id")
    stale = _finding(
        stale_rows,
        "stale_content",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")),
        "The source has moved on since this document was indexed",
        doc_id=F.col("doc_id"),
    )
    gate = _finding(
        unhappy.where(F.col("route") == "direct"),
        "gate_error",
        "gate:threshold",
        "A direct reply, given without any search, was disliked",
        question=F.col("query"),
    )
    explained = others.select("trace_id").unionByName(stale.select("trace_id")).unionByName(gate.select("trace_id"))
    unexplained = _finding(
        unhappy.join(explained, "trace_id", "left_anti"),
        "unexplained_negative",
        F.concat(F.lit("trace:"), F.col("trace_id").cast("string")),
        "Marked as wrong for a reason no rule finds",
        question=F.col("query"),
    )
    return stale.unionByName(gate).unionByName(unexplained)


def mine_log(mined: DataFrame, detail, chunks: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The findings of all rules about some traces, from the stored tables of the trace log.

    ``detail`` gives a table of details by its name (see ``sources.trace_store``); only rows of the mined
    traces are read on.  ``chunks`` carry text, context, aliases and flags; ``docs`` status, tier, title, uri and
    content_hash; ``sources`` uri and source_hash as found now.
    """
    from ..session import cut_lineage

    mined = cut_lineage(mined, "mined")
    ids = mined.select("trace_id")

    def of(table: str) -> DataFrame:
        return detail(table).join(ids, "trace_id", "left_semi")

    rescues, citations = of("trace_rescues"), of("trace_citations")
    contradicted = of("trace_claims").where(F.size("contradicting") > 0)
    errors = of("trace_steps").where(F.col("error").isNotNull())
    open_parts = of("trace_subqueries").where(~F.coalesce("answered", F.lit(False))).withColumnRenamed("subq", "position")
    evidence = of("trace_evidence")
    found = rescue_findings(mined, rescues.drop("doc_id"), of("trace_rewrites"), chunks, docs)
    found = found.unionByName(unsupported_findings(mined, of("trace_unsupported")))
    found = found.unionByName(conflict_findings(mined, contradicted, evidence.join(contradicted, "trace_id", "left_semi")))
    found = found.unionByName(gap_findings(mined, rescues, errors, open_parts))
    found = cut_lineage(found.unionByName(injection_findings(mined, evidence, chunks)), "findings")
    return found.unionByName(negative_findings(mined, citations, docs, sources, found))


# ------------------------------------------------------------------ diagnoses

_KEY = ["kb_id", "root_cause", "target"]
_DIAGNOSIS = """diagnosis_id string, kb_id string, root_cause string, target string, status string, impact double, n_traces long, summary string,
question string, doc_id string, chunk_id string, tier string, url string, user_words array<string>, doc_words array<string>"""


def diagnosis_traces(findings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each trace once per diagnosis, with the severity it first came with.

    A diagnosis may gather a large share of all traces, so its traces are rows of their
    own rather than a list.
    """
    rows = findings.select(*_KEY, "trace_id", "severity", "seen_at")
    if known is not None:
        rows = rows.unionByName(known.select(*_KEY, "trace_id", "severity", "seen_at"))
    return rows.groupBy(*_KEY, "trace_id").agg(
        F.min_by("severity", "seen_at").alias("severity"), F.min("seen_at").alias("seen_at")
    )


def diagnosis_words(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct user and document words of each diagnosis, in order of first use; the first ``limit`` if given."""
    kinds = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("user_words").alias("words")),
        F.struct(F.lit("doc").alias("kind"), F.col("doc_words").alias("words")),
    )
    listed = findings.select(*_KEY, "seen_at", "trace_id", F.inline(kinds))
    words = listed.select(*_KEY, "kind", "seen_at", "trace_id", F.posexplode("words").alias("pos", "word"))
    first = words.groupBy(*_KEY, "kind", "word").agg(F.min(F.struct("seen_at", "trace_id", "pos")).alias("at"))
    w = Window.partitionBy(*_KEY, "kind").orderBy("at", "word")
    kept = first.withColumn("_nth", F.row_number().over(w))
    kept = kept if limit is None else kept.where(F.col("_nth") <= limit)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_nth", "word"))), lambda s: s["word"])
    per = kept.groupBy(*_KEY, "kind").agg(ordered.alias("words"))
    return per.groupBy(*_KEY).agg(
        F.max(F.when(F.col("kind") == "user", F.col("words"))).alias("user_words"),
        F.max(F.when(F.col("kind") == "doc", F.col("words"))).alias("doc_words"),
    )


def diagnosis_details(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """What the findings of a diagnosis say: latest summary, what was first asked and found, words."""
    at = F.struct("seen_at", "trace_id")
    latest = findings.groupBy(*_KEY).agg(
        F.max_by("summary", at).alias("summary"),
        F.min_by("question", at).alias("question"),
        F.min_by("doc_id", at).alias("doc_id"),
        F.min_by("chunk_id", at).alias("chunk_id"),
        F.max("tier").alias("tier"),
        F.min_by("url", at).alias("url"),
    )
    return latest.join(diagnosis_words(findings, limit), _KEY, "left")


def upsert_diagnoses(findings: DataFrame, known_traces: DataFrame | None = None) -> DataFrame:
    """Diagnoses per base, cause and target: impact, trace count, words, latest summary."""
    traces = diagnosis_traces(findings, known_traces)
    impact = traces.groupBy(*_KEY).agg(F.sum("severity").alias("impact"), F.count(F.lit(1)).alias("n_traces"))
    return impact.join(diagnosis_details(findings), _KEY, "left").withColumn("status", F.lit("open"))


def merge_findings(
    findings: DataFrame, diagnoses: DataFrame | None, traces: DataFrame | None, cycle: str, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Diagnoses and their traces after a cycle's findings.

    ``diagnoses``: diagnosis_id, kb_id, root_cause, target, status, impact, n_traces, summary,
    question, doc_id, chunk_id, tier, url, user_words, doc_words; at most one of a base, cause and
    target is open.  ``traces``: diagnosis_id, trace_id, severity, seen_at.  Both are None at first.

    Findings join the open diagnosis of their base, cause and target: a trace raises its impact
    once, by the severity it first came with; words are added behind those it has (the first
    ``limit`` are kept, if given), the summary is the latest, what was first asked and found stays.
    Where there is none (or only closed ones) a diagnosis opens, its id made from the cycle
    and the three, so that a cycle run again finds its own diagnoses and changes nothing.
    """
    named = F.to_json(F.struct(*_KEY))
    rows = findings.withColumn("_named", named)
    fresh_id = F.sha2(F.concat_ws("|", F.lit(cycle), "_named"), 256)
    if diagnoses is None:
        spark = findings.sparkSession
        diagnoses = spark.createDataFrame([], _DIAGNOSIS)
        traces = spark.createDataFrame([], "diagnosis_id string").select(
            "diagnosis_id", F.lit(None).cast(dict(findings.dtypes)["trace_id"]).alias("trace_id"), F.lit(None).cast("double").alias("severity"),
            F.lit(None).cast("timestamp").alias("seen_at"),
        )
    is_open = F.col("status").isin(*OPEN)
    opened = diagnoses.where(is_open).withColumn("_named", named)
    places = opened.select("_named", F.col("diagnosis_id").alias("_open"))

    met = rows.groupBy("_named", "trace_id").agg(F.min(F.struct("seen_at", "severity")).alias("_first"))
    met = met.select("_named", "trace_id", "_first.*")
    met = met.join(places, "_named", "left").withColumn("diagnosis_id", F.coalesce("_open", fresh_id))
    new = met.select("diagnosis_id", "trace_id", "severity", "seen_at").join(
        traces.select("diagnosis_id", "trace_id"), ["diagnosis_id", "trace_id"], "left_anti"
    )
    gain = new.groupBy("diagnosis_id").agg(F.sum("severity").alias("_more"), F.count(F.lit(1)).alias("_n"))

    told = diagnosis_details(findings, limit).withColumn("_named", named)
    said = told.select("_named", *[F.col(c).alias(f"_{c}") for c in ("summary", "user_words", "doc_words")])
    none = F.array().cast("array<string>")

    def words(column: str):
        both = F.array_distinct(F.concat(F.coalesce(column, none), F.coalesce(f"_{column}", none)))
        both = both if limit is None else F.slice(both, 1, limit)
        return F.when(F.size(both) > 0, both)

    kept = (
        opened.join(said, "_named", "left")
        .withColumn("summary", F.coalesce("_summary", "summary"))
        .withColumn("user_words", words("user_words"))
        .withColumn("doc_words", words("doc_words"))
        .select(*diagnoses.columns)
    )
    first = (
        told.join(places, "_named", "left_anti")
        .withColumn("diagnosis_id", fresh_id)
        .withColumn("status", F.lit("open"))
        .withColumn("impact", F.lit(0.0))
        .withColumn("n_traces", F.lit(0).cast("long"))
    )
    lacking = [F.lit(None).cast(kind).alias(c) for c, kind in diagnoses.dtypes if c not in first.columns]
    first = first.select("*", *lacking).select(*diagnoses.columns)
    live = kept.unionByName(first).join(gain, "diagnosis_id", "left")
    live = live.withColumn("impact", F.col("impact") + F.coalesce("_more", F.lit(0.0))).withColumn(
        "n_traces", F.col("n_traces") + F.coalesce("_n", F.lit(0))
    )
    closed = diagnoses.where(~F.coalesce(is_open, F.lit(False)))
    return closed.unionByName(live.select(*diagnoses.columns)), traces.unionByName(new.select(*traces.columns))


def propose_fixes(
    diagnoses: DataFrame,
    live_fixes: DataFrame,
    worst_docs: DataFrame | None = None,
    cfg: Tunables = DEFAULTS,
    most_words: int | None = None,
) -> DataFrame:
    """Fixes per diagnosis without a live one: kind, risk, params (map).

    ``most_words`` limits the words a fix adds or expands.

    ``live_fixes``: kb_id, root_cause, target, status.  ``worst_docs`` gives the document
    to set aside per conflicting diagnosis, see :func:`worst_of_conflict`.
    """
    live = live_fixes.where(F.col("status").isin(*LIVE_FIX)).select(*_KEY)
    d = diagnoses.join(live, _KEY, "left_anti")
    if worst_docs is not None:
        d = d.join(worst_docs.select(*_KEY, "worst_doc"), _KEY, "left")
    else:
        d = d.withColumn("worst_doc", F.lit(None).cast("string"))
    rc = F.col("root_cause")
    none = F.array().cast("array<string>")
    first = lambda words: words if most_words is None else F.slice(words, 1, most_words)
    user = first(F.filter(F.coalesce("user_words", none), lambda w: F.length(w) > 2))
    docw = first(F.coalesce("doc_words", none))
    cold = (rc == "ranking_miss") & (F.coalesce("tier", F.lit("")) == "cold")
    chunky = rc.isin("vocabulary_gap", "ranking_miss", "missing_context") & F.col("chunk_id").isNotNull() & ~cold

    def params(**kv) -> Column:
        pairs = [x for k, v in kv.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
        return F.create_map(*pairs)

    def option(test: Column, kind: str, p: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), p.alias("params")))

    gate = F.round(F.greatest(F.lit(0.05), F.lit(cfg.gate_threshold) - 0.1), 2)
    options = F.array(
        option(
            chunky,
            "augment_chunk",
            params(
                doc_id=F.col("doc_id"),
                chunk_id=F.col("chunk_id"),
                aliases_add=F.array_join(user, ","),
                context_append=F.coalesce(F.concat(F.lit("Asked about this: "), "question"), F.lit("")),
            ),
        ),
        option(
            chunky & (rc == "vocabulary_gap") & (F.col("n_traces") >= 2) & (F.size(user) > 0) & (F.size(docw) > 0),
            "add_alias",
            params(phrases=F.array_join(user, ","), expansions=F.array_join(docw, ",")),
        ),
        option(cold, "set_tier", params(doc_id=F.col("doc_id"), tier="warm")),
        option(
            rc == "bad_chunking",
            "rechunk_doc",
            params(doc_id=F.substring_index("target", ":", -1), strategy=fixed.LARGE_STRATEGY.name),
        ),
        option(rc == "stale_content", "recrawl_doc", params(doc_id=F.col("doc_id"))),
        option(
            rc == "missing_content",
            "content_gap",
            params(question=F.coalesce("question", F.lit("")), url=F.coalesce("url", F.lit(""))),
        ),
        option((rc == "generation_error") & (F.col("impact") >= 1.5), "improve_prompt", params(prompt="generate")),
        option(
            (rc == "conflicting_sources") & F.col("worst_doc").isNotNull(), "quarantine_doc", params(doc_id=F.col("worst_doc"))
        ),
        option(rc == "twiddler_error", "unquarantine_doc", params(doc_id=F.col("doc_id"))),
        option(rc == "injection", "quarantine_doc", params(doc_id=F.col("doc_id"))),
        option(rc == "gate_error", "gate_threshold", params(value=gate)),
    )
    fixes = d.select(*_KEY, "impact", F.inline(F.filter(options, lambda o: o.isNotNull())))
    return fixes.withColumn("risk", risk(F.col("kind"))).withColumn("status", F.lit("proposed"))


def risk(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, level in fixed.FIX_RISK.items():
        out = F.when(kind == name, level).otherwise(out)
    return out


def status_after_proposals(diagnoses: DataFrame, fixes: DataFrame) -> DataFrame:
    """``fixing`` where a fix was proposed, ``needs_human`` for the unexplained heavy ones."""
    got = fixes.select(*_KEY).distinct().withColumn("_fix", F.lit(True))
    heavy = F.col("root_cause").isin("unexplained_negative", "generation_error") & (F.col("impact") >= 1.5)
    has = F.coalesce("_fix", F.lit(False))
    status = F.when((F.col("status") == "open") & has, "fixing").when(~has & heavy, "needs_human").otherwise(F.col("status"))
    return diagnoses.join(got, _KEY, "left").withColumn("status", status).drop("_fix")


def worst_of_conflict(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Lowest authority, then oldest, among at least two active conflicting documents.

    ``members``: kb_id, root_cause, target, doc_id.
    """
    live = docs.where(F.col("status") == "active").select("doc_id", "authority", "modified_at")
    rank = F.struct("authority", F.coalesce("modified_at", F.lit(0).cast("timestamp")).alias("at"), "doc_id")
    return (
        members.join(live, "doc_id")
        .groupBy(*_KEY)
        .agg(F.min_by(F.col("doc_id").cast("string"), rank).alias("worst_doc"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= 2)
        .drop("n")
    )


# ------------------------------------------------------------------ evaluation of fixes


def target_questions(traces_of: DataFrame, traces: DataFrame, n: int | None = None) -> DataFrame:
    """The distinct questions of each diagnosis; with ``n`` that many at most, of its last ``2n`` traces."""
    recent = traces_of
    if n is not None:
        last = Window.partitionBy(*_KEY).orderBy(F.col("seen_at").desc(), F.col("trace_id").desc())
        recent = traces_of.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= 2 * n)
    asked = recent.join(traces.select("trace_id", F.col("query").alias("question")), "trace_id")
    first = asked.groupBy(*_KEY, "question").agg(F.min(F.struct("seen_at", "trace_id")).alias("at"))
    order = Window.partitionBy(*_KEY).orderBy("at", "question")
    placed = first.withColumn("position", F.row_number().over(order)).drop("at")
    return placed if n is None else placed.where(F.col("position") <= n)


def target_score() -> Column:
    """Verified at first pass 1, verified after healing 0.6, partial 0.3."""
    return (
        F.when((F.col("status") == "verified") & F.col("first_pass"), 1.0)
        .when(F.col("status") == "verified", 0.6)
        .when(F.col("status") == "partial", 0.3)
        .otherwise(0.0)
    )


def mark_first_pass(results: DataFrame, heals: DataFrame) -> DataFrame:
    """``heals``: trace_id, step.  Retrieval heals mean it was not the first pass."""
    healed = heals.where(F.col("step").isin("H2-H4", "H2-coverage")).select("trace_id").distinct()
    marked = results.join(healed.withColumn("_healed", F.lit(True)), "trace_id", "left")
    return marked.withColumn("first_pass", F.col("_healed").isNull()).drop("_healed")


def gate_verdict(results: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Whether each fix passes.  ``results``: fix_id, variant (base / candidate), kind
    (target / golden), question, status, first_pass, passed, overall."""
    tol = cfg.eval_regression_tolerance
    r = results.withColumn("_score", target_score())

    def part(variant: str, kind: str) -> Column:
        return (F.col("variant") == variant) & (F.col("kind") == kind)

    def mean(variant: str, column: Column) -> Column:
        return F.round(F.avg(F.when(part(variant, "golden"), column)), 4)

    per = r.groupBy("fix_id").agg(
        F.sum(F.when(part("base", "target"), F.col("_score"))).alias("target_base"),
        F.sum(F.when(part("candidate", "target"), F.col("_score"))).alias("target_candidate"),
        F.count_if(part("base", "golden")).alias("n_golden"),
        mean("base", F.col("passed").cast("double")).alias("pass_base"),
        mean("candidate", F.col("passed").cast("double")).alias("pass_candidate"),
        mean("base", F.col("overall")).alias("judge_base"),
        mean("candidate", F.col("overall")).alias("judge_candidate"),
    )
    pair = r.where(F.col("kind") == "golden").groupBy("fix_id", "question").agg(
        F.bool_or(F.when(F.col("variant") == "base", F.col("passed"))).alias("was"),
        F.bool_or(F.when(F.col("variant") == "candidate", F.col("passed"))).alias("now"),
    )
    lost = pair.where(F.col("was") & ~F.col("now")).groupBy("fix_id").agg(F.count(F.lit(1)).alias("regressed"))
    fell = F.coalesce(F.col("pass_candidate") < F.col("pass_base") - tol, F.lit(False)) | F.coalesce(
        F.col("judge_candidate") < F.col("judge_base") - tol, F.lit(False)
    )
    better = F.when(F.col("target_base").isNull(), ~F.col("regression")).otherwise(
        F.coalesce("target_candidate", F.lit(0.0)) > F.col("target_base")
    )
    return (
        per.join(lost, "fix_id", "left")
        .withColumn("regressed", F.coalesce("regressed", F.lit(0)))
        .withColumn("regression", fell)
        .withColumn("passed", better & ~F.col("regression") & (F.col("regressed") <= F.floor(F.col("n_golden") * tol)))
    )


def healed_goldens(candidate_targets: DataFrame, golden: DataFrame, citations: DataFrame) -> DataFrame:
    """Verified targets as golden items, unless the base already has that question."""
    docs = citations.where(F.col("doc_id").isNotNull()).groupBy("trace_id").agg(
        F.sort_array(F.collect_set("doc_id")).alias("expected_doc_ids")
    )
    return (
        candidate_targets.where(F.col("status") == "verified")
        .join(golden.select("kb_id", "question"), ["kb_id", "question"], "left_anti")
        .groupBy("kb_id", "question")
        .agg(F.min("trace_id").alias("trace_id"))
        .join(docs, "trace_id", "left")
        .withColumn("origin", F.lit("healed"))
    )


def fix_queue(fixes: DataFrame, diagnoses: DataFrame, n: int | None = None) -> DataFrame:
    """The proposed fixes of each base, heaviest diagnosis first; the next ``n`` if given."""
    impact = diagnoses.select("diagnosis_id", F.col("impact").alias("_impact"))
    w = Window.partitionBy("kb_id").orderBy(F.col("_impact").desc(), "created_at", "fix_id")
    waiting = fixes.where(F.col("status") == "proposed").join(impact, "diagnosis_id", "left").fillna(0.0, ["_impact"])
    placed = waiting.withColumn("place", F.row_number().over(w)).drop("_impact")
    return placed if n is None else placed.where(F.col("place") <= n)


def disposition() -> Column:
    """What happens to an evaluated fix, from kind, risk, passed and canary_running."""
    config = F.col("kind").isin(*fixed.CONFIG_FIXES)
    tested = config | F.col("kind").isin(*fixed.STAGED_FIXES)
    return (
        F.when(tested & ~F.coalesce("passed", F.lit(False)), "rejected")
        .when(F.col("risk") == "low", "applied")
        .when((F.col("risk") == "medium") & config & F.col("canary_running"), "queued_for_canary")
        .when((F.col("risk") == "medium") & config, "canary")
        .otherwise("pending_approval")
    )


def _edits(fixes: DataFrame) -> DataFrame:
    """One row per fix and field it sets: doc_id, fix_id, field, value, applied_at."""
    status = F.when(F.col("kind") == "quarantine_doc", "quarantined").when(F.col("kind") == "unquarantine_doc", "active")
    sets = F.array(
        F.struct(F.lit("status").alias("field"), status.alias("value")),
        F.struct(F.lit("tier").alias("field"), F.when(F.col("kind") == "set_tier", F.col("tier")).alias("value")),
    )
    rows = fixes.select("doc_id", F.col("fix_id").cast("string").alias("fix_id"), "applied_at", F.inline(sets))
    return rows.where(F.col("value").isNotNull())


def _fields(docs: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("status", "tier")])
    return docs.select("doc_id", F.inline(pairs))


def _with_latest(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents whose status and tier are those of their latest edit, if they have one."""
    at = F.struct("applied_at", "fix_id")
    last = [F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, at)).alias(f"new_{c}") for c in ("status", "tier")]
    out = docs.join(edits.groupBy("doc_id").agg(*last), "doc_id", "left")
    for c in ("status", "tier"):
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    return out.select(*docs.columns)


def apply_document_fixes(docs: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents after the applied tier and status fixes, and what undoes each of them.

    ``fixes``: fix_id, kind, doc_id, tier, applied_at.  Edits of one field of a document take
    effect in the order of ``applied_at``.  The inverse has a row per fix and field: the value
    set and ``before``, the value the field had just before that fix.
    """
    edits = _edits(fixes)
    turn = Window.partitionBy("doc_id", "field").orderBy("applied_at", "fix_id")
    known = edits.join(_fields(docs).withColumnRenamed("value", "was"), ["doc_id", "field"])
    inverse = known.withColumn("before", F.coalesce(F.lag("value").over(turn), "was")).drop("was")
    return _with_latest(docs, edits), inverse


def roll_back_documents(docs: DataFrame, inverse: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """Documents without the fixes ``undone`` (fix_id; all, if None).

    A field gets the value of its latest fix that stays, or had before its first one.  Fields that
    no undone fix set, and later fixes that stay, are left as they are.
    """
    marked = inverse.withColumn("_gone", F.lit(True)) if undone is None else inverse.join(
        undone.select(F.col("fix_id").cast("string").alias("fix_id")).distinct().withColumn("_gone", F.lit(True)), "fix_id", "left"
    )
    at = F.struct("applied_at", "fix_id")
    gone = F.coalesce("_gone", F.lit(False))
    per = marked.groupBy("doc_id", "field").agg(
        F.max_by(F.when(~gone, F.col("value")), F.when(~gone, at)).alias("stays"),
        F.min_by("before", at).alias("first"),
        F.max(at).alias("at"),
        F.bool_or(gone).alias("any"),
    )
    edits = per.where("any").select("doc_id", "field", F.coalesce("stays", "first").alias("value"), F.col("at.applied_at"), F.col("at.fix_id"))
    return _with_latest(docs, edits)


def setting_edits(fixes: DataFrame) -> DataFrame:
    """What applied configuration fixes set: fix_id, kb_id, name, value, applied_at.

    ``fixes``: fix_id, kb_id, kind, params (map), applied_at.  A threshold and a prompt are one
    setting of the base, a boost is one per document, an alias one per phrase.
    """
    p = F.col("params")

    def one(kind: str, name: Column, value: Column) -> Column:
        return F.when(F.col("kind") == kind, F.array(F.struct(name.alias("name"), value.alias("value"))))

    phrases = F.filter(F.split(F.coalesce(p["phrases"], F.lit("")), ","), lambda w: w != "")
    aliases = F.transform(phrases, lambda w: F.struct(F.concat(F.lit("alias:"), w).alias("name"), p["expansions"].alias("value")))
    sets = F.coalesce(
        one("gate_threshold", F.lit("gate_threshold"), p["value"]),
        one("improve_prompt", F.concat(F.lit("prompt:"), p["prompt"]), p["text"]),
        one("doc_boost", F.concat(F.lit("boost:"), p["doc_id"]), p["boost"]),
        F.when(F.col("kind") == "add_alias", aliases),
    )
    rows = fixes.select(F.col("fix_id").cast("string").alias("fix_id"), "kb_id", "applied_at", F.inline(sets))
    return rows.where(F.col("value").isNotNull() & F.col("name").isNotNull()).select("fix_id", "kb_id", "name", "value", "applied_at")


def apply_setting_fixes(settings: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settings (kb_id, name, value) after the edits, and what undoes each of them.

    Edits of one setting take effect in the order of ``applied_at``.  The inverse is the edit with
    ``before``, the value just before it, null where the setting did not exist.
    """
    key = ["kb_id", "name"]
    turn = Window.partitionBy(*key).orderBy("applied_at", "fix_id")
    was = settings.select(*key, F.col("value").alias("_was"))
    inverse = edits.join(was, key, "left").withColumn("before", F.coalesce(F.lag("value").over(turn), "_was")).drop("_was")
    last = edits.groupBy(*key).agg(F.max_by("value", F.struct("applied_at", "fix_id")).alias("_new"))
    after = settings.join(last, key, "full").select(*key, F.coalesce("_new", "value").alias("value"))
    return after, inverse


def roll_back_settings(settings: DataFrame, inverse: DataFrame, undone: DataFrame) -> DataFrame:
    """Settings without the fixes ``undone`` (fix_id).

    A setting gets the value of its latest edit that stays, else the one before its first; one that
    did not exist before and has no edit left goes.  Settings no undone fix set stay as they are,
    later changes included.
    """
    key = ["kb_id", "name"]
    gone_ids = undone.select(F.col("fix_id").cast("string").alias("fix_id")).distinct().withColumn("_gone", F.lit(True))
    marked = inverse.join(gone_ids, "fix_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    at = F.struct("applied_at", "fix_id")
    per = marked.groupBy(*key).agg(
        F.max_by(F.when(~F.col("_gone"), F.col("value")), F.when(~F.col("_gone"), at)).alias("_stays"),
        F.min_by("before", at).alias("_first"),
        F.bool_or("_gone").alias("_any"),
    )
    out = settings.join(per.where("_any"), key, "left")
    value = F.when(F.coalesce("_any", F.lit(False)), F.coalesce("_stays", "_first")).otherwise(F.col("value"))
    return out.select(*key, value.alias("value")).where(F.col("value").isNotNull())


def chunk_fix_roll_backs(fixes: DataFrame, docs: DataFrame, undone: DataFrame) -> DataFrame:
    """Which documents staged-chunk fixes put back: doc_id, fix_id, ok.

    ``fixes``: fix_id, kind, doc_id, version (the version the fix made live).  A document that has changed
    since cannot be put back (``ok`` is false); the others go to ``corpus.roll_back`` or the
    chunk store's.
    """
    staged = fixes.where(F.col("kind").isin(*fixed.STAGED_FIXES, "recrawl_doc"))
    asked = staged.join(undone.select("fix_id").distinct(), "fix_id", "left_semi")
    now = docs.select("doc_id", F.col("version").alias("_now"))
    return asked.join(now, "doc_id", "left").select("doc_id", "fix_id", F.coalesce(F.col("_now") == F.col("version"), F.lit(False)).alias("ok"))


def review_fixes(fixes: DataFrame, diagnoses: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Human decisions on fixes.  ``decisions``: fix_id, decision (approve / reject /
    roll_back), reason, ts; the latest per fix counts and only from a state it may leave.
    A diagnosis with several fixes follows the latest decision on any of them.
    Returns fixes and diagnoses with their new states."""
    last = decisions.groupBy("fix_id").agg(
        F.max_by(F.struct("decision", "reason"), "ts").alias("d"), F.max("ts").alias("_at")
    )
    joined = fixes.join(last, "fix_id", "left")
    decision = F.col("d.decision")
    approve = (decision == "approve") & F.col("status").isin("pending_approval", "canary", "proposed", "rejected")
    undo = (decision == "roll_back") & F.col("status").isin("applied", "canary")
    status = (
        F.when(approve, "applied").when(decision == "reject", "rejected").when(undo, "rolled_back").otherwise(F.col("status"))
    )
    changed = F.coalesce(approve | undo | (decision == "reject"), F.lit(False))
    moved = joined.withColumn("_new", status).withColumn("_changed", changed)
    effect = (
        F.when(F.col("_new") == "applied", "fixed")
        .when(F.col("_new") == "rolled_back", "open")
        .when(F.coalesce(F.col("d.reason"), F.lit("")) != "", "wont_fix")
        .otherwise("open")
    )
    marks = moved.where("_changed").groupBy("diagnosis_id").agg(
        F.max_by(F.struct(effect.alias("to"), F.col("_new").alias("by")), F.struct("_at", "fix_id")).alias("m")
    )
    rejected = F.col("m.by") == "rejected"
    allowed = F.col("m").isNotNull() & (~rejected | F.col("status").isin("open", "fixing"))
    new_diagnoses = (
        diagnoses.join(marks, "diagnosis_id", "left")
        .withColumn("status", F.when(allowed, F.col("m.to")).otherwise(F.col("status")))
        .drop("m")
    )
    return moved.withColumn("status", F.col("_new")).select(*fixes.columns), new_diagnoses


def cycle_report(mined: DataFrame, findings: DataFrame, diagnoses: DataFrame) -> DataFrame:
    t = mined.groupBy("kb_id").agg(F.count(F.lit(1)).alias("traces"))
    f = findings.groupBy("kb_id").agg(F.count(F.lit(1)).alias("findings"))
    d = diagnoses.groupBy("kb_id").agg(F.count(F.lit(1)).alias("diagnoses"))
    return t.join(f, "kb_id", "left").join(d, "kb_id", "left").fillna(0)
