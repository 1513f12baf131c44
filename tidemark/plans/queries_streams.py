"""Catalog: streams over the event log and documents, and the plug-in surface."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import register, text
from ..operators import evaluation
from ..session import is_folder, shared_folder
from ..streaming import ingestion, jobs
from . import oracle as o
from .catalog import query
from .tables import Tables


class StreamTables(Tables):
    """The same tables and views, read as streams."""

    def __getattr__(self, name):
        still = Tables.__getattr__(self, name)
        source = self.spark.readStream.schema(still.schema).option("maxFilesPerTrigger", 64)
        table = f"{self.folder}/{name}.parquet"
        if is_folder(self.spark, table):
            return source.parquet(table)
        # a stream reads folders, so a table in one file is the folder around it, narrowed to that file
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def out_path(t, name):
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def streamed(t):
    return StreamTables(t.spark, t.folder)


def run(t, stream, keys, mode="update"):
    path = out_path(t, "out")
    jobs.run_now(stream, jobs.batch_writer(path), mode)
    return jobs.latest(t.spark, path, keys)


@query("k1_incremental_ingest")
def _(t):
    log = ingestion.CorpusLog(t.spark, out_path(t, "corpus"))
    files = streamed(t).documents.select(
        F.col("lang").alias("kb_id"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.encode("text", "UTF-8").alias("content"),
    )
    jobs.run_now(files, log.ingest, "append")
    return log.live_chunks().select("kb_id", "doc_id", "doc_version", "ord", "token_count")


@query(
    "k2_daily_usage",
    o.with_views(
        "traces_v",
        """SELECT strftime(created_at, '%Y-%m-%d') AS day, kb_id, count(*) AS n, count(*) FILTER (status = 'verified') AS verified,
        sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM traces_v WHERE NOT is_eval GROUP BY 1, 2""",
    ),
)
def _(t):
    return run(t, jobs.daily_usage(streamed(t).traces()), ["day", "kb_id"])


@query(
    "k3_request_rates",
    """SELECT event_id AS trace_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n_recent FROM events""",
)
def _(t):
    rates = jobs.rates_in_window(t.traces().select("trace_id", F.col("user_id").alias("key"), "created_at"))
    return rates.select("trace_id", "n_recent")


@query(
    "k3_rate_stream",
    """SELECT user_id AS key, event_id AS request_id,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n_recent FROM events""",
)
def _(t):
    rows = streamed(t).traces().select(F.col("trace_id").alias("request_id"), F.col("user_id").alias("key"), "created_at")
    return run(t, jobs.rate_stream(rows), ["key", "request_id"])


@query(
    "k4_rephrase_stream",
    o.with_views(
        "turns_v",
        f"""p AS (SELECT session_id, trace_id, lag(trace_id) OVER w AS prev_id, created_at, lag(created_at) OVER w AS prev_at,
             query, lag(query) OVER w AS prev_q FROM turns_v WINDOW w AS (PARTITION BY session_id ORDER BY created_at)),
        x AS (SELECT *, {o.content_terms('query')} AS a, {o.content_terms('prev_q')} AS b FROM p
              WHERE prev_id IS NOT NULL AND lower(query) <> lower(prev_q) AND created_at - prev_at <= INTERVAL 3 MINUTE)
        SELECT session_id, trace_id, prev_id AS rephrase_of, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 4) AS similarity
        FROM x WHERE len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) >= 0.1""",
    ),
)
def _(t):
    told = run(t, jobs.rephrase_stream(streamed(t).turns(), threshold=0.1), ["kb_id", "session_id", "trace_id"])
    return told.where("rephrase_of is not null").select("session_id", "trace_id", "rephrase_of", F.round("similarity", 4).alias("similarity"))


@query(
    "k5_chunk_helpfulness",
    o.with_views(
        "traces_v feedback_v citations_v",
        """w AS (SELECT *, CASE kind WHEN 'explicit' THEN 1.0::DOUBLE WHEN 'copy' THEN 0.5 WHEN 'citation_click' THEN 0.3 ELSE 0.7 END AS w,
             rating > 0 OR kind IN ('copy', 'citation_click') AS ok FROM feedback_v)
        SELECT chunk_id, round(sum(CASE WHEN ok THEN w ELSE 0 END), 4) AS good, round(sum(CASE WHEN ok THEN 0 ELSE w END), 4) AS bad
        FROM w JOIN (SELECT DISTINCT trace_id, chunk_id FROM citations_v) USING (trace_id) GROUP BY 1""",
    ),
)
def _(t):
    ids = [F.concat(F.pmod(F.col("trace_id") + n, F.lit(t.n_docs())).cast("string"), F.lit("-0")) for n in (0, 7)]
    rows = streamed(t).feedback().withColumn("chunk_ids", F.array(*ids))
    out = run(t, jobs.chunk_helpfulness(rows), ["chunk_id"])
    return out.select("chunk_id", F.round("good", 4).alias("good"), F.round("bad", 4).alias("bad"))


@query(
    "k6_canary_stream",
    o.with_views(
        "traces_v",
        """c AS (SELECT config_version, count(*) AS n, avg((status = 'verified')::INT) AS verified, avg(negative_signal::INT) AS negative,
          avg(coalesce(groundedness, 0)) AS groundedness FROM traces_v WHERE NOT is_eval GROUP BY 1)
        SELECT 2::BIGINT AS canary, x.n AS canary_n, y.n AS active_n, CASE WHEN x.n < 20 THEN 'expired'
          WHEN x.verified < y.verified - 0.05 OR x.negative > y.negative + 0.05 OR x.groundedness < y.groundedness - 0.05 THEN 'rolled_back'
          ELSE 'promoted' END AS decision FROM c x, c y WHERE x.config_version = 2 AND y.config_version = 1""",
    ),
)
def _(t):
    totals = run(t, jobs.version_totals(streamed(t).traces()), ["config_version"])
    return evaluation.canary_decision(jobs.totals_to_stats(totals), 2, 1, age_days=10)


_SESSIONS = o.with_views(
    "traces_v",
    f"""x AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY kb_id, user_id ORDER BY created_at) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM traces_v),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY kb_id, user_id ORDER BY created_at) AS nth FROM x)
    SELECT kb_id, user_id, {o.stamp('min(created_at)')} AS started_at, {o.stamp('max(created_at)')} AS last_at, count(*) AS n,
      count(*) FILTER (status = 'verified') AS verified FROM s GROUP BY kb_id, user_id, nth""",
)


def _stamped(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "last_at")})


@query("k7_sessions", _SESSIONS)
def _(t):
    return _stamped(jobs.sessions(t.traces(), "12 hours"))


@query("k7_session_stream", _SESSIONS)
def _(t):
    return _stamped(run(t, jobs.sessions(streamed(t).traces(), "12 hours", "1 day"), ["kb_id", "user_id", "started_at"], "complete"))


_COUNTS = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::FLOAT" for c in "aeiou")


@query("m1_plugged_embedder", f"SELECT doc_id, [{_COUNTS}] AS embedding, 'letters-5' AS embedding_model FROM documents")
def _(t):
    def letters(texts):
        return [[float(s.count(c)) for c in "aeiou"] for s in texts]

    return register.embed_with(t.documents, F.col("text"), letters, "letters-5").select("doc_id", "embedding", "embedding_model")


@query("m2_plugged_reranker", "SELECT conv_id, turn, 1.0::DOUBLE / (1 + length(text)) AS rerank, false AS degraded FROM conversations")
def _(t):
    def shorter_first(asked, texts):
        return [1.0 / (1 + len(s)) for s in texts]

    pairs = t.conversations.withColumn("asked", F.concat("role", F.lit(" "), "text"))
    return register.rerank_with(pairs, F.col("asked"), F.col("text"), shorter_first).select("conv_id", "turn", "rerank", "degraded")


@query("m3_table_functions")
def _(t):
    register.register_sql(t.spark)
    t.pages.createOrReplaceTempView("td_pages")
    return t.spark.sql("SELECT key AS page_id, pos, kind, text, level FROM td_html_blocks(TABLE(SELECT page_id, html FROM td_pages))")


@query(
    "m4_sql_functions",
    f"""SELECT doc_id, array_to_string({o.tokens('text')}, '|') AS toks, len({o.sentences('text')}) AS n_sents, greatest(1, length(text) // 4)::BIGINT AS est FROM documents""",
)
def _(t):
    register.register_sql(t.spark)
    t.documents.createOrReplaceTempView("td_documents")
    return t.spark.sql(
        """SELECT doc_id, array_join(td_tokens(text), '|') AS toks, cast(size(td_sentences(text)) AS BIGINT) AS n_sents,
        cast(td_estimate_tokens(text) AS BIGINT) AS est FROM td_documents"""
    )


@query("a5_golden_import", "SELECT item_id::VARCHAR AS item_id, text AS question, '' AS expected_answer, true AS active FROM benchmark")
def _(t):
    from ..sources import files

    path = out_path(t, "golden")
    lines = t.benchmark.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))).alias("value"))
    lines.write.text(path)
    return files.read_golden(t.spark, path, "kb").select("item_id", "question", "expected_answer", "active")


@query(
    "a6_trace_sink",
    o.with_views("traces_v", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, 2 * count(*) AS citations FROM traces_v GROUP BY 1"),
)
def _(t):
    from ..sources import files

    path = out_path(t, "traces")
    files.write_traces(t.traces(), {"trace_citations": t.citations()}, path)
    stored = t.spark.read.parquet(f"{path}/traces").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    cited = t.spark.read.parquet(f"{path}/trace_citations").groupBy("day").agg(F.count(F.lit(1)).alias("citations"))
    return stored.join(cited, "day").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a7_audit_sink")
def _(t):
    from ..sources import files

    path = out_path(t, "audit")
    rows = t.traces().select(
        F.col("user_id").cast("string").alias("actor"), F.lit("question").alias("action"), F.col("trace_id").cast("string").alias("target"),
        "created_at", F.create_map(F.lit("status"), F.col("status")).alias("details"),
    )
    files.append_audit(rows, path)
    return t.spark.read.parquet(path)
