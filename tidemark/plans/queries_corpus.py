"""Catalog: versioned corpus maintenance over all documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus
from ..operators.chunk_store import ChunkStore
from ..session import new_folder
from . import oracle as o
from .catalog import oracle, query
from .tables import as_of


def known(t):
    """What an earlier crawl stored: short documents are not known yet."""
    d = t.docs().where(F.col("n_chars") >= 500)
    return d.withColumn("content_hash", text.content_hash(F.col("text"))).withColumn("version", F.lit(2)).withColumn(
        "error", F.lit(None).cast("string")
    )


def incoming(t):
    """What a crawl finds now: cold documents changed, very long ones are gone."""
    d = t.docs().where(F.col("n_chars") < 5000)
    changed = F.concat("text", F.when(F.col("tier") == "cold", "!").otherwise(""))
    return d.select(
        "kb_id", "uri", "source_id", text.content_hash(changed).alias("content_hash"),
        F.when(F.col("n_chars") < 60, "no extractable text").alias("parse_error"),
    )


_CRAWL = """known AS (SELECT *, sha256(text) AS h FROM docs_v WHERE n_chars >= 500),
inc AS (SELECT *, sha256(text || CASE WHEN tier = 'cold' THEN '!' ELSE '' END) AS h, n_chars < 60 AS bad FROM docs_v WHERE n_chars < 5000),
oc AS (SELECT i.uri, i.source_id, CASE WHEN k.h = i.h THEN 'unchanged' WHEN i.bad THEN 'error' WHEN k.uri IS NULL THEN 'created' ELSE 'updated' END AS outcome
  FROM inc i LEFT JOIN known k USING (kb_id, uri))"""


@query("c1_detect_changes", o.with_views("docs_v", _CRAWL + " SELECT uri, outcome FROM oc"))
def _(t):
    return corpus.detect_changes(incoming(t), known(t)).select("uri", "outcome")


@query("c2_removed", o.with_views("docs_v", _CRAWL + " SELECT uri, 'superseded' AS status FROM known WHERE uri NOT IN (SELECT uri FROM inc)"))
def _(t):
    return corpus.removed_from_source(known(t), incoming(t)).select("uri", "status")


@query(
    "a8_ingest_report",
    o.with_views(
        "docs_v",
        _CRAWL
        + """ SELECT source_id, outcome, count(*) AS n FROM oc GROUP BY 1, 2 UNION ALL
        SELECT source_id, 'removed', count(*) FROM known WHERE uri NOT IN (SELECT uri FROM inc) GROUP BY 1""",
    ),
)
def _(t):
    found = corpus.detect_changes(incoming(t), known(t))
    return corpus.ingest_report(found, corpus.removed_from_source(known(t), incoming(t)), ["source_id"])


def versioned(t):
    """Every document live at version 2 with version 1 retired; labelled ones have a staged 3."""
    base = t.chunks()

    def at(df, version, status):
        tag = F.concat_ws("@", "chunk_id", F.lit(str(version)))
        return df.withColumn("doc_version", F.lit(version)).withColumn("status", F.lit(status)).withColumn("chunk_id", tag)

    staged = at(base, 3, "staged").join(t.labels.select("doc_id"), "doc_id", "left_semi").select(*base.columns)
    return at(base, 2, "active").unionByName(at(base, 1, "retired")).unionByName(staged)


_VERS = """vers AS (SELECT chunk_id || '@2' AS chunk_id, doc_id, 2 AS v, 'active' AS status FROM chunks_v
  UNION ALL SELECT chunk_id || '@1', doc_id, 1, 'retired' FROM chunks_v
  UNION ALL SELECT chunk_id || '@3', doc_id, 3, 'staged' FROM chunks_v WHERE doc_id IN (SELECT doc_id FROM labels))"""


def state(df):
    return df.select("chunk_id", "status")


@query("c3_next_version", o.with_views("chunks_v", _VERS + " SELECT doc_id, greatest(2, max(v)) + 1 AS next_version FROM vers GROUP BY 1"))
def _(t):
    docs = t.docs().select("doc_id", F.lit(2).alias("version"))
    out = corpus.next_versions(docs, versioned(t)).join(versioned(t).select("doc_id").distinct(), "doc_id", "left_semi")
    return out.select("doc_id", F.col("next_version").cast("long").alias("next_version"))


@query(
    "c4_activate",
    o.with_views(
        "chunks_v",
        _VERS
        + """ SELECT chunk_id, CASE WHEN NOT hit THEN status WHEN v = 3 THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status
        FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS hit FROM vers) WHERE NOT (hit AND v = 1)""",
    ),
)
def _(t):
    targets = t.labels.where(F.col("quality") == 1).select("doc_id", F.lit(3).alias("version"))
    return state(corpus.activate_versions(versioned(t), targets))


@query("c5_stage_edited")
def _(t):
    chunks = t.chunks().withColumn("embedding", F.array(F.lit(0.0)).cast("array<float>")).withColumn("embedding_model", F.lit("old"))
    edits = t.chunks().where(F.col("ord") == 0).join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "chunk_id", F.array(F.lit("alias one"), F.lit("alias two")).alias("aliases_add"), F.lit("Answers questions.").alias("context_append")
    )
    docs = t.docs().select("doc_id", "title", F.lit(1).alias("version"))
    return corpus.stage_edited_copy(chunks, docs, edits, "hash:hash-64", 64).select("chunk_id", "doc_version", "status", "aliases", "embedding_model")


@query(
    "c6_promote_staged",
    o.with_views(
        "chunks_v",
        _VERS
        + """ SELECT chunk_id, CASE WHEN NOT hit THEN status WHEN v = 3 THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status
        FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS hit FROM vers) WHERE NOT (hit AND v = 1)""",
    ),
)
def _(t):
    return state(corpus.promote_staged(versioned(t)))


@query(
    "c6_discard_staged",
    o.with_views("chunks_v", _VERS + " SELECT chunk_id, status FROM vers WHERE NOT (status = 'staged' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"),
)
def _(t):
    return state(corpus.discard_staged(versioned(t), t.labels.where(F.col("toxic") == 1)))


@query(
    "c7_roll_back",
    o.with_views(
        "chunks_v",
        _VERS
        + """ SELECT chunk_id, CASE WHEN hit AND v = 1 THEN 'active' WHEN hit AND v = 2 THEN 'retired' ELSE status END AS status
        FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS hit FROM vers)""",
    ),
)
def _(t):
    return state(corpus.roll_back(versioned(t), t.labels.where(F.col("quality") == 0)))


def _store(t):
    """The versions as a stored table of partitions by workspace, status and document slice."""
    return ChunkStore(t.spark, new_folder(t.spark, "chunks"), slices=8).create(versioned(t))


@query("c4_store_activate", oracle("c4_activate"))
def _(t):
    store = _store(t)
    store.activate("one", t.labels.where(F.col("quality") == 1).select("doc_id", F.lit(3).alias("version")))
    return state(store.chunks())


@query("c6_store_promote", oracle("c6_promote_staged"))
def _(t):
    store = _store(t)
    store.promote("one")
    store.promote("one")  # tried again: nothing more happens
    return state(store.chunks())


@query("c7_store_roll_back", oracle("c7_roll_back"))
def _(t):
    store = _store(t)
    store.roll_back("one", t.labels.where(F.col("quality") == 0))
    return state(store.chunks())


@query(
    "a4_store_live",
    o.with_views(
        "chunks_v",
        _VERS + """ SELECT chunk_id, vers.status, title FROM vers JOIN docs_v USING (doc_id) WHERE v > 1
        AND NOT (vers.status = 'staged' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    ),
)
def _(t):
    store = _store(t)
    store.discard("one", t.labels.where(F.col("toxic") == 1))
    return store.live(t.docs()).select("chunk_id", "status", "title")


def _scheduled(t):
    d = t.docs().withColumn("crawl_interval_s", 100 * F.pmod("doc_id", F.lit(7000)))
    return d.withColumn("changed", F.col("tier") == "cold").withColumn("next_crawl_at", F.when(F.col("n_chars") > 100, F.col("modified_at")))


@query(
    "c8_reschedule",
    o.with_views(
        "docs_v",
        f"""s AS (SELECT doc_id, tier, CASE WHEN doc_id % 7000 = 0 THEN 3600 ELSE 100 * (doc_id % 7000) END AS i FROM docs_v),
        n AS (SELECT doc_id, CASE WHEN tier = 'cold' THEN greatest(300, i // 2) ELSE least(604800, i * 2) END AS i FROM s)
        SELECT doc_id, i::BIGINT AS crawl_interval_s, {o.stamp("TIMESTAMP '2024-01-31' + to_seconds(i)")} AS next_crawl_at FROM n""",
    ),
)
def _(t):
    out = corpus.reschedule(_scheduled(t), as_of())
    return out.select("doc_id", "crawl_interval_s", F.date_format("next_crawl_at", "yyyy-MM-dd HH:mm:ss").alias("next_crawl_at"))


@query(
    "c9_due",
    o.with_views("docs_v", "SELECT uri FROM docs_v WHERE n_chars < 500 OR n_chars <= 100 OR modified_at <= TIMESTAMP '2024-01-31'"),
)
def _(t):
    found = t.docs().select("uri")
    stored = _scheduled(t).where(F.col("n_chars") >= 500).select("uri", "doc_id", "next_crawl_at")
    return found.join(stored, "uri", "left").where(corpus.is_due(as_of())).select("uri")


@query("c10_admit_uploads")
def _(t):
    uploads = t.documents.select(
        F.col("source").alias("kb_id"),
        F.col("doc_id").alias("position"),
        F.concat(F.lit("file"), F.pmod("doc_id", F.lit(37)).cast("string"), F.when(F.col("lang") == "es", ".exe").otherwise(".txt")).alias("name"),
        F.col("n_chars").alias("size"),
        F.when(F.col("n_chars") > 10, F.floor(F.col("n_chars") / 4)).alias("est_tokens"),
        F.lit(False).alias("exists"),
    )
    limits = t.documents.select(F.col("source").alias("kb_id")).distinct().select(
        "kb_id", F.lit(25000).alias("max_bytes"), F.lit(8).alias("file_budget"), F.lit(150000).alias("token_budget"),
        F.lit(1).alias("files"), F.lit(500).alias("tokens"),
    )
    return corpus.admit_uploads(uploads, limits)


@query(
    "c11_document_actions",
    o.with_views(
        "docs_v traces_v",
        """a AS (SELECT trace_id % 300 AS doc_id, k % 4 AS act, ['hot', 'warm', 'cold'][k % 3 + 1] AS tier, (k % 25) / 10.0::DOUBLE AS auth, trace_id AS ts FROM traces_v)
        SELECT d.doc_id, coalesce((SELECT arg_max(CASE act WHEN 0 THEN 'quarantined' ELSE 'active' END, ts) FROM a WHERE a.doc_id = d.doc_id AND act IN (0, 1)), d.status) AS status,
          coalesce((SELECT arg_max(a.tier, ts) FROM a WHERE a.doc_id = d.doc_id AND act >= 2), d.tier) AS tier,
          round(coalesce((SELECT arg_max(auth, ts) FROM a WHERE a.doc_id = d.doc_id AND act >= 2 AND auth BETWEEN 0.1 AND 2.0), d.authority), 4) AS authority FROM docs_v d""",
    ),
)
def _(t):
    names = F.array(*[F.lit(x) for x in ("quarantine", "unquarantine", "update", "update")])
    tiers = F.array(*[F.lit(x) for x in ("hot", "warm", "cold")])
    actions = t.traces().select(
        F.pmod("trace_id", F.lit(300)).alias("doc_id"),
        F.get(names, F.pmod("k", F.lit(4))).alias("action"),
        F.get(tiers, F.pmod("k", F.lit(3))).alias("tier"),
        (F.pmod("k", F.lit(25)) / 10).alias("authority"),
        F.col("trace_id").alias("ts"),
    )
    return corpus.apply_document_actions(t.docs(), actions).select("doc_id", "status", "tier", F.round("authority", 4).alias("authority"))


@query(
    "c12_remove",
    o.with_views(
        "chunks_v",
        """SELECT 'chunk' AS what, c.kb_id, count(*) AS n FROM chunks_v c JOIN docs_v d USING (doc_id) WHERE d.source_id NOT IN ('src1', 'src7') GROUP BY 2
        UNION ALL SELECT 'document', kb_id, count(*) FROM docs_v WHERE source_id NOT IN ('src1', 'src7') GROUP BY 2""",
    ),
)
def _(t):
    removals = t.documents.where(F.col("source").isin("src1", "src7")).select(F.col("source").alias("source_id"))
    docs, chunks = corpus.remove(t.docs(), t.chunks(), removals, "source_id")
    n = F.count(F.lit(1)).alias("n")
    c = chunks.groupBy(F.lit("chunk").alias("what"), "kb_id").agg(n)
    return c.unionByName(docs.groupBy(F.lit("document").alias("what"), "kb_id").agg(n))
