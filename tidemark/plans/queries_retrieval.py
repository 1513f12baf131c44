"""Catalog: index, retrievers, fusion and ranking over every chunk of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import block_index, ranking, search, vector_index
from ..session import cut_lineage, new_folder
from . import oracle as o
from .catalog import query


def long(c):
    return F.col(c).cast("long")


@query(
    "a4_live_chunks",
    o.with_views(
        "chunks_v",
        """SELECT c.chunk_id, c.kb_id, c.ord::BIGINT AS ord, d.title, c.token_count::BIGINT AS token_count
        FROM chunks_v c JOIN docs_v d USING (doc_id)""",
    ),
)
def _(t):
    live = search.live_chunks(t.chunks().drop("title"), t.docs())
    return live.select("chunk_id", "kb_id", long("ord").alias("ord"), "title", long("token_count").alias("token_count"))


@query(
    "e1_visibility",
    o.with_views(
        "chunks_v",
        """s AS (SELECT doc_id FROM labels WHERE quality = 0),
        v AS (SELECT chunk_id, doc_id, 'active' AS status FROM chunks_v
              UNION ALL SELECT 's' || chunk_id, doc_id, 'staged' FROM chunks_v)
        SELECT chunk_id, status FROM v WHERE status = CASE WHEN doc_id IN (SELECT doc_id FROM s) THEN 'staged' ELSE 'active' END
        """,
    ),
)
def _(t):
    active = t.chunks().select("chunk_id", "doc_id", "status")
    staged = active.select(F.concat(F.lit("s"), "chunk_id").alias("chunk_id"), "doc_id", F.lit("staged").alias("status"))
    under_test = t.labels.where(F.col("quality") == 0).select("doc_id")
    return search.version_visible(active.unionByName(staged), under_test).select("chunk_id", "status")


@query(
    "e2_access_lists",
    o.with_views(
        "chunks_v",
        """SELECT kb_id, count(*) FILTER (staff_only) AS hidden, count(*) FILTER (NOT staff_only) AS shown,
        count(*) AS shown_to_staff FROM chunks_v JOIN docs_v USING (kb_id, doc_id) GROUP BY 1""",
    ),
)
def _(t):
    acl = t.docs().select("kb_id", "doc_id", "acl")
    public, staff = search.readable(F.col("acl"), []), search.readable(F.col("acl"), ["staff"])
    return (
        t.chunks().join(acl, ["kb_id", "doc_id"]).groupBy("kb_id")
        .agg(F.count_if(~public).alias("hidden"), F.count_if(public).alias("shown"), F.count_if(staff).alias("shown_to_staff"))
    )


@query("e3_tier_masks", o.with_views("masked_v", "SELECT chunk_id, allowed, escalated FROM masked_v"))
def _(t):
    return t.masked_chunks().select("chunk_id", "allowed", "escalated")


@query(
    "e4_postings",
    o.with_views("lens_v", "SELECT chunk_id, term, tf, doc_len FROM tf_v JOIN lens_v USING (chunk_id)"),
)
def _(t):
    return search.postings(t.masked_chunks()).select("chunk_id", "term", "tf", long("doc_len").alias("doc_len"))


@query(
    "e4_maintained_index",
    o.with_views("lens_v", "SELECT chunk_id, term, tf, doc_len, tf_v.allowed FROM tf_v JOIN lens_v USING (chunk_id)"),
)
def _(t):
    """The index of an older corpus (some documents with other texts, some not there yet), brought up to date by document."""
    now = t.masked_chunks()
    other, absent = F.pmod("doc_id", F.lit(3)) == 0, F.pmod("doc_id", F.lit(5)) == 0
    before = now.where(~absent).withColumn("text", F.when(other, F.reverse("text")).otherwise(F.col("text")))
    index = block_index.build(before, new_folder(t.spark, "index"))
    block_index.replace(index, now.where(other | absent))
    return index.postings().select("chunk_id", "term", "tf", long("doc_len").alias("doc_len"), "allowed")


def _aliases(t):
    """Every long word of the corpus as a phrase with two expansions."""
    return t.documents.select(F.explode(text.words(F.col("text"))).alias("w")).where(F.length("w") > 6).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w").alias("phrase"), F.array(F.reverse("w"), F.concat(F.lit("about "), "w")).alias("expansions"))


_SUBQ = """subq_v AS (SELECT item_id AS query_id, 0 AS subq, text AS question FROM benchmark)"""
_PARTS = f"""subq_v AS (SELECT item_id AS query_id, unnest(range(len(s))) AS subq, unnest(s) AS question
  FROM (SELECT item_id, {o.sentences('text')} AS s FROM benchmark))"""


@query(
    "e5_query_terms",
    f"""WITH {_PARTS},
    own AS (SELECT DISTINCT query_id, subq, t FROM (SELECT query_id, subq, unnest({o.tokens('question')}) AS t FROM subq_v)),
    ph AS (SELECT DISTINCT w FROM (SELECT unnest({o.words('text')}) AS w FROM documents) WHERE length(w) > 6),
    qw AS (SELECT DISTINCT query_id, subq, unnest(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM subq_v),
    ex AS (SELECT DISTINCT query_id, subq, unnest({o.tokens("reverse(w) || ' about ' || w")}) AS t FROM qw JOIN ph USING (w)),
    al AS (SELECT query_id, subq, t FROM ex)
    SELECT query_id, subq::BIGINT AS subq, t AS term, 1.0::DOUBLE AS weight FROM own
    UNION ALL SELECT query_id, subq, t, 0.7::DOUBLE FROM al WHERE (query_id, subq, t) NOT IN (SELECT query_id, subq, t FROM own)""",
)
def _(t):
    found = search.query_terms(t.parts(), _aliases(t).where(~F.col("phrase").rlike("[^a-z0-9]")))
    return found.select("query_id", long("subq").alias("subq"), "term", "weight")


_BM25 = """
qt AS (SELECT DISTINCT query_id, subq, t AS term FROM (SELECT query_id, subq, unnest(%(tok)s) AS t FROM subq_v)),
st AS (SELECT count(*) FILTER (%(mask)s) AS n, avg(doc_len) AS avg_len FROM lens_v),
dfs AS (SELECT term, count(*) AS df FROM tf_v WHERE %(mask)s GROUP BY 1),
sc AS (SELECT query_id, subq, chunk_id,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score
       FROM qt JOIN tf_v USING (term) JOIN dfs USING (term) JOIN lens_v l USING (chunk_id), st
       WHERE tf_v.%(mask)s GROUP BY 1, 2, 3),
hits_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, subq ORDER BY round(score, 6) DESC, chunk_id) - 1 AS rank FROM sc)
       WHERE rank < %(k)s)"""


def bm25_sql(subq: str, k: int, mask: str, rest: str) -> str:
    body = _BM25 % {"tok": o.tokens("question"), "mask": mask, "k": k}
    return o.with_views("lens_v", f"{subq},{body}{rest}")


def bm25_hits(t, subqueries, k, mask="allowed"):
    chunks = t.masked_chunks()
    terms = cut_lineage(search.query_terms(subqueries), "terms")
    index = t.stored("posting_blocks", lambda: search.posting_blocks(search.tokenised(chunks), chunks.count()))
    return search.bm25_search(terms, index, search.block_lengths(index), mask, k)


@query(
    "e6_bm25_topk",
    bm25_sql(_SUBQ, 5, "allowed", " SELECT query_id AS item_id, rank + 1 AS rank, chunk_id, round(score, 4) AS score FROM hits_v"),
)
def _(t):
    return bm25_hits(t, t.subqueries(), 5).select(
        F.col("query_id").alias("item_id"), (long("rank") + 1).alias("rank"), "chunk_id", F.round("score", 4).alias("score")
    )


@query(
    "e6_block_topk",
    bm25_sql(_PARTS, 5, "allowed", " SELECT query_id, subq::BIGINT AS subq, rank, chunk_id, round(score, 4) AS score FROM hits_v"),
)
def _(t):
    index = block_index.build(t.masked_chunks(), new_folder(t.spark, "index"))
    return _hits(block_index.bm25_search(search.query_terms(t.parts()), index, "allowed", 5))


@query(
    "e7_dense_topk",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
        list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b)
    SELECT query_id, rank::BIGINT AS rank, chunk_id, round(score, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) - 1 AS rank FROM s)
    WHERE rank < 5""",
)
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit("given").alias("model"), F.col("embedding").alias("vector"))
    asked = v.select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("subq"), F.lit(0).alias("variant"), "model", "vector")
    hits = vector_index.dense_search(asked, v, k=5, exact=True)
    return hits.select("query_id", long("rank").alias("rank"), "chunk_id", F.round("score", 4).alias("score"))


_EXACT = f"""{_PARTS},
kw AS (SELECT query_id, subq, list_distinct(k)  AS k FROM (SELECT query_id, subq, %s AS k FROM subq_v) WHERE len(k) > 0),
pw AS (SELECT query_id, subq, len(k) AS asked, unnest(k) AS p FROM kw),
hw AS (SELECT DISTINCT chunk_id, unnest(regexp_split_to_array(lower(title || chr(10) || section_path || chr(10) || text), '[^\\p{{L}}\\p{{N}}_]+')) AS p
       FROM masked_v WHERE allowed),
ht AS (SELECT query_id, subq, chunk_id, asked, count(*) AS hits FROM pw JOIN hw USING (p) GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, subq ORDER BY round(hits::DOUBLE / asked, 6) DESC, chunk_id) - 1 AS rank FROM ht %s)
SELECT query_id, subq::BIGINT AS subq, chunk_id, rank, round(hits::DOUBLE / asked, 4) AS score FROM rk WHERE rank < 150"""
_KW = f"list_filter({o.words('question')}, lambda w: length(w) > 3 AND NOT contains(w, '-') AND NOT contains(w, '.'))"


def _simple(words):
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.contains("-") & ~w.contains("."))


def _hits(df):
    return df.select("query_id", long("subq").alias("subq"), "chunk_id", long("rank").alias("rank"), F.round("score", 4).alias("score"))


@query("e8_exact_match", o.with_views("masked_v", _EXACT % (_KW, "")))
def _(t):
    asked = t.parts().withColumn("identifiers", _simple(text.words(F.col("question"))))
    return _hits(search.exact_search(search.identifier_patterns(asked), t.masked_chunks()))


@query("e9_broad_exact", o.with_views("masked_v", _EXACT % (_KW, "WHERE hits = asked")))
def _(t):
    asked = t.parts().withColumn("keywords", _simple(text.words(F.col("question"))))
    return _hits(search.exact_search(search.broad_patterns(asked), t.masked_chunks(), require_all=True))


# ------------------------------------------------------------------ the ranking cascade

_CASCADE = f""",
fused_v AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS fused, list_sort(list(DISTINCT subq)) AS subqs,
              min(rank) AS bm25_rank FROM hits_v GROUP BY 1, 2),
prior_v AS (SELECT f.*, m.doc_id, m.title, m.section_path, m.text, d.status AS doc_status, d.freshness,
              fused / max(fused) OVER (PARTITION BY query_id) * (1 + 0.15 * (d.quality - 0.5) * 2) * (0.75 + 0.25 * least(d.authority, 2.0))
              * CASE WHEN good + bad > 0 THEN 1 + 0.2 * (good - bad) / (good + bad + 5) ELSE 1 END AS stage1
            FROM fused_v f JOIN masked_v m USING (chunk_id) JOIN docs_v d ON d.doc_id = m.doc_id
            LEFT JOIN (SELECT doc_id || '-0' AS chunk_id, quality * 3.0::DOUBLE AS good, toxic * 2.0::DOUBLE AS bad FROM labels) s USING (chunk_id)),
pos_v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(stage1, 6) DESC, chunk_id) AS position FROM prior_v),
nq_v AS (SELECT query_id, count(*) AS n FROM subq_v GROUP BY 1),
ex_v AS (SELECT query_id, chunk_id, position, unnest(subqs) AS subq, title || ' | ' || section_path || chr(10) || chr(10) || text AS body
         FROM pos_v WHERE position <= 50),
nth_v AS (SELECT e.*, row_number() OVER (PARTITION BY query_id, subq ORDER BY position) AS nth, greatest(10, 50 // n) AS per
          FROM ex_v e JOIN nq_v USING (query_id)),
rr_v AS (SELECT query_id, chunk_id, max({o.overlap('qt', 'bt')}) AS rerank FROM (
           SELECT n.query_id, n.chunk_id, {o.content_terms('s.question')} AS qt, {o.content_terms('n.body')} AS bt
           FROM nth_v n JOIN subq_v s USING (query_id, subq) WHERE nth <= per) GROUP BY 1, 2),
final_v AS (SELECT p.*, rerank, 0.8 * coalesce(rerank, 0) + 0.2 * stage1 / max(stage1) OVER (PARTITION BY query_id) AS final0
            FROM pos_v p LEFT JOIN rr_v USING (query_id, chunk_id) WHERE position <= 50),
need_v AS (SELECT query_id, CASE WHEN n >= 3 THEN 0.8 ELSE 0.1 END AS need FROM nq_v),
ruled_v AS (SELECT f.*, final0 * CASE WHEN doc_status = 'quarantined' THEN 0.5 ELSE 1 END
              * CASE WHEN l.quality = 1 THEN 1.1 ELSE 1 END * CASE WHEN need >= 0.5 THEN 1 + 0.1 * freshness ELSE 1 END AS final,
              (CASE WHEN doc_status = 'quarantined' THEN 1 ELSE 0 END + CASE WHEN l.quality = 1 THEN 1 ELSE 0 END
              + CASE WHEN need >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_rules
            FROM final_v f JOIN need_v USING (query_id) LEFT JOIN labels l ON l.doc_id = f.doc_id)"""


def cascade_sql(rest: str) -> str:
    return bm25_sql(_PARTS, 150, "escalated", _CASCADE + rest)


def sentence_hits(t):
    """The hits of all benchmark sentences; one search serves all queries of a session that read them."""
    return t.stored("hits", lambda: bm25_hits(t, t.parts(), 150, "escalated"))


def hit_chunks(t):
    """The chunks that :func:`sentence_hits` name, looked up once: every stage after the search reads these alone."""
    return t.stored("hit_chunks", lambda: t.masked_chunks(hits=sentence_hits(t)))


class Cascade:
    """The stages over all benchmark sentences, each a DataFrame."""

    def __init__(self, t):
        self.t = t
        self.docs = t.docs()
        n = t.parts().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        self.need = n.select("query_id", F.when(F.col("n") >= 3, 0.8).otherwise(0.1).alias("freshness_need"))
        self.subqueries = t.parts()
        self.hits = sentence_hits(t)
        self.signals = t.labels.select(
            F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("chunk_id"),
            (F.col("quality") * 3.0).alias("good"),
            (F.col("toxic") * 2.0).alias("bad"),
        )
        self.boosts = t.labels.where(F.col("quality") == 1).select("doc_id", F.lit(1.1).alias("factor"))

    def fused(self):
        return ranking.fuse(self.hits)

    def priors(self):
        body = hit_chunks(self.t).select("chunk_id", "doc_id", "ord", "status", "title", "section_path", "context", "text", "flags")
        return ranking.add_priors(self.fused().join(body, "chunk_id"), self.docs, self.signals)

    def stage1(self):
        return ranking.stage1_cut(self.priors())

    def reranked(self):
        return ranking.lexical_rerank(self.stage1().where("in_stage1"), self.subqueries)

    def final(self):
        return ranking.final_score(self.reranked())

    def ruled(self):
        return ranking.apply_rules(self.final().join(self.need, "query_id"), self.docs, self.boosts)


@query(
    "e10_fusion",
    cascade_sql(" SELECT query_id, chunk_id, round(fused, 4) AS fused, array_to_string(subqs, ',') AS subqs, bm25_rank FROM fused_v"),
)
def _(t):
    f = Cascade(t).fused()
    return f.select(
        "query_id", "chunk_id", F.round("fused", 4).alias("fused"),
        F.array_join(F.transform("subqs", lambda s: s.cast("string")), ",").alias("subqs"), long("bm25_rank").alias("bm25_rank"),
    )


@query("e11_priors", cascade_sql(" SELECT query_id, chunk_id, round(stage1, 12) AS stage1 FROM prior_v"))
def _(t):
    return Cascade(t).priors().select("query_id", "chunk_id", F.round("stage1", 12).alias("stage1"))


@query(
    "e12_stage1_cut",
    cascade_sql(" SELECT query_id, chunk_id, position, position <= 50 AS in_stage1 FROM pos_v"),
)
def _(t):
    return Cascade(t).stage1().select("query_id", "chunk_id", long("position").alias("position"), "in_stage1")


@query("e13_rerank", cascade_sql(" SELECT query_id, chunk_id, round(rerank, 4) AS rerank FROM final_v"))
def _(t):
    return Cascade(t).reranked().select("query_id", "chunk_id", F.round("rerank", 4).alias("rerank"))


@query("e14_final_score", cascade_sql(" SELECT query_id, chunk_id, round(final0, 4) AS final FROM final_v"))
def _(t):
    return Cascade(t).final().select("query_id", "chunk_id", F.round("final", 4).alias("final"))


@query("e15_rules", cascade_sql(" SELECT query_id, chunk_id, round(final, 4) AS final, n_rules FROM ruled_v"))
def _(t):
    ruled = Cascade(t).ruled()
    return ruled.select("query_id", "chunk_id", F.round("final", 4).alias("final"), F.size("rules").cast("long").alias("n_rules"))


@query("e16_near_copies")
def _(t):
    return ranking.drop_near_copies(Cascade(t).ruled()).select("query_id", "chunk_id", "duplicate_of", "subqs")


@query(
    "e17_document_cap",
    cascade_sql(""" SELECT query_id, chunk_id, doc_id,
      row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(final, 6) DESC, chunk_id) > 6 AS over_cap FROM ruled_v"""),
)
def _(t):
    return ranking.cap_per_document(Cascade(t).ruled()).select("query_id", "chunk_id", "doc_id", "over_cap")


@query(
    "e18_selection",
    cascade_sql(""",
    g_v AS (SELECT DISTINCT query_id, chunk_id FROM (
      SELECT query_id, chunk_id, subq, row_number() OVER (PARTITION BY query_id, subq ORDER BY round(final, 6) DESC, chunk_id) AS nth
      FROM (SELECT query_id, chunk_id, final, unnest(subqs) AS subq FROM ruled_v)) JOIN nq_v USING (query_id)
      WHERE n > 1 AND nth <= greatest(2, 20 // (2 * n))),
    slot_v AS (SELECT r.query_id, r.chunk_id, r.final, g.chunk_id IS NOT NULL AS guaranteed,
        row_number() OVER (PARTITION BY r.query_id ORDER BY g.chunk_id IS NULL, round(final, 6) DESC, r.chunk_id) AS slot
        FROM ruled_v r LEFT JOIN g_v g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id)
    SELECT query_id, chunk_id, guaranteed, final_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 6) DESC, chunk_id) AS final_rank
      FROM slot_v WHERE guaranteed OR slot <= 20) WHERE final_rank <= 20"""),
)
def _(t):
    c = Cascade(t)
    chosen = ranking.select_final(c.ruled(), c.subqueries)
    return chosen.select("query_id", "chunk_id", "guaranteed", long("final_rank").alias("final_rank"))


@query(
    "e19_exclude_seen",
    cascade_sql(""" SELECT query_id, chunk_id, round(fused, 4) AS fused FROM fused_v
      WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM hits_v WHERE rank < 10)"""),
)
def _(t):
    c = Cascade(t)
    left = ranking.exclude_seen(c.fused(), c.hits.where(F.col("rank") < 10))
    return left.select("query_id", "chunk_id", F.round("fused", 4).alias("fused"))


@query(
    "e20_neighbours",
    bm25_sql(_SUBQ, 5, "allowed", """ SELECT h.query_id, h.chunk_id AS near, n.chunk_id, n.ord::BIGINT AS ord FROM hits_v h
      JOIN masked_v m ON m.chunk_id = h.chunk_id JOIN masked_v n ON n.doc_id = m.doc_id
      WHERE n.escalated AND abs(n.ord - m.ord) BETWEEN 1 AND 2"""),
)
def _(t):
    chunks = t.masked_chunks()
    found = bm25_hits(t, t.subqueries(), 5).join(chunks.select("chunk_id", "doc_id", "status", "ord"), "chunk_id")
    return search.neighbours(found, chunks, radius=2).withColumn("ord", long("ord"))


@query(
    "e21_rank_counts",
    cascade_sql(""" SELECT query_id, count(*) AS fused, least(count(*), 50) AS stage1,
       least(count(*) FILTER (rank0 <= 20), 20) AS final FROM (
       SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank0 FROM fused_v) GROUP BY 1"""),
)
def _(t):
    c = Cascade(t)
    chosen = ranking.select_final(c.ruled(), c.subqueries)
    counts = ranking.rank_counts(c.fused(), chosen)
    return counts.select("query_id", "fused", F.col("stage1").cast("long").alias("stage1"), "final")
