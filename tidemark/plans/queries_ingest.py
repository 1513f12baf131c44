"""Catalog: reading, parsing, chunking and enriching every document and page."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import corpus, parsing
from ..session import shared_folder
from ..sources import files
from . import oracle as o
from .catalog import query
from .tables import as_of


def _pages(t):
    kinds = F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "", "text/plain", "application/pdf")])
    kind = F.get(kinds, F.pmod("page_id", F.lit(4)).cast("int"))
    return files.fetched_pages(t.pages, kind)


@query(
    "a3_fetched_pages",
    """WITH p AS (SELECT page_id, page_id % 4 AS k, CASE WHEN b = '' THEN 'index.html' ELSE b END AS n FROM (
      SELECT page_id, regexp_extract(rtrim(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/'), '([^/]*)$', 1) AS b FROM pages))
    SELECT page_id, n || x AS name, CASE WHEN x = '.pdf' THEN 'application/pdf' WHEN x = '.txt' THEN 'text/plain' ELSE 'text/html' END AS mime
    FROM (SELECT *, CASE WHEN k = 3 THEN '.pdf' WHEN regexp_matches(n, '\\.(html|htm|md|txt|pdf|docx|markdown)$') THEN '' WHEN k = 2 THEN '.txt' ELSE '.html' END AS x FROM p)""",
)
def _(t):
    return _pages(t).select("page_id", "name", "mime")


def _text_files(t):
    """All documents written as text files; returns their folder."""
    path = f"{shared_folder(t.spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    t.documents.select("text").write.text(path)
    return path


@query("a1_list_files", "SELECT sum(strlen(text) + 1)::BIGINT AS bytes, 'text/plain' AS mime FROM documents")
def _(t):
    listed = files.list_files(t.spark, _text_files(t))
    return listed.groupBy("mime").agg(F.sum("length").alias("bytes"))


@query("a2_size_cap", "SELECT sum(strlen(text) + 1)::BIGINT AS bytes, true AS listed_unread, true AS others_whole FROM documents")
def _(t):
    listed = files.list_files(t.spark, _text_files(t), max_bytes=100_000)
    over = F.col("length") > 100_000
    return listed.agg(
        F.sum("length").alias("bytes"),
        F.bool_and(~over | (F.col("error").isNotNull() & F.col("content").isNull())).alias("listed_unread"),
        F.bool_and(over | (F.col("error").isNull() & (F.octet_length("content") == F.col("length")))).alias("others_whole"),
    )


def _as_files(t):
    """Documents as text files, their lines as paragraphs, and pages as HTML files."""
    doc = t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("content"),
    )
    page = files.fetched_pages(t.pages).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), "name", "content")
    return doc.unionByName(page).withColumn("mime", parsing.mime_of(F.col("name")))


@query("b1_parse")
def _(t):
    p = parsing.parse_documents(_as_files(t))
    return p.select("doc_id", "mime", "title", F.size("blocks").alias("n_blocks"), "parse_error")


@query("b2_decode")
def _(t):
    from ..functions.arrow import decode

    codings = [F.encode("text", "UTF-8"), F.encode("text", "UTF-16"), F.encode("text", "ISO-8859-1")]
    coded = F.get(F.array(*codings), F.pmod("doc_id", F.lit(3)).cast("int"))
    return t.documents.select("doc_id", (decode(coded) == F.col("text")).alias("same"))


@query("b3_html_blocks")
def _(t):
    p = t.pages.select("page_id", parsing.parse_html(F.col("html")).alias("p"))
    return parsing.explode_blocks(p.select("page_id", F.col("p.blocks").alias("blocks")), "page_id")


@query("b4_markdown_blocks")
def _(t):
    marked = F.concat(F.lit("# Document\n\n- "), F.replace("text", F.lit("\n"), F.lit("\n\n## Part\n\n")))
    p = t.documents.select("doc_id", parsing.parse_markdown(marked).alias("p"))
    return parsing.explode_blocks(p.select("doc_id", F.col("p.blocks").alias("blocks")))


_PARA = r"""paras AS (SELECT doc_id, unnest(range(len(ps))) AS n, trim(unnest(ps), ' ' || chr(9)) AS s
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p, ' ' || chr(9)) <> '') AS ps FROM documents)),
lv AS (SELECT *, CASE WHEN length(s) > 90 OR (regexp_matches(s, '[.,;:]$') AND NOT num) OR len(w) > 12 THEN 0
   WHEN num THEN least(1 + length(w[1]) - length(replace(w[1], '.', '')), 4)
   WHEN upper(s) = s AND lower(s) <> upper(s) AND length(s) > 3 THEN 1
   WHEN len(w) <= 8 AND len(list_filter(w, lambda x: upper(x[1]) = x[1] AND lower(x[1]) <> x[1])) >= greatest(1, floor(len(w) * 0.7)) AND NOT s LIKE '%?' THEN 2
   ELSE 0 END AS level
  FROM (SELECT *, regexp_matches(s, '^(\d+(\.\d+)*\.?|[IVX]+\.|Chapter \d+|Section \d+)\s+\S') AS num, regexp_split_to_array(s, '\s+') AS w FROM paras)),
bl AS (SELECT doc_id, n, level, CASE WHEN level > 0 THEN 'heading' WHEN regexp_matches(s, '^([-*•]|\d+[.)])\s+') THEN 'list' ELSE 'para' END AS kind,
  CASE WHEN level > 0 OR regexp_matches(s, '^([-*•]|\d+[.)])\s+') THEN s ELSE regexp_replace(s, '([\p{L}\p{N}_])- ([\p{L}\p{N}_])', '\1\2', 'g') END AS text FROM lv)"""


def _text_blocks(t):
    paras = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t.documents.select("doc_id", parsing.text_blocks(paras).alias("blocks"))


@query("b5_text_blocks", f"WITH {_PARA} SELECT doc_id, n AS pos, kind, text, level::BIGINT AS level FROM bl")
def _(t):
    rows = parsing.explode_blocks(_text_blocks(t))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "text", F.col("level").cast("long").alias("level"))


@query(
    "b6_title",
    f"WITH {_PARA} SELECT d.doc_id, coalesce((SELECT arg_min(text, n) FROM bl WHERE bl.doc_id = d.doc_id AND kind = 'heading'), 'doc ' || d.doc_id) AS title FROM documents d",
)
def _(t):
    stem = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return _text_blocks(t).select("doc_id", parsing.block_title(F.lit(""), F.col("blocks"), stem).alias("title"))


@query("b7_chunks")
def _(t):
    return parsing.chunk_documents(parsing.parse_documents(_as_files(t)))


@query("b8_b10_large_chunks")
def _(t):
    one = t.documents.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.array(F.struct(F.lit("table").alias("kind"), F.col("text"), F.lit(0).alias("level"), F.lit(1).alias("page"))).alias("blocks"),
    )
    return parsing.chunk_documents(one, fixed.LARGE_STRATEGY)


@query("b9_overlap_chunks")
def _(t):
    sents = F.transform(
        text.sentences(F.col("text")),
        lambda s: F.struct(F.lit("para").alias("kind"), s.alias("text"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("page")),
    )
    rows = t.documents.select("doc_id", F.lit("t").alias("title"), sents.alias("blocks"))
    small = fixed.ChunkStrategy("small", 100, 160, 24, 30)
    return parsing.chunk_documents(rows, small)


@query(
    "b11_context",
    o.with_views(
        "chunks_v",
        f"""w AS (SELECT chunk_id, i, t FROM (SELECT chunk_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT chunk_id, {o.tokens('text')} AS ts FROM chunks_v)) WHERE length(t) > 3),
        c AS (SELECT chunk_id, t, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(i)) AS nth FROM w GROUP BY 1, 2),
        p AS (SELECT chunk_id, string_agg(t, ', ' ORDER BY nth) AS topics FROM c WHERE nth <= 6 GROUP BY 1)
        SELECT chunk_id, 'From ''' || title || '''' || CASE WHEN h <> '' THEN ', section ''' || h || '''' ELSE '' END || '. Topics: ' || coalesce(topics, '') || '.' AS context
        FROM (SELECT *, trim(regexp_extract(text, '^#[# ]*(.*)$', 1)) AS h FROM chunks_v) LEFT JOIN p USING (chunk_id)""",
    ),
)
def _(t):
    return parsing.add_context(t.chunks()).select("chunk_id", "context")


@query("b12_acronyms")
def _(t):
    from ..functions.acronyms import acronyms

    said = F.concat("text", F.lit(" The Global Nation Office (GNO) and Single Sign-On (SSO) apply."))
    rows = t.documents.select("doc_id", F.col("text"), acronyms(said).alias("pairs"))
    return rows.select("doc_id", parsing.chunk_aliases(F.concat("text", F.lit(" sso gno")), F.col("pairs")).alias("aliases"))


@query(
    "b13_embedding_text",
    o.with_views("chunks_v", "SELECT chunk_id, sha256('From ''' || title || ''', section ''' || section_path || '''.' || chr(10) || chr(10) || text) AS said FROM chunks_v"),
)
def _(t):
    said = corpus.embedding_text(F.col("title"), F.col("section_path"), F.col("context"), F.col("text"))
    return t.chunks().select("chunk_id", F.sha2(said, 256).alias("said"))


@query("b14_hash_embedding")
def _(t):
    return parsing.add_embedding(t.chunks()).select("chunk_id", "embedding", "embedding_model")


@query(
    "b15_quality",
    """WITH q AS (SELECT doc_id, round(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text), 3) AS pq,
        round(1.0::DOUBLE / (1 + greatest(0, epoch(TIMESTAMP '2024-01-31') - epoch(TIMESTAMP '2024-01-01' + to_hours(doc_id))) / 86400.0::DOUBLE / 180), 3) AS fresh,
        doc_id % 2 AS headings FROM documents)
    SELECT doc_id, pq AS parse_quality, fresh AS freshness, round((0.5 * least(1.0, pq / 0.7) + 0.3 * fresh + 0.2 * CASE WHEN headings > 0 THEN 1.0 ELSE 0.6 END)::VARCHAR::DECIMAL(30, 20), 3)::DOUBLE AS score FROM q""",
)
def _(t):
    q = parsing.quality_signals(F.col("text"), F.pmod("doc_id", F.lit(2)), F.col("modified_at"), as_of())
    rows = t.docs().select("doc_id", q.alias("q"))
    return rows.select("doc_id", "q.parse_quality", "q.freshness", "q.score")


@query(
    "b16_flags",
    o.with_views("chunks_v", "SELECT doc_id, count(*) FILTER (doc_id % 97 = 0) AS injection_chunks FROM chunks_v GROUP BY 1"),
)
def _(t):
    return parsing.flagged_per_document(t.marked_chunks())


@query(
    "b17_reembed",
    o.with_views("chunks_v", "SELECT chunk_id, 'hash:hash-64' AS embedding_model, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 64 END AS dims FROM chunks_v"),
)
def _(t):
    old = t.chunks().withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")).withColumn(
        "embedding_model", F.when(F.pmod("doc_id", F.lit(2)) == 0, "hash:hash-64").otherwise("hash:old")
    )
    done = corpus.reembed_outdated(old, "hash:hash-64", 64)
    return done.select("chunk_id", "embedding_model", F.size("embedding").alias("dims"))
