"""Catalog: text and vector functions, over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text, vectors
from . import oracle as o
from .catalog import query


def joined(array, sep="|"):
    return F.array_join(array, sep)


@query(
    "d1_tokenize",
    f"SELECT doc_id, array_to_string({o.tokens('text')}, '|') AS toks, len({o.tokens('text', True)}) AS n_all FROM documents",
)
def _(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", joined(text.tokens(c)).alias("toks"), F.size(text.tokens(c, True)).cast("long").alias("n_all")
    )


@query(
    "d2_stem",
    f"""SELECT w AS word, {o.stem('w')} AS stem, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(lower(text), {o.q(fixed.TOKEN)})) AS w FROM documents) GROUP BY 1, 2""",
)
def _(t):
    w = t.documents.select(F.explode(text.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", text.stem(F.col("word")))


@query(
    "d3_content_terms",
    f"SELECT doc_id, array_to_string(list_sort({o.content_terms('text')}), '|') AS terms FROM documents",
)
def _(t):
    return t.documents.select("doc_id", joined(F.sort_array(text.content_terms(F.col("text")))).alias("terms"))


@query("d4_sentences", f"SELECT doc_id, array_to_string({o.sentences('text')}, '|') AS sents FROM documents")
def _(t):
    return t.documents.select("doc_id", joined(text.sentences(F.col("text"))).alias("sents"))


_IDENT = f"list_filter(list_transform(regexp_extract_all(text, {o.q(fixed.QUOTED_OR_CODE)}), lambda s: trim(s, '\"')), lambda s: s <> '')"


@query("d5_identifiers", f"SELECT doc_id, array_to_string(list_sort(list_distinct({_IDENT})), '|') AS idents FROM documents")
def _(t):
    found = text.identifiers(F.col("text"), ascii_only=True)
    return t.documents.select("doc_id", joined(F.sort_array(found)).alias("idents"))


_TURN_PAIRS = f"""
p AS (SELECT a.session_id, a.turn, {o.content_terms('a.query')} AS x, {o.content_terms('b.query')} AS y
      FROM turns_v a JOIN turns_v b ON a.session_id = b.session_id AND b.turn = a.turn + 2)"""


def _turn_pairs(t):
    a = t.turns().select("session_id", "turn", text.content_terms(F.col("query")).alias("x"))
    b = t.turns().select("session_id", (F.col("turn") - 2).alias("turn"), text.content_terms(F.col("query")).alias("y"))
    return a.join(b, ["session_id", "turn"])


@query(
    "d6_jaccard",
    o.with_views(
        "turns_v",
        _TURN_PAIRS
        + """ SELECT session_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE
        round(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))), 4) END AS jaccard FROM p""",
    ),
)
def _(t):
    return _turn_pairs(t).select("session_id", "turn", F.round(text.jaccard(F.col("x"), F.col("y")), 4).alias("jaccard"))


@query(
    "d7_overlap",
    o.with_views("turns_v", _TURN_PAIRS + f" SELECT session_id, turn, round({o.overlap('x', 'y')}, 4) AS share FROM p"),
)
def _(t):
    return _turn_pairs(t).select("session_id", "turn", F.round(text.overlap(F.col("x"), F.col("y")), 4).alias("share"))


_SH = f"SELECT doc_id, {o.tokens('text', True)} AS k FROM documents"


@query(
    "d8_shingles",
    f"""SELECT doc_id, count(DISTINCT s) AS n, min(s) AS first_one, max(s) AS last_one FROM (
      SELECT doc_id, unnest(CASE WHEN len(k) < 5 THEN [array_to_string(k, ' ')] ELSE
        list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i+4], ' ')) END) AS s
      FROM ({_SH}) WHERE len(k) > 0) GROUP BY 1""",
)
def _(t):
    sh = text.once(t.documents.select("doc_id", "text"), s=text.shingles(F.col("text"))).where(F.size("s") > 0)
    return sh.select(
        "doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first_one"), F.array_max("s").alias("last_one")
    )


@query("d9_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS est FROM documents")
def _(t):
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("est"))


@query("d10_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("hash"))


_NUMS = f"list_distinct(list_transform(regexp_extract_all(text, {o.q(fixed.NUMBER)}), lambda n: replace(n, ',', '')))"


@query("d11_numbers", f"SELECT doc_id, array_to_string(list_sort({_NUMS}), '|') AS nums FROM documents")
def _(t):
    nums = text.numbers(F.col("text"), ascii_only=True)
    return t.documents.select("doc_id", joined(F.sort_array(nums)).alias("nums"))


_RAW = f"list_filter(regexp_extract_all(lower(%s), {o.q(fixed.RAW_WORD)}), lambda w: w NOT IN ({o.STOP}) AND length(w) > 2)"
_PAIR = """
p AS (SELECT a.session_id, a.turn, a.query AS x, b.query AS y
      FROM turns_v a JOIN turns_v b ON a.session_id = b.session_id AND b.turn = a.turn + 2)"""


@query(
    "d12_missing_words",
    o.with_views(
        "turns_v",
        _PAIR
        + f""", r AS (SELECT session_id, turn, {_RAW % 'x'} AS xw, {_RAW % 'y'} AS yw,
             {o.tokens('x')} AS xt, {o.tokens('y')} AS yt FROM p),
        m AS (SELECT session_id, turn, w FROM (SELECT session_id, turn, yt, unnest(xw) AS w FROM r)
              WHERE NOT list_contains(yt, {o.stem('w')})),
        h AS (SELECT session_id, turn, w FROM (SELECT session_id, turn, xt, unnest(yw) AS w FROM r)
              WHERE list_contains(xt, {o.stem('w')}))
        SELECT r.session_id, r.turn,
          coalesce((SELECT string_agg(DISTINCT w, '|' ORDER BY w) FROM m WHERE m.session_id = r.session_id AND m.turn = r.turn), '') AS missing,
          coalesce((SELECT string_agg(DISTINCT w, '|' ORDER BY w) FROM h WHERE h.session_id = r.session_id AND h.turn = r.turn), '') AS present
        FROM r""",
    ),
)
def _(t):
    a = t.turns().select("session_id", "turn", F.col("query").alias("x"))
    b = t.turns().select("session_id", (F.col("turn") - 2).alias("turn"), F.col("query").alias("y"))
    none = F.array().cast("array<string>")
    return a.join(b, ["session_id", "turn"]).select(
        "session_id",
        "turn",
        joined(F.sort_array(text.missing_words(F.col("x"), text.tokens(F.col("y"))))).alias("missing"),
        joined(F.sort_array(text.present_words(F.array("y"), text.tokens(F.col("x")), none))).alias("present"),
    )


@query(
    "d13_small_talk",
    f"""SELECT s AS sentence, count(*) AS n, regexp_matches(trim(s), {o.q(fixed.SMALL_TALK)}) AND length(s) <= 60 AS small_talk
    FROM (SELECT unnest({o.sentences('text')}) AS s FROM conversations) GROUP BY 1""",
)
def _(t):
    s = t.conversations.select(F.explode(text.sentences(F.col("text"))).alias("sentence"))
    counted = s.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("small_talk", text.is_small_talk(F.col("sentence")))


@query("d14_extract_json")
def _(t):
    from ..functions.arrow import extract_json

    reply = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))
    return t.events.select("event_id", extract_json(reply).alias("parsed"), extract_json(F.col("props")).alias("whole"))


@query("d15_markdown")
def _(t):
    blocks = F.array(*[F.lit(b) for b in ("paragraph", "bullet", "numbered", "continue")])
    parts = F.transform(
        text.sentences(F.col("text")),
        lambda s, i: F.struct(
            s.alias("text"),
            F.get(blocks, F.pmod(i, F.lit(4))).alias("block"),
            F.when(F.pmod(i, F.lit(7)) == 0, F.concat(F.lit("Part "), i.cast("string"))).otherwise("").alias("heading"),
        ),
    )
    return t.documents.select("doc_id", text.sentences_to_markdown(parts).alias("markdown"))


@query(
    "d16_vectors",
    """WITH c AS (SELECT label, list(avg_x ORDER BY i) AS centroid, max(n) AS n FROM (
         SELECT label, i, avg(x::DOUBLE) AS avg_x, count(*) AS n FROM (
           SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 4) AS cosine,
      round(list_dot_product(e.embedding::DOUBLE[], c.centroid), 4) AS dot,
      round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 4) AS norm,
      round((c.centroid[1] * c.n + e.embedding[1]) / (c.n + 1), 4) AS moved
    FROM embeddings e JOIN c USING (label)""",
)
def _(t):
    e = t.embeddings
    per = (
        e.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
        .groupBy("label")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"),
            F.max("n").alias("members"),
        )
    )
    v, c = F.col("embedding"), F.col("centroid")
    return e.join(per, "label").select(
        "vec_id",
        F.round(vectors.cosine(v, c), 4).alias("cosine"),
        F.round(vectors.dot(v, c), 4).alias("dot"),
        F.round(vectors.norm(v), 4).alias("norm"),
        F.round(F.get(vectors.running_mean(c, F.col("members"), v), F.lit(0)), 4).alias("moved"),
    )
