"""Routing, grading, answering and checking, for many questions at once.

``graded`` [query_id, chunk_id]: verdict, helped (subqs), key_sentences, final, origin.
``sentences`` [query_id, sentence]: text, citations (chunk ids), block, heading.
``claims`` [query_id, sentence]: claim, support, supporting, contradicting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.fixed import DEFAULTS, Tunables

DIGITS = 6

# ------------------------------------------------------------------ routing


def gate_features(questions: DataFrame, column: str = "query") -> DataFrame:
    """retrieval_need, complexity and freshness_need of each question."""
    q = F.col(column)
    low = F.lower(q)
    greeting = q.rlike(fixed.GREETING)
    marks = F.length(q) - F.length(F.replace(q, F.lit("?")))
    several = low.rlike(fixed.COMPARISON) | (marks > 1) | low.rlike(fixed.SECOND_QUESTION)
    complexity = (
        F.when(greeting, "simple")
        .when(low.rlike(fixed.RESEARCH_OPENING), "research")
        .when(several, "multi_part")
        .otherwise("simple")
    )
    fresh = F.when(greeting, 0.0).when(low.rlike(fixed.RECENCY), 0.8).otherwise(0.1)
    return (
        questions.withColumn("retrieval_need", F.when(greeting, 0.05).otherwise(0.9))
        .withColumn("complexity", complexity)
        .withColumn("freshness_need", fresh)
    )


def route(cfg: Tunables = DEFAULTS) -> Column:
    """From query, mode, the gate features, kb_tokens, window, allow_escalation, is_eval
    and staged."""
    direct = (F.col("retrieval_need") < cfg.gate_threshold) & text.is_small_talk(F.col("query"))
    deep = (F.col("complexity") == "research") & F.col("allow_escalation") & ~F.col("is_eval")
    limit = F.least(F.lit(cfg.long_context_max_tokens), F.floor(F.col("window") * 0.6))
    whole = (F.col("kb_tokens") > 0) & (F.col("kb_tokens") <= limit) & ~F.col("staged")
    return (
        F.when(F.col("mode").isin("fast", "standard", "deep"), F.col("mode"))
        .when(direct, "direct")
        .when(deep, "deep")
        .when(whole, "long_context")
        .when(F.col("complexity") == "simple", "fast")
        .otherwise("standard")
    )


def base_tokens(chunks: DataFrame) -> DataFrame:
    live = chunks.where(F.col("status") == "active")
    return live.groupBy("kb_id").agg(F.sum("token_count").alias("kb_tokens"))


def plan_questions(questions: DataFrame, max_parts: int | None = None, column: str = "query") -> DataFrame:
    """Sub-questions of each question, split on ``?``, ``;`` and a second question word; the first ``max_parts`` if given."""
    q = F.col(column)
    pieces = F.transform(F.split(q, "(?U)" + fixed.QUESTION_BREAK), lambda s: F.btrim(s, F.lit(" \t\n\r\f\v")))
    useful = F.filter(pieces, lambda s: F.size(text.content_terms(s)) >= 1)
    parts = text.let(useful, lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(q)))
    parts = parts if max_parts is None else F.slice(parts, 1, max_parts)
    part = F.col("part")
    rows = questions.select(*questions.columns, F.posexplode(parts).alias("subq", "part"))
    return (
        rows.withColumn("question", F.when(part.endswith("?"), part).otherwise(F.concat(part, F.lit("?"))))
        .withColumn("keywords", text.keywords(part))
        .withColumn("identifiers", text.identifiers(part))
        .withColumn("variants", F.array().cast("array<string>"))
        .drop("part")
    )


def rewrites(subqueries: DataFrame) -> DataFrame:
    """New wordings of a sub-question, minus ``question`` and the ``variants`` tried."""
    q = F.col("question")

    def wordings(kws: Column) -> Column:
        longest = F.array_sort(F.transform(kws, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
        two = F.array_join(F.transform(F.slice(longest, 1, 2), lambda s: s["w"]), " ")
        return F.array(F.array_join(kws, " "), F.when(F.size(kws) > 2, two).otherwise(""))

    made = F.concat(text.let(text.keywords(q), wordings), F.array(F.array_join(text.tokens(q), " ")))
    tried = F.concat(F.array(q), F.coalesce("variants", F.array().cast("array<string>")))
    fresh = F.array_except(F.filter(made, lambda s: s != ""), tried)
    return subqueries.select("query_id", "subq", F.posexplode(fresh).alias("position", "rewrite"))


# ------------------------------------------------------------------ grading


def subquery_terms(subqueries: DataFrame) -> DataFrame:
    """The terms of a question's few sub-questions as one array, in order."""
    one = F.struct("subq", text.content_terms(F.col("question")).alias("terms"))
    return subqueries.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("asked"))


def grade(candidates: DataFrame, subqueries: DataFrame) -> DataFrame:
    """Verdict per candidate from its best overlap with any sub-question.

    Adds verdict, helped and the two sentences closest to the question.
    """
    def best(asked: Column, terms: Column) -> Column:
        shares = F.transform(asked, lambda s: text.overlap(s["terms"], terms))
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    def pick(sents: Column, asked: Column) -> Column:
        scored = F.transform(
            sents,
            lambda s, i: text.let(
                text.content_terms(s),
                lambda t: F.struct((-best(asked, t)).alias("n"), i.alias("i"), s.alias("s")),
            ),
        )
        return F.transform(F.slice(F.array_sort(scored), 1, 2), lambda x: x["s"])

    joined = text.once(
        candidates.join(subquery_terms(subqueries), "query_id"), _terms=text.content_terms(F.col("text"))
    )
    shares = F.transform(
        "asked", lambda s: F.struct(s["subq"].alias("subq"), text.overlap(s["terms"], F.col("_terms")).alias("share"))
    )
    scored = text.once(joined, _shares=shares)
    top = F.coalesce(F.array_max(F.transform("_shares", lambda s: s["share"])), F.lit(0.0))
    return (
        scored.withColumn("helped", F.transform(F.filter("_shares", lambda s: s["share"] >= 0.5), lambda s: s["subq"]))
        .withColumn("verdict", F.when(top >= 0.5, "correct").when(top >= 0.25, "ambiguous").otherwise("incorrect"))
        .withColumn("key_sentences", pick(text.sentences(F.col("text")), F.col("asked")))
        .drop("asked", "_terms", "_shares")
    )


def coverage(subqueries: DataFrame, graded: DataFrame) -> DataFrame:
    """Sub-questions with whether some correct chunk helps them."""
    good = (
        graded.where(F.col("verdict") == "correct")
        .select("query_id", F.explode("helped").alias("subq"))
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    return subqueries.join(good, ["query_id", "subq"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def rescues(regraded: DataFrame, fixed_subqs: DataFrame) -> DataFrame:
    """What supplied a correct chunk for a sub-question that had none before."""
    helped = regraded.where(F.col("verdict") == "correct").select(
        "query_id", F.explode("helped").alias("subq"), "origin", "chunk_id", "doc_id"
    )
    return helped.join(fixed_subqs.select("query_id", "subq"), ["query_id", "subq"], "left_semi")


def select_evidence(graded: DataFrame, limit: int = DEFAULTS.generate_k) -> DataFrame:
    """Correct before ambiguous, then by score, one row per chunk; adds ``place``."""
    order = [F.when(F.col("verdict") == "correct", 0).otherwise(1), F.round("final", DIGITS).desc(), F.col("chunk_id")]
    usable = graded.where(F.col("verdict").isin("correct", "ambiguous"))
    per_chunk = Window.partitionBy("query_id", "chunk_id").orderBy(*order)
    per_query = Window.partitionBy("query_id").orderBy(*order)
    once = usable.withColumn("_n", F.row_number().over(per_chunk)).where(F.col("_n") == 1).drop("_n")
    placed = once.withColumn("place", F.row_number().over(per_query))
    return placed.where(F.col("place") <= limit) if limit else placed


def evidence_text() -> Column:
    """The whole chunk if correct or without key sentences, else those sentences."""
    keys = F.coalesce("key_sentences", F.array().cast("array<string>"))
    whole = (F.col("verdict") == "correct") | (F.size(keys) == 0)
    return F.when(whole, F.col("text")).otherwise(F.array_join(keys, " "))


def whole_base_evidence(questions: DataFrame, chunks: DataFrame, subqueries: DataFrame) -> DataFrame:
    """Every visible chunk as evidence, for questions routed to whole-base reading.

    Only small bases are routed so; the token limit of the route bounds the join.
    """
    asked = questions.where(F.col("route") == "long_context").select("query_id", "kb_id")
    n = subqueries.groupBy("query_id").agg(F.sort_array(F.collect_list("subq")).alias("helped"))
    return (
        asked.join(n, "query_id")
        .join(chunks.where("allowed"), "kb_id")
        .withColumn("verdict", F.lit("correct"))
        .withColumn("origin", F.lit("long_context"))
        .withColumn("final", F.lit(0.0))
    )


def nearest_for_check(evidence: DataFrame, sentences: DataFrame, questions: DataFrame, n: int = 20) -> DataFrame:
    """Cited chunks plus the uncited among the ``n`` closest to question and answer."""
    said = sentences.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("sentence", "text"))).alias("_s"))
    about = questions.join(said, "query_id", "left").select(
        "query_id",
        text.content_terms(
            F.concat_ws(" ", "query", F.array_join(F.transform("_s", lambda s: s["text"]), " "))
        ).alias("_q"),
    )
    cited = sentences.select("query_id", F.explode("citations").alias("chunk_id")).distinct().withColumn("cited", F.lit(True))
    near = text.overlap(F.col("_q"), text.content_terms(F.col("text")))
    scored = evidence.join(about, "query_id").withColumn("near", near)
    w = Window.partitionBy("query_id").orderBy(F.round("near", DIGITS).desc(), "chunk_id")
    placed = scored.withColumn("_n", F.row_number().over(w)).join(cited, ["query_id", "chunk_id"], "left")
    return placed.where(F.coalesce("cited", F.lit(False)) | (F.col("_n") <= n)).drop("_q", "_n", "near", "cited")


# ------------------------------------------------------------------ answering


def draft(evidence: DataFrame, subqueries: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """Extractive answers: per sub-question up to two unused sentences that fit.

    ``evidence``: query_id, chunk_id, place, text (see :func:`evidence_text`).  Returns
    kind ``sentence`` or ``unanswered`` with position, text, chunk_id and subq.  Every
    sub-question ranks the sentences that cover a third of it; a fold over a question's
    sub-questions then takes the first ones not taken before.  ``generate_k`` bounds the lists.
    """
    sents = F.transform(
        text.sentences(F.col("text")),
        lambda s, i: F.struct(s.alias("s"), i.alias("i"), text.content_terms(s).alias("terms")),
    )
    ev = evidence.select("query_id", "chunk_id", "place", F.inline(sents)).where(
        ~F.ltrim("s").startswith("#") & (F.size("terms") >= 2)
    )
    if avoid is not None:
        banned = avoid.select("query_id", F.lower(F.trim("claim")).alias("_key")).distinct()
        ev = ev.withColumn("_key", F.lower(F.trim("s"))).join(banned, ["query_id", "_key"], "left_anti").drop("_key")
    asked = subqueries.select("query_id", "subq", "question", text.content_terms(F.col("question")).alias("wanted"))
    fitting = ev.join(asked, "query_id").withColumn("lack", -text.overlap(F.col("wanted"), F.col("terms"))).where("lack <= -0.34")
    # equal sentences count once, where they stand first
    each = fitting.groupBy("query_id", "subq", "s").agg(F.min(F.struct("lack", "place", "i", "chunk_id")).alias("at"))
    ranked = each.groupBy("query_id", "subq").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("ranked"))
    parts = asked.join(ranked, ["query_id", "subq"], "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("subq", "question", F.transform("ranked", lambda r: F.struct(r["s"].alias("s"), r["at"]["chunk_id"].alias("chunk_id"))).alias("ranked")))).alias("parts")
    )
    chunk, subq = dict(evidence.dtypes)["chunk_id"], dict(subqueries.dtypes)["subq"]
    line = f"struct<kind:string,position:int,text:string,chunk_id:{chunk},subq:{subq}>"
    row = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("kind", "position", "text", "chunk_id", "subq"), strict=True)]).cast(line)

    def answer(done: Column, part: Column) -> Column:
        free = F.filter(F.coalesce(part["ranked"], F.array().cast(f"array<struct<s:string,chunk_id:{chunk}>>")), lambda c: ~F.array_contains(done["used"], c["s"]))
        taken = F.slice(free, 1, 2)
        said = F.transform(taken, lambda c, j: row(F.lit("sentence"), F.size(done["used"]) + j, c["s"], c["chunk_id"], part["subq"]))
        none = F.array(row(F.lit("unanswered"), part["subq"], part["question"], F.lit(None), part["subq"]))
        return F.struct(
            F.concat(done["used"], F.transform(taken, lambda c: c["s"])).alias("used"),
            F.concat(done["lines"], F.when(F.size(taken) == 0, none).otherwise(said)).alias("lines"),
        )

    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{line}>").alias("lines"))
    return parts.select("query_id", F.inline(F.aggregate("parts", start, answer, lambda done: done["lines"])))


def draft_sentences(drafts: DataFrame) -> DataFrame:
    return drafts.where(F.col("kind") == "sentence").select(
        "query_id",
        F.col("position").alias("sentence"),
        "text",
        F.array("chunk_id").alias("citations"),
        F.lit("continue").alias("block"),
        F.lit("").alias("heading"),
    )


# ------------------------------------------------------------------ checking


def verify_claims(sentences: DataFrame, evidence: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Support of each sentence by a question's evidence.

    Full when a piece covers 80% of its terms and has all its numbers; contradicted by a
    piece that covers 60%, has numbers and shares none.
    """
    c = text.once(
        sentences.select("query_id", "sentence", F.col("text").alias("claim")),
        _ct=text.content_terms(F.col("claim")),
        _cn=text.numbers(F.col("claim"), ascii_only),
    )
    e = text.once(
        evidence.select("query_id", "chunk_id", "text"),
        _et=text.content_terms(F.col("text")),
        _en=text.numbers(F.col("text"), ascii_only),
    ).drop("text")
    share = text.overlap(F.col("_ct"), F.col("_et"))
    has_all = F.size(F.array_except("_cn", "_en")) == 0
    both = c.join(e, "query_id", "left").withColumn("_share", F.coalesce(share, F.lit(0.0))).withColumn(
        "_all", F.coalesce(has_all, F.lit(False))
    )
    yes = (F.col("_share") >= 0.8) & F.col("_all")
    numbered = (F.size("_cn") > 0) & (F.size("_en") > 0) & ~F.arrays_overlap("_cn", "_en")
    no = ~yes & (F.col("_share") >= 0.6) & F.coalesce(numbered, F.lit(False))
    per = both.groupBy("query_id", "sentence", "claim").agg(
        F.sort_array(F.collect_list(F.when(yes, F.col("chunk_id")))).alias("supporting"),
        F.sort_array(F.collect_list(F.when(no, F.col("chunk_id")))).alias("contradicting"),
        F.max(F.when(F.col("_all"), F.col("_share"))).alias("_best"),
    )
    support = F.when(F.size("supporting") > 0, "full").when(F.coalesce("_best", F.lit(0.0)) >= 0.5, "partial").otherwise("none")
    return per.withColumn("support", support).drop("_best")


def claims_for_all(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """Sentences a verifier skipped become claims without support."""
    skipped = sentences.join(claims.select("query_id", "sentence"), ["query_id", "sentence"], "left_anti")
    empty = F.array().cast(dict(claims.dtypes)["supporting"])
    rows = skipped.select(
        "query_id", "sentence", F.col("text").alias("claim"), empty.alias("supporting"), empty.alias("contradicting"), F.lit("none").alias("support")
    )
    return claims.select(*rows.columns).unionByName(rows)


def answered_parts(subqueries: DataFrame, claims: DataFrame) -> DataFrame:
    """Sub-questions with ``answered``: a full claim has at least 34% of their terms."""
    full = claims.where(F.col("support") == "full").select("query_id", text.content_terms(F.col("claim")).alias("_ct"))
    asked = subqueries.select("query_id", "subq", text.content_terms(F.col("question")).alias("_qt"))
    fits = F.coalesce(text.overlap(F.col("_qt"), F.col("_ct")) >= 0.34, F.lit(False))
    per = asked.join(full, "query_id", "left").groupBy("query_id", "subq").agg(F.bool_or(fits).alias("answered"))
    return subqueries.join(per, ["query_id", "subq"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def answer_metrics(sentences: DataFrame, claims: DataFrame, parts: DataFrame) -> DataFrame:
    """Groundedness, contradiction, coverage and citation accuracy per question."""
    c = claims.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("support") == "full").alias("_full"),
        F.count_if(F.size("contradicting") > 0).alias("_contra"),
    )
    backing = claims.groupBy("query_id", "sentence").agg(F.flatten(F.collect_list("supporting")).alias("_sup"))
    fits = F.coalesce(F.arrays_overlap("citations", "_sup"), F.lit(False))
    s = (
        sentences.join(backing, ["query_id", "sentence"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(fits).alias("_ok"))
    )
    p = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("_parts"), F.count_if("answered").alias("_answered"))
    share = lambda a, b: F.coalesce(F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 4), F.lit(0.0))
    return (
        p.join(c, "query_id", "left")
        .join(s, "query_id", "left")
        .select(
            "query_id",
            share("_full", "claims").alias("groundedness"),
            share("_contra", "claims").alias("contradiction"),
            share("_answered", "_parts").alias("coverage"),
            share("_ok", "_n").alias("citation_accuracy"),
            F.coalesce("claims", F.lit(0)).alias("claims"),
            F.coalesce("_n", F.lit(0)).alias("n_sentences"),
        )
    )


def passes(cfg: Tunables = DEFAULTS) -> Column:
    return (
        (F.col("claims") > 0)
        & (F.col("groundedness") >= cfg.min_groundedness)
        & (F.col("contradiction") <= cfg.max_contradiction)
        & (F.col("coverage") >= cfg.min_coverage)
    )


def status(cfg: Tunables = DEFAULTS) -> Column:
    return F.when(passes(cfg), "verified").when(F.col("n_sentences") > 0, "partial").otherwise("failed")


def confidence() -> Column:
    return F.round(
        F.col("groundedness") * (0.5 + 0.5 * F.col("coverage")) * (1 - F.col("contradiction")), 4
    )


def repair(sentences: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep sentences whose claims are all fully supported; cite what supports them.

    The layout of dropped sentences moves to the next kept one.  Returns the kept
    sentences and claims, both renumbered.
    """
    per = claims.groupBy("query_id", "sentence").agg(
        F.bool_and(F.col("support") == "full").alias("_keep"),
        F.array_distinct(F.flatten(F.collect_list("supporting"))).alias("_sup"),
    )
    rows = sentences.join(per, ["query_id", "sentence"], "left").withColumn("_keep", F.coalesce("_keep", F.lit(False)))
    before = Window.partitionBy("query_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_new", F.coalesce(F.sum(F.col("_keep").cast("int")).over(before), F.lit(0)).cast("int"))
    gone = numbered.where(~F.col("_keep")).groupBy("query_id", "_new").agg(
        F.min_by("block", F.when(F.col("block") != "continue", F.col("sentence"))).alias("_block"),
        F.min_by("heading", F.when(F.col("heading") != "", F.col("sentence"))).alias("_heading"),
    )
    kept = numbered.where("_keep").join(gone, ["query_id", "_new"], "left")
    out = kept.select(
        "query_id",
        F.col("_new").alias("sentence"),
        "text",
        F.when(F.size("_sup") > 0, F.col("_sup")).otherwise(F.col("citations")).alias("citations"),
        F.when(F.col("block") != "continue", F.col("block")).otherwise(F.coalesce("_block", F.lit("continue"))).alias("block"),
        F.when(F.col("heading") != "", F.col("heading")).otherwise(F.coalesce("_heading", F.lit(""))).alias("heading"),
    )
    moved = kept.select("query_id", "sentence", "_new")
    kept_claims = claims.join(moved, ["query_id", "sentence"]).withColumn("sentence", F.col("_new")).drop("_new")
    return out, kept_claims


def answered_after_repair(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """Still answered when the kept text has a quarter of the sub-question's terms."""
    said = kept.groupBy("query_id").agg(F.array_join(F.collect_list("text"), " ").alias("_said"))
    near = text.overlap(text.content_terms(F.col("question")), text.content_terms(F.coalesce("_said", F.lit("")))) >= 0.25
    return parts.join(said, "query_id", "left").withColumn("answered", F.col("answered") & near).drop("_said")


def conflicts(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contradicted claims with the documents on either side."""
    bad = claims.where(F.size("contradicting") > 0)
    sides = bad.select("query_id", "sentence", "claim", F.explode(F.concat("supporting", "contradicting")).alias("chunk_id"))
    return (
        sides.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
        .groupBy("query_id", "sentence", "claim")
        .agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    )


# ------------------------------------------------------------------ composing


def cited_sentence(said: Column, chunk_text: Column) -> Column:
    """The chunk's sentence closest to what was said."""

    def closest(terms: Column, sents: Column) -> Column:
        scored = F.transform(
            sents, lambda s, i: F.struct((-text.overlap(terms, text.content_terms(s))).alias("n"), i.alias("i"), s.alias("s"))
        )
        return F.array_min(scored)["s"]

    best = text.let(text.content_terms(said), lambda t: closest(t, text.sentences(chunk_text)))
    return F.coalesce(best, chunk_text)


def citation_numbers(sentences: DataFrame) -> DataFrame:
    """Numbers in order of first use: query_id, chunk_id, n, sentence of first use."""
    uses = sentences.select("query_id", "sentence", F.posexplode("citations").alias("pos", "chunk_id"))
    first = uses.groupBy("query_id", "chunk_id").agg(F.min(F.struct("sentence", "pos")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", "chunk_id", F.row_number().over(w).alias("n"), F.col("at.sentence").alias("sentence"))


def citations(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    numbers = citation_numbers(sentences)
    said = sentences.select("query_id", "sentence", F.trim("text").alias("_said"))
    return (
        numbers.join(said, ["query_id", "sentence"])
        .join(chunks.select("chunk_id", "doc_id", F.col("text").alias("_text")), "chunk_id")
        .select("query_id", "n", "chunk_id", "doc_id", cited_sentence(F.col("_said"), F.col("_text")).alias("cited_text"))
    )


def spans(sentences: DataFrame) -> DataFrame:
    """Character spans of the sentences in the joined text, and their citation numbers."""
    numbers = citation_numbers(sentences).select("query_id", "chunk_id", "n")
    cited = (
        sentences.select("query_id", "sentence", F.posexplode("citations").alias("pos", "chunk_id"))
        .join(numbers, ["query_id", "chunk_id"])
        .groupBy("query_id", "sentence")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n"))), lambda s: s["n"]).alias("numbers"))
    )
    before = Window.partitionBy("query_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.trim("text"))
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    return (
        sentences.withColumn("start", start)
        .withColumn("end", F.col("start") + size)
        .join(cited, ["query_id", "sentence"], "left")
        .select("query_id", "sentence", F.trim("text").alias("text"), "start", "end", "numbers")
    )


def compose(
    questions: DataFrame, sentences: DataFrame, metrics: DataFrame, parts: DataFrame, cfg: Tunables = DEFAULTS
) -> DataFrame:
    """One answer per question: status, text with notes, metrics and what stays open."""
    one = F.struct("sentence", "text", "block", "heading")
    body = sentences.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("_s"))
    laid_out = F.exists("_s", lambda s: (s["block"] != "continue") | (s["heading"] != ""))
    plain = F.array_join(F.transform("_s", lambda s: F.trim(s["text"])), " ")
    said = F.when(laid_out, text.sentences_to_markdown(F.col("_s"))).otherwise(plain)
    open_parts = parts.where(~F.col("answered")).groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("subq", "question"))), lambda s: s["question"]).alias("unanswered")
    )
    nothing = "I could not produce an answer that is supported by the knowledge base."
    rows = (
        questions.select("query_id")
        .join(metrics, "query_id")
        .join(body, "query_id", "left")
        .join(open_parts, "query_id", "left")
        .withColumn("unanswered", F.coalesce("unanswered", F.array().cast("array<string>")))
        .withColumn("status", status(cfg))
        .withColumn("_said", F.when(F.coalesce(said, F.lit("")) == "", nothing).otherwise(said))
    )
    note = F.when(
        (F.size("unanswered") > 0) & (F.col("status") != "verified"),
        F.concat(F.lit("\n\nNot found in the knowledge base: "), F.array_join("unanswered", "; ")),
    ).otherwise("")
    return (
        rows.withColumn("answer", F.concat("_said", note)).withColumn("confidence", confidence()).drop("_s", "_said")
    )


# ------------------------------------------------------------------ research, budget, hand-over


def pool_subanswers(citations_: DataFrame) -> DataFrame:
    """Evidence for a research question from its sub-answers' citations, once per chunk.

    ``citations_``: parent_id, worker, subq, status, chunk_id.  The first worker citing a
    chunk decides; a follow-up without a place in the plan (null ``subq``) helps all.
    """
    at = F.struct(F.col("subq").isNull().alias("late"), "worker")
    first = citations_.groupBy("parent_id", "chunk_id").agg(
        F.min_by("status", at).alias("worker_status"), F.min_by("subq", at).alias("subq")
    )
    good = F.col("worker_status") == "verified"
    return first.select(
        F.col("parent_id").alias("query_id"),
        "chunk_id",
        "subq",
        F.when(good, "correct").otherwise("ambiguous").alias("verdict"),
        F.when(good, 1.0).otherwise(0.6).alias("final"),
        F.lit("deep_worker").alias("origin"),
    )


def follow_ups(subanswers: DataFrame, planned: DataFrame, n: int | None = None) -> DataFrame:
    """Open parts of unverified sub-answers that were not planned; the first ``n`` per parent if given.

    ``subanswers``: parent_id, worker, status, unanswered (array).
    """
    gaps = subanswers.where(F.col("status") != "verified").select(
        "parent_id", "worker", F.posexplode("unanswered").alias("pos", "question")
    )
    fresh = gaps.join(planned.select("parent_id", "question"), ["parent_id", "question"], "left_anti")
    once = fresh.groupBy("parent_id", "question").agg(F.min(F.struct("worker", "pos")).alias("at"))
    w = Window.partitionBy("parent_id").orderBy("at")
    placed = once.withColumn("position", F.row_number().over(w)).drop("at")
    return placed if n is None else placed.where(F.col("position") <= n)


def within_budget(steps: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Steps that still fit the call budget of their question's tier.

    ``steps``: query_id, step, calls, tier.  Adds ``spent`` and ``allowed``.
    """
    budget = (
        F.when(F.col("tier") == "fast", cfg.fast_calls).when(F.col("tier") == "deep", cfg.deep_calls).otherwise(cfg.standard_calls)
    )
    from .ordered import running_total_by_bucket

    block = F.floor(F.col("step") / 64)
    spent = running_total_by_bucket(steps, ["query_id"], ["step"], block, "calls", "spent")
    return spent.withColumn("allowed", F.col("spent") <= budget)


def hand_over() -> tuple[Column, Column]:
    """``(general, escalate)``: who gets a general note, and who a research job.

    Reads status, n_unanswered, allow_general, is_eval, mode, route, allow_escalation.
    """
    general = F.col("allow_general") & ~F.col("is_eval") & ((F.col("status") == "failed") | (F.col("n_unanswered") > 0))
    escalate = (
        ~general
        & F.col("status").isin("partial", "failed")
        & F.col("allow_escalation")
        & (F.col("mode") == "auto")
        & (F.col("route") == "standard")
        & ~F.col("is_eval")
    )
    return general, escalate
