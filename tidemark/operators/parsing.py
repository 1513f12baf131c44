"""Documents to blocks, blocks to chunks, and what a chunk is enriched with.

``parsed`` [doc key]: title, mime, blocks (array of kind, text, level, page), parse_error.
A document is one row all the way to its chunks, so parsing and packing need no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.acronyms import acronyms
from ..functions.arrow import decode
from ..functions.embedding import hash_embedding
from ..functions.html import html_blocks
from ..functions.markdown import markdown_blocks
from ..functions.packing import chunk_plan, group_firsts
from ..functions.fixed import DEFAULT_STRATEGY, ChunkStrategy
from .corpus import embedding_text, heuristic_context

BLOCK = "struct<kind:string,text:string,level:int,page:int>"


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def mime_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for ending, mime in fixed.FILE_TYPES.items():
        out = F.when(suffix(name) == ending, mime).otherwise(out)
    return out


def stem_title(name: Column) -> Column:
    bare = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    spaced = F.trim(F.translate(bare, "_-", "  "))
    return F.when(spaced == "", name).otherwise(spaced)


# ------------------------------------------------------------------ plain text, in the JVM


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def heading_level(line: Column) -> Column:
    """0 for text, else the level a line has as a heading: numbered, capitals, title case."""
    return text.let(_strip(line), lambda s: text.let(F.split(s, r"(?U)\s+"), lambda parts: _level(s, parts)))


def _level(s: Column, parts: Column) -> Column:
    numbered = s.rlike(fixed.NUMBERED_HEADING)
    first = F.get(parts, F.lit(0))
    dots = F.length(first) - F.length(F.replace(first, F.lit(".")))
    cased = F.lower(s) != F.upper(s)

    def capital(w: Column) -> Column:
        c = F.substring(w, 1, 1)
        return (F.upper(c) == c) & (F.lower(c) != c)

    caps = F.size(F.filter(parts, capital))
    enough = F.greatest(F.lit(1), F.floor(F.size(parts) * 0.7))
    prose = F.substring(s, -1, 1).isin(".", ",", ";", ":") & ~numbered
    return (
        F.when((s == "") | (F.length(s) > 90) | prose | (F.size(parts) > 12), 0)
        .when(numbered, F.least(1 + dots, F.lit(4)))
        .when((F.upper(s) == s) & cased & (F.length(s) > 3), 1)
        .when((F.size(parts) <= 8) & (caps >= enough) & ~s.endswith("?"), 2)
        .otherwise(0)
    )


def text_blocks(source: Column) -> Column:
    """Blocks of plain text: a heading line, then a list or a re-joined paragraph."""
    paras = F.split(F.regexp_replace(source, "\r\n", "\n"), r"(?U)\n\s*\n")
    lined = F.filter(
        F.transform(paras, lambda p: F.filter(F.split(p, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda ln: _strip(ln) != "")),
        lambda ls: F.size(ls) > 0,
    )

    def body(lines: Column) -> Column:
        tidy = F.transform(lines, _strip)
        is_list = F.forall(lines, lambda ln: ln.rlike("(?U)" + fixed.LIST_LINE))
        prose = F.regexp_replace(F.array_join(tidy, " "), r"(?U)(\w)- (\w)", "$1$2")
        return F.struct(
            F.when(is_list, "list").otherwise("para").alias("kind"),
            F.when(is_list, F.array_join(tidy, "\n")).otherwise(prose).alias("text"),
            F.lit(0).alias("level"),
            F.lit(None).cast("int").alias("page"),
        )

    def blocks(lines: Column) -> Column:
        def build(level: Column) -> Column:
            head = F.struct(
                F.lit("heading").alias("kind"),
                _strip(F.get(lines, F.lit(0))).alias("text"),
                level.cast("int").alias("level"),
                F.lit(None).cast("int").alias("page"),
            )
            rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
            return (
                F.when(level == 0, F.array(body(lines)))
                .when(F.size(lines) == 1, F.array(head))
                .otherwise(F.array(head, body(rest)))
            )

        return text.let(heading_level(F.get(lines, F.lit(0))), build)

    return F.flatten(F.transform(lined, blocks))


def block_title(given: Column, blocks: Column, stem: Column, first_level_one: bool = False) -> Column:
    """Given title, else the first level-1 heading (if asked), else the first heading."""
    heads = F.filter(blocks, lambda b: b["kind"] == "heading")
    choices = [F.when(given != "", given)]
    if first_level_one:
        one = F.get(F.filter(heads, lambda b: b["level"] == 1), F.lit(0))["text"]
        choices.append(F.when(one != "", one))
    return F.coalesce(*choices, F.get(heads, F.lit(0))["text"], stem)


# ------------------------------------------------------------------ parsing


def parse_html(source: Column) -> Column:
    """struct(title, blocks) of a page."""
    names = ("kind", "text", "level", "page")

    def run(sources: pd.Series) -> pd.DataFrame:
        rows = [html_blocks(s) if s is not None else (None, []) for s in sources]
        return pd.DataFrame({"title": [r[0] for r in rows], "blocks": [[dict(zip(names, b, strict=True)) for b in r[1]] for r in rows]})

    return F.pandas_udf(run, f"title string, blocks array<{BLOCK}>")(source)


def parse_markdown(source: Column) -> Column:
    """struct(title, blocks) of a Markdown text."""
    return markdown_blocks(source)


def parse_documents(files: DataFrame) -> DataFrame:
    """Parse rows with ``name``, ``content`` (binary) and ``mime``, each type its own way, in one pass.

    Adds title, blocks and parse_error.  Unsupported or empty files stay as rows with the
    reason, as does a type (PDF, Word) whose codec is not part of this package.
    """
    mime = F.col("mime")
    read = ["text/html", "text/markdown", "text/plain"]
    rows = text.once(files, _source=F.when(mime.isin(*read), decode(F.when(mime.isin(*read), F.col("content")))))
    rows = rows.withColumn("_html", parse_html(F.when(mime == "text/html", F.col("_source"))))
    none = F.array().cast(f"array<{BLOCK}>")
    plain = F.struct(F.lit("").alias("title"), text_blocks(F.col("_source")).cast(f"array<{BLOCK}>").alias("blocks"))
    marked = parse_markdown(F.col("_source")).cast(f"struct<title:string,blocks:array<{BLOCK}>>")
    found = (
        F.when(mime == "text/html", F.col("_html"))
        .when(mime == "text/markdown", marked)
        .when(mime == "text/plain", plain)
        .otherwise(F.struct(F.lit("").alias("title"), none.alias("blocks")))
    )
    rows = text.once(rows, _p=found)
    title, blocks, stem = F.col("_p.title"), F.col("_p.blocks"), stem_title(F.col("name"))
    rows = rows.withColumn(
        "_title", F.when(mime == "text/markdown", block_title(title, blocks, stem, first_level_one=True)).otherwise(block_title(title, blocks, stem))
    )
    error = (
        F.when(mime.isNull(), F.concat(F.lit("unsupported file type: "), "name"))
        .when(~mime.isin(*read), F.concat(F.lit("no decoder for "), "mime"))
        .when(F.size(blocks) == 0, F.concat(F.lit("no extractable text in "), "name"))
    )
    return rows.select(*files.columns, F.col("_title").alias("title"), blocks.alias("blocks"), error.alias("parse_error"))


def explode_blocks(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return parsed.select(key, F.posexplode("blocks").alias("pos", "b")).select(key, "pos", "b.*")


# ------------------------------------------------------------------ chunks


def _tokens(s: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(s) / 4)).cast("int")


def _units(kind: Column, body: Column, limit: int) -> Column:
    """What an oversized block may be cut between: lines, sentences, or stretches of a huge sentence."""

    def unit(s: Column, alone: bool) -> Column:
        return F.struct(s.alias("s"), F.lit(alone).alias("alone"))

    def stretches(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / (4 * limit)))
        return F.transform(starts, lambda k: unit(F.substring(s, (k * 4 * limit + 1).cast("int"), F.lit(4 * limit)), True))

    def prose(sents: Column) -> Column:
        some = F.when(F.size(sents) > 0, sents).otherwise(F.array(body))
        return F.flatten(F.transform(some, lambda s: F.when(_tokens(s) > limit, stretches(s)).otherwise(F.array(unit(s, False)))))

    return (
        F.when((kind == "heading") | (_tokens(body) <= limit), F.array(unit(body, False)))
        .when(kind.isin("table", "code", "list"), F.transform(F.split(body, "\n"), lambda s: unit(s, False)))
        .otherwise(text.let(text.sentences(body), prose))
    )


def _elements(block: Column, firsts: Column) -> Column:
    """A block's pieces, between the given first units, as what chunks are made of."""
    units, head = block["units"], F.get(block["units"], F.lit(0))["s"]
    heading, table = block["kind"] == "heading", block["kind"] == "table"
    listed = block["kind"].isin("table", "code", "list")

    def piece(first: Column, i: Column) -> Column:
        end = F.coalesce(F.get(firsts, i + 1), F.size(units))
        own = F.transform(F.slice(units, first + 1, end - first), lambda u: u["s"])
        led = table & (i > 0) & (head != "") & (F.get(own, F.lit(0)) != head)
        joined = F.when(listed, F.array_join(own, "\n")).otherwise(F.array_join(own, " "))
        body = F.concat(F.when(led, F.concat(head, F.lit("\n"))).otherwise(""), joined)
        marks = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), block["level"])))
        return F.struct(
            F.when(heading, F.concat(marks, F.lit(" "), body)).otherwise(body).alias("text"),
            body.alias("body"),  # without the marks of a heading; its size counts
            F.when(heading, F.greatest(F.lit(1), block["level"])).otherwise(0).alias("level"),
            (block["kind"] == "para").alias("prose"),
            block["page"].alias("page"),
        )

    return F.filter(F.transform(firsts, piece), lambda e: (F.size(firsts) == 1) | (_strip(e["body"]) != ""))


def _tail(body: Column, most: int) -> Column:
    """Whole last sentences of prose, ``most`` tokens together; empty for tables and code."""

    def longest(sents: Column) -> Column:
        # a sentence and its space are two characters at least
        many = F.least(F.size(sents), F.lit(2 * most + 4))
        ends = F.transform(F.sequence(F.lit(1), many), lambda k: F.array_join(F.slice(sents, -k, k), " "))
        fitting = F.filter(ends, lambda s: _tokens(s) <= most)
        return F.when(F.size(sents) > 0, F.coalesce(F.get(fitting, F.size(fitting) - 1), F.lit(""))).otherwise("")

    marked = body.startswith("|") | body.startswith("```")
    return F.when(marked | F.lit(most <= 0), "").otherwise(text.let(text.sentences(body), longest))


def _chunk(run: Column, elements: Column, tails: Column) -> Column:
    own = F.slice(elements, run["first"] + 1, run["rows"])
    parts = F.transform(own, lambda e: e["text"])
    carried = F.array(F.get(tails, run["first"] - 1))
    body = _strip(F.array_join(F.when(run["carried"], F.concat(carried, parts)).otherwise(parts), "\n\n"))
    trail = F.transform(run["trail"], lambda i: F.get(elements, i)["body"])
    pages = F.filter(F.transform(own, lambda e: e["page"]), lambda p: p.isNotNull())
    return text.let(body, lambda b: F.struct(b.alias("text"), F.array_join(trail, " > ").alias("section_path"), F.get(pages, F.lit(0)).alias("page"), _tokens(b).alias("token_count")))


def _small_end(chunks: Column, least: int) -> Column:
    """The last chunk joined to the one before, if it is small and of the same section."""
    last, prior = F.get(chunks, F.size(chunks) - 1), F.get(chunks, F.size(chunks) - 2)
    body = F.concat(prior["text"], F.lit("\n\n"), last["text"])
    both = F.struct(body.alias("text"), prior["section_path"].alias("section_path"), prior["page"].alias("page"), _tokens(body).alias("token_count"))
    small = (F.size(chunks) > 1) & (last["token_count"] < least // 2) & (last["section_path"] == prior["section_path"])
    return F.when(small, F.concat(F.slice(chunks, 1, F.greatest(F.size(chunks) - 2, F.lit(0))), F.array(both))).otherwise(chunks)


def pack_chunks(docs: DataFrame, keep: list[str], strategy: ChunkStrategy = DEFAULT_STRATEGY) -> DataFrame:
    """The chunks of each row's ``blocks``, with the kept columns repeated.

    Blocks are cut and joined as array expressions; Arrow functions see token and character
    counts only and answer with positions.  A document stays one row, so nothing is shuffled.
    """
    st = strategy
    cut = F.transform(
        "blocks",
        lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), b["page"].alias("page"), _units(b["kind"], b["text"], st.max_tokens).alias("units")),
    )
    rows = text.once(docs.select(*keep, "blocks"), _cut=cut).drop("blocks")
    lines = F.col("_cut")
    head = F.transform(lines, lambda b: F.length(F.get(b["units"], F.lit(0))["s"]))
    firsts = group_firsts(
        F.transform(lines, lambda b: F.transform(b["units"], lambda u: F.when(u["alone"], -F.length(u["s"])).otherwise(F.length(u["s"])))),
        F.transform(lines, lambda b: F.lit(1)),
        F.transform(lines, lambda b: F.lit(4 * st.max_tokens + 3)),
        F.transform(F.arrays_zip(lines.alias("b"), head.alias("n")), lambda z: F.when((z["b"]["kind"] == "table") & (z["n"] > 0), z["n"]).otherwise(-1)),
    )
    rows = rows.withColumn("_firsts", firsts)
    rows = text.once(rows, _elements=F.flatten(F.zip_with("_cut", "_firsts", _elements))).drop("_cut", "_firsts")
    rows = text.once(rows, _tails=F.transform("_elements", lambda e: _tail(e["text"], st.overlap_tokens)))
    plan = chunk_plan(
        F.transform("_elements", lambda e: e["level"]),
        F.transform("_elements", lambda e: _tokens(e["body"])),
        F.transform("_tails", lambda t: F.when(t == "", 0).otherwise(_tokens(t))),
        F.transform("_elements", lambda e: e["prose"]),
        st.target_tokens,
        st.max_tokens,
        st.min_tokens,
    )
    rows = rows.withColumn("_plan", plan)
    made = F.transform("_plan", lambda run: _chunk(run, F.col("_elements"), F.col("_tails")))
    rows = text.once(rows, _chunks=F.filter(made, lambda c: c["text"] != ""))
    return rows.select(*keep, F.posexplode(_small_end(F.col("_chunks"), st.min_tokens)).alias("ord", "c")).select(
        *keep, "ord", "c.text", "c.section_path", "c.page", "c.token_count"
    )


def document_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def chunk_documents(parsed: DataFrame, strategy: ChunkStrategy = DEFAULT_STRATEGY) -> DataFrame:
    """Chunks with their document's columns, aliases from its acronyms, and flags."""
    good = parsed.where(F.col("parse_error").isNull()) if "parse_error" in parsed.columns else parsed
    keep = [c for c in ("kb_id", "doc_id", "title", "version") if c in good.columns]
    paired = good.withColumn("_pairs", acronyms(document_text(F.col("blocks"))))
    rows = pack_chunks(paired, [*keep, "_pairs"], strategy)
    return rows.withColumn("aliases", chunk_aliases(F.col("text"), F.col("_pairs"))).withColumn(
        "flags", flags(F.col("text"))
    ).drop("_pairs")


def chunk_aliases(chunk_text: Column, pairs: Column) -> Column:
    """Long form and acronym of the definitions a chunk mentions."""
    none = F.array().cast("array<string>")

    def mentioned(low: Column) -> Column:
        hits = F.filter(pairs, lambda p: low.contains(F.lower(p["acronym"])) | low.contains(F.lower(p["full"])))
        return F.flatten(F.transform(hits, lambda p: F.array(p["full"], p["acronym"])))

    return F.array_distinct(F.coalesce(text.let(F.lower(chunk_text), mentioned), none))


def flags(chunk_text: Column) -> Column:
    return F.when(text.looks_like_override(chunk_text), F.array(F.lit("injection_suspect"))).otherwise(
        F.array().cast("array<string>")
    )


def flagged_per_document(chunks: DataFrame) -> DataFrame:
    hit = F.array_contains("flags", "injection_suspect")
    return chunks.groupBy("doc_id").agg(F.count_if(hit).alias("injection_chunks"))


def add_context(chunks: DataFrame, key: str = "chunk_id", topics: int = 6) -> DataFrame:
    """Context line per chunk: title, first heading in it, and its commonest longer words."""
    toks = F.filter(text.tokens(F.col("text")), lambda w: F.length(w) > 3)
    words = chunks.select(key, F.posexplode(toks).alias("pos", "word"))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "pos")
    top = counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= topics)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "word"))), lambda s: s["word"]), ", ")
    per = top.groupBy(key).agg(joined.alias("_topics"))
    heading = F.trim(F.regexp_extract("text", r"(?m)^#[# ]*(.*)$", 1))
    said = F.concat(
        F.lit("From '"),
        F.col("title"),
        F.lit("'"),
        F.when(heading != "", F.concat(F.lit(", section '"), heading, F.lit("'"))).otherwise(""),
        F.lit(". Topics: "),
        F.coalesce("_topics", F.lit("")),
        F.lit("."),
    )
    return chunks.join(per, key, "left").withColumn("context", said).drop("_topics")


def add_heuristic_context(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("context", heuristic_context(F.col("title"), F.col("section_path")))


def add_embedding(chunks: DataFrame, size: int = 512) -> DataFrame:
    head = F.trim(F.concat_ws(" ", "context", F.array_join("aliases", " ")))
    said = embedding_text(F.col("title"), F.col("section_path"), head, F.col("text"))
    return hash_embedding(chunks, said, size).withColumn("embedding_model", F.lit(f"hash:hash-{size}"))


def quality_signals(body: Column, headings: Column, modified_at: Column, as_of: Column) -> Column:
    """struct(parse_quality, freshness, headings, score) of a document."""
    alnum = F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", ""))
    parse = F.round(alnum / F.greatest(F.lit(1), F.length(body)), 3)
    days = F.greatest(F.lit(0.0), (as_of.cast("double") - modified_at.cast("double")) / 86400)
    fresh = F.when(modified_at.isNull(), 1.0).otherwise(F.round(1 / (1 + days / 180), 3))
    bonus = F.when(headings > 0, 1.0).otherwise(0.6)

    def score(p: Column) -> Column:
        total = F.round(0.5 * F.least(F.lit(1.0), p / 0.7) + 0.3 * fresh + 0.2 * bonus, 3)
        return F.struct(p.alias("parse_quality"), fresh.alias("freshness"), headings.alias("headings"), total.alias("score"))

    return text.let(parse, score)
