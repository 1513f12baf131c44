"""Text functions as Column expressions.

All of them run inside the JVM.  Regular expressions follow Unicode rules unless a
function takes ``ascii_only``, which exists for callers that must agree with an engine
whose word class is ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

_SPACE = r"[\s\x1c-\x1f]"


def _flag(pattern: str, ascii_only: bool) -> str:
    return pattern if ascii_only else "(?U)" + pattern


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    A lambda evaluates everything it mentions for each element, so a costly expression
    has to be bound to a variable before a lambda may refer to it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed exactly once per row.

    Spark inlines a projected expression into every later use and into pushed filters.  A
    generator's output is never inlined, so a costly expression goes through one.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


@lru_cache(maxsize=1)
def _stop_words() -> list[Column]:
    return [F.lit(w) for w in fixed.STOP_WORDS]


def is_stop_word(word: Column) -> Column:
    return word.isin(*_stop_words())


def stem(word: Column) -> Column:
    """Strip the first listed suffix that leaves at least four characters."""
    branch = None
    for suffix in fixed.STEM_SUFFIXES:
        n = len(suffix)
        base = F.substring(word, F.lit(1), F.length(word) - n)
        if suffix in fixed.STEM_TO_Y:
            base = F.concat(base, F.lit("y"))
        test = word.endswith(suffix) & (F.length(word) > n + 3)
        branch = F.when(test, base) if branch is None else branch.when(test, base)
    return branch.otherwise(word)


def stem_word(word: str) -> str:
    """:func:`stem` of one word in plain Python, for words met once in a block."""
    for suffix in fixed.STEM_SUFFIXES if word.endswith(fixed.STEM_SUFFIXES) else ():
        if word.endswith(suffix) and len(word) > len(suffix) + 3:
            return word[: -len(suffix)] + ("y" if suffix in fixed.STEM_TO_Y else "")
    return word


def words(text: Column) -> Column:
    """Lower-cased word tokens, stop words included, not stemmed."""
    return F.transform(_find_all(text, fixed.TOKEN), F.lower)


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    found = words(text)
    if not keep_stop_words:
        found = F.filter(found, lambda w: ~is_stop_word(w))
    return F.transform(found, stem)


def content_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?U){_SPACE}+", " "))


def sentences(text: Column) -> Column:
    """Split on blank lines and after ``.!?`` before a capital, digit or quote."""
    cut = rf"(?U)\n{_SPACE}*\n|(?<=[.!?]){_SPACE}+(?={fixed.SENTENCE_START})"
    return F.filter(F.transform(F.split(text, cut), collapse), lambda s: s != "")


def identifiers(text: Column, ascii_only: bool = False) -> Column:
    found = _find_all(text, _flag(fixed.QUOTED_OR_CODE, ascii_only))
    bare = F.transform(found, lambda s: F.btrim(s, F.lit('"')))
    return F.array_distinct(F.filter(bare, lambda s: s != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0.0)).otherwise(
        both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)
    )


def overlap(query_terms: Column, text_terms: Column) -> Column:
    """Share of the (distinct) query terms that occur in the text terms."""
    return F.when(F.size(query_terms) < 1, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(query_terms, text_terms)) / F.size(query_terms)
    )


def shingles(text: Column, k: int = 5) -> Column:


    def windows(toks: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(toks) - (k - 1), F.lit(1)))
        # Element access, as ``slice`` copies the whole array at every position.
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(toks, i + j) for j in range(-1, k - 1)]))
        return F.when(F.size(toks) < 1, F.array().cast("array<string>")).otherwise(
            F.array_distinct(joined)
        )

    return let(tokens(text, keep_stop_words=True), windows)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def numbers(text: Column, ascii_only: bool = False) -> Column:
    found = _find_all(text, _flag(fixed.NUMBER, ascii_only))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, ",", "")))


def raw_words(text: Column) -> Column:
    return F.filter(
        _find_all(F.lower(text), fixed.RAW_WORD), lambda w: ~is_stop_word(w) & (F.length(w) > 2)
    )


def missing_words(question: Column, chunk_tokens: Column) -> Column:
    """Question words whose stem the chunk does not have, in question order."""
    asked = F.array_distinct(raw_words(question))
    return let(
        chunk_tokens, lambda have: F.filter(asked, lambda w: ~F.array_contains(have, stem(w)))
    )


def present_words(texts: Column, chunk_tokens: Column, exclude: Column) -> Column:
    """Words of ``texts`` (array) whose stem the chunk has, minus ``exclude``."""
    found = F.flatten(F.transform(texts, raw_words))
    kept = F.array_except(found, exclude)
    return let(chunk_tokens, lambda have: F.filter(kept, lambda w: F.array_contains(have, stem(w))))


def keywords(text: Column, ascii_only: bool = False) -> Column:
    return F.filter(
        _find_all(text, _flag(fixed.KEYWORD, ascii_only)),
        lambda w: ~is_stop_word(F.lower(w)) & (F.length(w) > 2),
    )


def is_small_talk(query: Column, assistant: str = "") -> Column:
    """Greetings and thanks, also when they end with the name of the ``assistant``."""
    name = f"|{re.escape(assistant)}" if assistant else ""
    pattern = fixed.SMALL_TALK.replace("|bot)", f"|bot{name})")
    return F.trim(query).rlike(pattern) & (F.length(query) <= 60)


def looks_like_override(text: Column) -> Column:
    return text.rlike(fixed.OVERRIDE_TEXT)


def whole_word(haystack: Column, needle: Column) -> Column:
    """Case-insensitive whole-word containment of a literal string column."""
    escaped = F.regexp_replace(F.lower(needle), r"(?U)([^\w\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), escaped, F.lit(r"(?!\w)"))
    return F.regexp_like(haystack, pattern)


def sentences_to_markdown(sents: Column) -> Column:
    """Render ``array<struct<text,block,heading>>`` as Markdown, in order."""

    def add(acc: Column, s: Column) -> Column:
        text = F.trim(s["text"])
        has_heading = F.coalesce(s["heading"], F.lit("")) != ""
        given = F.coalesce(s["block"], F.lit("continue"))
        block = F.when(has_heading & (given == "continue"), F.lit("paragraph")).otherwise(given)
        out = F.when(has_heading, F.concat(acc["out"], F.lit("\n\n### "), s["heading"])).otherwise(
            acc["out"]
        )
        number = F.when(has_heading, F.lit(0)).otherwise(acc["n"])
        return F.struct(
            F.when(block == "bullet", F.concat(out, F.lit("\n- "), text))
            .when(
                block == "numbered",
                F.concat(out, F.lit("\n"), (number + 1).cast("string"), F.lit(". "), text),
            )
            .when((block == "paragraph") | (out == ""), F.concat(out, F.lit("\n\n"), text))
            .otherwise(F.concat(out, F.lit(" "), text))
            .alias("out"),
            F.when(block == "bullet", number)
            .when(block == "numbered", number + 1)
            .when((block == "paragraph") | (out == ""), F.lit(0))
            .otherwise(number)
            .alias("n"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    joined = F.aggregate(sents, start, add, lambda acc: acc["out"])
    return F.regexp_replace(joined, r"^\s+|\s+$", "")
