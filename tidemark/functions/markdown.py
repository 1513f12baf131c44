"""Markdown to blocks by two regular expressions, inside the JVM.

The outer expression finds what stands on its own (fenced code, headings) and regions of
text lines; the inner one finds the runs of table, list and prose lines in a region.  All
repetitions are possessive, so long documents need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_FLAGS = "(?mdU)"
_GAP = r"[^\S\n]"  # white space within a line
_FENCE = rf"^{_GAP}*(```|~~~)[^\n]*+(?:\n(?!{_GAP}*\1)[^\n]*+)*+(?:\n{_GAP}*\1[^\n]*+)?"
_ATX = rf"#{{1,6}}{_GAP}++\S"
_UNDERLINED = rf"^{_GAP}*\S[^\n]*+\n{_GAP}*(?:=++|-++){_GAP}*$"
_RULE = rf"^{_GAP}*+\|{_GAP}*:?-{{2,}}[^\n]*+\n?"  # before any other row it opens nothing
_REGION = rf"(?:^{_GAP}*+(?!```|~~~|{_ATX})\S[^\n]*+\n?)++"
_OUTER = rf"{_FLAGS}{_FENCE}|^{_GAP}*+{_ATX}[^\n]*+|{_UNDERLINED}|{_RULE}|{_REGION}"

_ITEM = rf"(?:[-*+]|\d+[.)]){_GAP}++\S"
_TABLE = rf"(?:^{_GAP}*+\|[^\n]*+\n?)++"
_LIST = rf"(?:^{_GAP}*+{_ITEM}[^\n]*+(?:\n[ \t]{_GAP}*+(?!\||{_ITEM})\S[^\n]*+)*+\n?)++"
_PROSE = rf"(?:^{_GAP}*+(?!\||{_ITEM})\S[^\n]*+\n?)++"
_INNER = rf"{_FLAGS}{_TABLE}|{_LIST}|{_PROSE}"

_FRONT = rf"(?dU)\A{_GAP}*---{_GAP}*\n(?:(?!{_GAP}*---{_GAP}*(?:\n|\z))[^\n]*+\n)*+{_GAP}*---{_GAP}*(?:\n|\z)"


def _find_all(source: Column, pattern: str) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(0))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _block(kind: Column | str, body: Column, level: Column | int = 0) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    level = F.lit(level) if isinstance(level, int) else level.cast("int")
    return F.struct(kind.alias("kind"), body.alias("text"), level.alias("level"), F.lit(None).cast("int").alias("page"))


def _run(run: Column) -> Column:
    """A run of lines of one sort as a block."""
    lines = F.regexp_replace(_trim(run), rf"(?dU){_GAP}*\n{_GAP}*", "\n")
    rows = F.filter(F.split(lines, "\n"), lambda row: ~row.rlike(r"(?U)^\|?\s*:?-{2,}"))
    items = F.regexp_replace(lines, rf"(?dU)\n(?!{_ITEM})", " ")
    return (
        F.when(run.rlike(rf"(?U)^{_GAP}*\|"), _block("table", F.array_join(rows, "\n")))
        .when(run.rlike(rf"(?U)^{_GAP}*{_ITEM}"), _block("list", items))
        .otherwise(_block("para", F.replace(lines, F.lit("\n"), F.lit(" "))))
    )


def _part(part: Column) -> Column:
    """Blocks of one match of the outer expression."""
    line = _trim(part)
    title = F.regexp_extract(line, r"(?sU)^#{1,6}\s+(.*?)\s*#*\s*$", 1)
    level = F.length(F.regexp_extract(line, "^#*", 0))
    first, under = _trim(F.substring_index(line, "\n", 1)), _trim(F.substring_index(line, "\n", -1))
    return (
        F.when(line.rlike("^(```|~~~)"), F.array(_block("code", part)))
        .when(line.rlike(f"(?U)^{_ATX}"), F.array(_block("heading", title, level)))
        .when(part.rlike(rf"(?mdU)\A{_UNDERLINED}(?!\n)\z"), F.array(_block("heading", first, F.when(under.startswith("="), 1).otherwise(2))))
        .otherwise(F.transform(_find_all(part, _INNER), _run))
    )


def markdown_blocks(source: Column) -> Column:
    """struct(title, blocks): the title of the front matter, if any, and all blocks that have text."""

    def parse(plain: Column) -> Column:
        front = F.regexp_extract(plain, _FRONT, 0)
        given = F.element_at(_find_all(front, r"(?mdi)^title:[^\n]*"), -1)
        title = F.btrim(_trim(F.regexp_replace(F.when(F.size(_find_all(front, r"(?mdi)^title:")) > 0, given), "(?i)^title:", "")), F.lit("\"'"))
        body = F.substring(plain, F.length(front) + 1, F.length(plain))
        blocks = F.flatten(F.transform(_find_all(body, _OUTER), _part))
        return F.struct(F.coalesce(title, F.lit("")).alias("title"), F.filter(blocks, lambda b: _trim(b["text"]) != "").alias("blocks"))

    return let(F.regexp_replace(source, "\r\n", "\n"), parse)
