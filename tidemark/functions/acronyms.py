"""Acronym definitions as array expressions: ``Single Sign-On (SSO)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let

_WORD = r"[A-Za-z][A-Za-z\-]*"
_PAIRS = "array<struct<full:string,acronym:string>>"


def acronyms(doc_text: Column) -> Column:
    """(full, acronym) where the words before a bracket spell it by their initials.

    A word spells one letter for each of its hyphenated parts, so a bracket of n letters needs
    n words before it at most.
    """
    found = F.regexp_extract_all(doc_text, F.lit(f"{fixed.ACRONYM}|{_WORD}"), F.lit(0))

    def spelled(marks: Column) -> Column:
        # a bracket counts as a plain word for the brackets after it
        words = F.transform(marks, lambda w: F.btrim(w, F.lit("()")))

        def defined(mark: Column, at: Column) -> Column:
            name = F.btrim(mark, F.lit("()"))

            def last(n: Column) -> Column:
                taken = F.slice(words, at - n + 1, n)
                initials = F.regexp_replace(F.regexp_replace(F.array_join(taken, " "), r"-+", " "), r"(?:^|\s)\s*(\S)\S*", "$1")
                return F.when(F.upper(F.regexp_replace(initials, r"\s", "")) == name, F.struct(F.array_join(taken, " ").alias("full"), name.alias("acronym")))

            most = F.least(F.length(name), at)
            tries = F.when(mark.startswith("(") & (at > 0), F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
            return F.filter(F.transform(tries, last), lambda p: p.isNotNull())

        return F.flatten(F.transform(marks, defined))

    none = F.array().cast(_PAIRS)
    return F.when(doc_text.rlike(fixed.ACRONYM), let(found, spelled).cast(_PAIRS)).when(doc_text.isNotNull(), none)
