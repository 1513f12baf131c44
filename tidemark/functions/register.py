"""Plug-in points: text functions for SQL, table functions, embedders and re-rankers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed, text
from .html import html_blocks


def _q(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _sql_functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body), all evaluated in the JVM."""
    stop = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
    cases = " ".join(
        f"WHEN endswith(w, '{s}') AND length(w) > {len(s) + 3} THEN "
        + (f"concat(left(w, length(w) - {len(s)}), 'y')" if s in fixed.STEM_TO_Y else f"left(w, length(w) - {len(s)})")
        for s in fixed.STEM_SUFFIXES
    )
    stem = f"CASE {cases} ELSE w END"
    words = f"transform(regexp_extract_all(t, {_q(fixed.TOKEN)}, 0), w -> lower(w))"
    tokens = f"transform(filter({words}, w -> NOT w IN ({stop})), w -> {stem})"
    space = r"[\s\x1c-\x1f]"
    cut = _q(rf"(?U)\n{space}*\n|(?<=[.!?]){space}+(?={fixed.SENTENCE_START})")
    tidy = f"trim(regexp_replace(s, {_q(f'(?U){space}+')}, ' '))"
    return {
        "td_stem": ("w STRING", "STRING", stem),
        "td_tokens": ("t STRING", "ARRAY<STRING>", tokens),
        "td_content_terms": ("t STRING", "ARRAY<STRING>", f"array_distinct(filter({tokens}, w -> length(w) > 1))"),
        "td_sentences": ("t STRING", "ARRAY<STRING>", f"filter(transform(split(t, {cut}), s -> {tidy}), s -> s <> '')"),
        "td_identifiers": (
            "t STRING",
            "ARRAY<STRING>",
            f"array_distinct(filter(transform(regexp_extract_all(t, {_q('(?U)' + fixed.QUOTED_OR_CODE)}, 0), s -> btrim(s, '\"')), s -> s <> ''))",
        ),
        "td_numbers": (
            "t STRING",
            "ARRAY<STRING>",
            f"array_distinct(transform(regexp_extract_all(t, {_q('(?U)' + fixed.NUMBER)}, 0), n -> replace(n, ',', '')))",
        ),
        "td_estimate_tokens": ("t STRING", "INT", "greatest(1, cast(floor(length(t) / 4) AS INT))"),
        "td_overlap": (
            "a ARRAY<STRING>, b ARRAY<STRING>",
            "DOUBLE",
            "CASE WHEN size(a) < 1 THEN 0D ELSE size(array_intersect(a, b)) / size(a) END",
        ),
        "td_jaccard": (
            "a ARRAY<STRING>, b ARRAY<STRING>",
            "DOUBLE",
            "CASE WHEN size(a) < 1 OR size(b) < 1 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
        ),
        "td_looks_like_override": ("t STRING", "BOOLEAN", f"regexp_like(t, {_q(fixed.OVERRIDE_TEXT)})"),
        "td_is_small_talk": ("t STRING", "BOOLEAN", f"regexp_like(trim(t), {_q(fixed.SMALL_TALK)}) AND length(t) <= 60"),
    }


def register_sql(spark: SparkSession) -> list[str]:
    """Make the text functions callable from SQL in this session; returns their names."""
    made = _sql_functions()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("td_html_blocks", F.arrow_udtf(_HtmlBlocks, returnType="key long, pos int, kind string, text string, level int"))
    return [*made, "td_html_blocks"]


class _HtmlBlocks:
    """``td_html_blocks(TABLE(SELECT id, html ...))``: the blocks of each page, a batch of pages at a time."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [
            (key, pos, kind, body, level)
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for pos, (kind, body, level, _) in enumerate(html_blocks(page or "")[1])
        ]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        yield pa.table({n: pa.array(c, k) for n, c, k in zip(("key", "pos", "kind", "text", "level"), columns, kinds, strict=True)})


# ------------------------------------------------------------------ embedders and re-rankers


def embed_with(rows: DataFrame, said: Column, embedder: Callable[[list[str]], Sequence[Sequence[float]]], model_id: str) -> DataFrame:
    """Adds embedding and embedding_model from any ``texts -> vectors`` function.

    It is called once per Arrow batch, so a model behind it loads once per task.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in embedder(texts.fillna("").tolist())])

    made = F.pandas_udf(run, "array<float>")(said)
    return rows.withColumn("embedding", made).withColumn("embedding_model", F.lit(model_id))


def rerank_with(
    candidates: DataFrame, question: Column, body: Column, scorer: Callable[[list[str], list[str]], Sequence[float]]
) -> DataFrame:
    """Adds ``rerank`` from ``scorer(questions, texts)`` and ``degraded``.

    Where the scorer fails, the lexical overlap stands in and ``degraded`` is true.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, texts in batches:
            try:
                scores = [float(s) for s in scorer(asked.tolist(), texts.tolist())]
            except Exception:  # noqa: BLE001 - any failure of the plug-in means the fallback
                scores = [None] * len(asked)
            yield pd.Series(scores, dtype="float64")

    model = F.pandas_udf(run, "double")(question, body)
    lexical = text.overlap(text.content_terms(question), text.content_terms(body))
    scored = candidates.withColumn("_model", model)
    missing = F.col("_model").isNull() | F.isnan("_model")
    return (
        scored.withColumn("rerank", F.when(missing, lexical).otherwise(F.col("_model")))
        .withColumn("degraded", missing)
        .drop("_model")
    )
