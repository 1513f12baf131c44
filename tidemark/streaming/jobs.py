"""Streaming forms.  Each job reads an unbounded DataFrame and writes through
``foreachBatch`` or returns a streaming DataFrame; all state sits in checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed, text
from ..operators import signals
from ..session import shared_folder
from . import spans


def run_now(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None) -> None:
    """Process everything that is available, then stop.  State lies in RocksDB, its changes in the checkpoint."""
    spark = stream.sparkSession
    folder = checkpoint or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in spans.SETTINGS}
    for name, value in spans.SETTINGS.items():
        spark.conf.set(name, value)
    try:  # a stream takes the settings of its start along
        started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    started.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last value of each key among the batches written by :func:`batch_writer`."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


# ------------------------------------------------------------------ running aggregates


def daily_usage(traces: DataFrame, late: str = "1 day") -> DataFrame:
    """Running questions, verified answers and tokens per base and day.

    Rows later than the watermark are dropped, so state does not grow with time.
    """
    day = F.window("created_at", "1 day")
    live = traces.where(~F.col("is_eval")).withWatermark("created_at", late)
    return (
        live.groupBy(day, "kb_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "verified").alias("verified"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
        )
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kb_id", "n", "verified", "tokens_in", "tokens_out")
    )


def chunk_helpfulness(feedback: DataFrame) -> DataFrame:
    """Running good and bad weight per chunk; each row lists the chunks its answer cited."""
    weight = signals._weight()
    rows = feedback.withColumn("good", F.when(signals.is_good(), weight).otherwise(0.0)).withColumn(
        "bad", F.when(signals.is_bad(), weight).otherwise(0.0)
    )
    each = rows.select("good", "bad", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    return each.groupBy("chunk_id").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def version_totals(traces: DataFrame) -> DataFrame:
    """Running sums per config version, from which the canary statistics follow."""
    live = traces.where(~F.col("is_eval"))
    return live.groupBy("config_version").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("status") == "verified").cast("double")).alias("verified"),
        F.sum(F.col("negative_signal").cast("double")).alias("negative"),
        F.sum(F.coalesce("groundedness", F.lit(0.0))).alias("groundedness"),
    )


def totals_to_stats(totals: DataFrame) -> DataFrame:
    shares = [(F.col(c) / F.col("n")).alias(c) for c in ("verified", "negative", "groundedness")]
    return totals.select("config_version", "n", *shares)


def sessions(traces: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Questions of a user between pauses of ``gap``: begin, last question, count and verified ones.

    Batch or stream; a stream names how late rows may come, and drops those behind that.
    """
    rows = traces if late is None else traces.withWatermark("created_at", late)
    span = F.session_window("created_at", gap)
    grouped = rows.groupBy(span, "kb_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"), F.count_if(F.col("status") == "verified").alias("verified")
    )
    return grouped.select("kb_id", "user_id", F.col("session_window.start").alias("started_at"), "last_at", "n", "verified")


# ------------------------------------------------------------------ request rates


def rates_in_window(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Batch form: per request, the key's requests in the last ``seconds``, itself included.

    A request exactly ``seconds`` old still counts.  Time is cut into spans of that
    length; a span also sees the rows of the one before, so a busy key is many groups.
    """
    at = F.col("created_at").cast("double")
    span = F.floor(at / seconds)
    rows = requests.withColumn("_at", at).withColumn(
        "_s", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))
    )
    w = Window.partitionBy("key", "_s.span").orderBy("_at").rangeBetween(-seconds, 0)
    return rows.withColumn("n_recent", F.count(F.lit(1)).over(w)).where(F.col("_s.own")).drop("_at", "_s")


def over_limit(rates: DataFrame, limit: int) -> DataFrame:
    return rates.where(F.col("n_recent") > limit)


def rate_stream(requests: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Streaming form of :func:`rates_in_window`, for output mode update.

    A request is told its count when it comes, and again when one that came late changes it; the
    last count of each (:func:`latest`) is the batch form's.  Requests later than ``late`` are dropped.
    """
    kinds = dict(requests.dtypes)
    rows = spans.in_spans(requests.withWatermark("created_at", late), seconds, ["key"])
    kept = _schema(f"key {kinds['key']}, id {kinds['request_id']}, at long, own boolean")
    told = f"key {kinds['key']}, request_id {kinds['request_id']}, n_recent long"
    keyed = rows.select("slot", "span", "key", F.col("request_id").alias("id"), "at", "own", "created_at").groupBy("slot", "span")
    return keyed.transformWithStateInPandas(spans.Rates(kept, seconds * 1_000_000), told, "Update", "EventTime")


def rephrase_stream(
    traces: DataFrame, threshold: float = fixed.REPHRASE_JACCARD, window_s: int = fixed.REPHRASE_SECONDS, late: str = "10 minutes"
) -> DataFrame:
    """Streaming form of :func:`signals.rephrases`, for output mode update.

    A question is told what it rephrases when it comes, and again when one that came late stands
    between; without ``rephrase_of`` it does so no longer.  The last row of each question
    (:func:`latest`) with a ``rephrase_of`` is the batch form's.  Questions later than ``late`` are dropped.
    """
    kinds = dict(traces.dtypes)
    asked = traces.where("session_id is not null")
    if "is_eval" in traces.columns:
        asked = asked.where(~F.col("is_eval"))
    rows = asked.withWatermark("created_at", late).select(
        "kb_id",
        "session_id",
        F.col("trace_id").alias("id"),
        "created_at",
        F.lower(F.trim("query")).alias("said"),
        text.content_terms(F.col("query")).alias("terms"),
    )
    kept = _schema(f"kb_id {kinds['kb_id']}, session_id {kinds['session_id']}, id {kinds['trace_id']}, at long, own boolean, said string, terms array<string>")
    told = (
        f"kb_id {kinds['kb_id']}, session_id {kinds['session_id']}, trace_id {kinds['trace_id']}, "
        f"rephrase_of {kinds['trace_id']}, similarity double"
    )
    keyed = spans.in_spans(rows, window_s, ["kb_id", "session_id"]).groupBy("slot", "span")
    return keyed.transformWithStateInPandas(spans.Rephrases(kept, window_s * 1_000_000, threshold), told, "Update", "EventTime")


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
