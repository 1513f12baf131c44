"""The trace log as stored tables: a row per answered question and nine tables of its details.

Everything of one run (a batch of answered questions) lies below ``<table>/run=<run>/day=<day>``, so a
run is written on its own and readers of some days open only these.  A run counts once its marker is
written, after all its tables; what a failed writer left is not read, and is replaced when the run is
written again.  A run that is marked is not written again, so a retried write changes nothing.

Which traces a repair cycle has dealt with is kept beside them, by cycle and day, with the time the
cycle looked at; a trace that gets bad feedback after that is open again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType

from ..operators import mining, signals
from ..session import maybe_broadcast

TRACES = """trace_id {id}, kb_id string, user_id string, session_id string, query string, route string, status string, healed boolean,
is_eval boolean, created_at timestamp, groundedness double, contradiction double, coverage double, confidence double, llm_calls long,
tokens_in long, tokens_out long, latency_ms long, config_version long"""

DETAILS = {
    "trace_subqueries": "subq int, question string, answered boolean",
    "trace_evidence": "chunk_id string, doc_id {doc}, verdict string, subqs array<int>, origin string",
    "trace_claims": "sentence int, claim string, support string, supporting array<string>, contradicting array<string>",
    "trace_citations": "sentence int, chunk_id string, doc_id {doc}",
    "trace_heals": "round int, arm string",
    "trace_rescues": "subq int, origin string, chunk_id string, doc_id {doc}, url string, question string",
    "trace_rewrites": "subq int, queries array<string>",
    "trace_unsupported": "sentence string",
    "trace_steps": "step int, stage string, n long, error string",
}
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class TraceStore:
    """Traces and their details below ``root``; ``ids`` and ``docs`` are the types of trace and document ids."""

    def __init__(self, spark: SparkSession, root: str, ids: str = "string", docs: str = "string"):
        self.spark, self.root = spark, root.rstrip("/")
        kinds = {"id": ids, "doc": docs}
        self.schemas = {"traces": StructType.fromDDL(TRACES.format(**kinds))} | {
            name: StructType.fromDDL(f"trace_id {ids}, {columns.format(**kinds)}") for name, columns in DETAILS.items()
        }
        self._marks = StructType.fromDDL(f"trace_id {ids}, looked_at timestamp")

    # ---------------------------------------------------------------- files

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _place(self, table: str, part: str, value: str) -> str:
        if not _NAME.fullmatch(value):
            raise ValueError(f"{value!r} cannot name a {part}: letters, digits, '_', '.' and '-' only")
        return f"{self.root}/{table}/{part}={value}"

    def _read(self, table: str, schema: StructType, part: str, since: date | None) -> DataFrame:
        full = StructType([*schema.fields]).add(part, StringType()).add("day", DateType())
        path = f"{self.root}/{table}"
        rows = self.spark.read.schema(full).parquet(path) if self._exists(path) else self.spark.createDataFrame([], full)
        return rows if since is None else rows.where(F.col("day") >= F.lit(since))

    @staticmethod
    def _typed(rows: DataFrame, schema: StructType) -> list:
        """The columns of ``schema``; one that ``rows`` lacks is null, others are left out."""
        have = set(rows.columns)
        return [(F.col(f"`{x.name}`") if x.name in have else F.lit(None)).cast(x.dataType).alias(x.name) for x in schema]

    # ---------------------------------------------------------------- writing

    def has(self, run: str) -> bool:
        return self._exists(self._place("runs", "run", run) + "/_SUCCESS")

    def write(self, run: str, traces: DataFrame, details: Mapping[str, DataFrame]) -> bool:
        """Store a run; False if it was stored before.  Details of traces the run does not hold are left out.

        ``traces`` need trace_id and created_at; a trace without a time lies under no day and is still read.
        """
        unknown = set(details) - set(DETAILS)
        if unknown:
            raise ValueError(f"no such tables of the trace log: {sorted(unknown)}")
        if self.has(run):
            return False

        def put(rows: DataFrame, table: str) -> str:
            path = self._place(table, "run", run)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(path)
            return path

        rows = traces.select(*self._typed(traces, self.schemas["traces"])).withColumn("day", F.to_date("created_at"))
        stored = put(rows, "traces")
        schema = StructType([*self.schemas["traces"].fields]).add("day", DateType())
        days = self.spark.read.schema(schema).parquet(stored).select("trace_id", "day")
        for table, found in details.items():
            typed = found.select(*self._typed(found, self.schemas[table]))
            put(typed.join(days, "trace_id").select(*self.schemas[table].names, "day"), table)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._place("runs", "run", run))
        return True

    def mark_mined(self, cycle: str, mined: DataFrame, looked_at: datetime) -> None:
        """Say that a cycle has dealt with these traces (trace_id, created_at) at that time; marking again changes nothing."""
        path = self._place("mined", "cycle", cycle)
        if self._exists(path + "/_SUCCESS"):
            return
        rows = mined.select("trace_id", F.lit(looked_at).cast("timestamp").alias("looked_at"), F.to_date("created_at").alias("day"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(path)

    # ---------------------------------------------------------------- reading

    def _kept(self, rows: DataFrame) -> DataFrame:
        if not self._exists(f"{self.root}/runs"):
            return rows.where(F.lit(False))
        marks = self.spark.read.schema("id long, run string").parquet(f"{self.root}/runs").select("run").distinct()
        return rows.join(maybe_broadcast(marks), "run", "left_semi")

    def detail(self, table: str, since: date | None = None) -> DataFrame:
        """A table of details over all stored runs, or over the days from ``since`` on."""
        return self._kept(self._read(table, self.schemas[table], "run", since)).select(*self.schemas[table].names)

    def traces(self, feedback: DataFrame | None = None, since: date | None = None) -> DataFrame:
        """All traces with ``negative_signal`` and ``diagnosed``.

        ``feedback``: trace_id, kind, rating, ts.  A trace is diagnosed if it was clean from the start or a
        cycle has dealt with it, unless bad feedback came after that.
        """
        rows = self._kept(self._read("traces", self.schemas["traces"], "run", since)).select(*self.schemas["traces"].names)
        marks = self._read("mined", self._marks, "cycle", since)
        dealt = marks.groupBy("trace_id").agg(F.max("looked_at").alias("_looked"))
        rows = rows.join(dealt, "trace_id", "left")
        if feedback is None:
            rows = rows.withColumn("_bad", F.lit(None).cast("timestamp"))
        else:
            bad = feedback.where(signals.is_bad()).groupBy("trace_id").agg(F.max("ts").alias("_bad"))
            rows = rows.join(bad, "trace_id", "left")
        calm = F.col("_bad").isNull()
        dealt_with = F.coalesce(F.col("_looked") >= F.col("_bad"), F.col("_looked").isNotNull() & calm)
        diagnosed = F.coalesce(mining.initially_diagnosed(), F.lit(False)) & calm | dealt_with
        return rows.withColumn("negative_signal", ~calm).withColumn("diagnosed", diagnosed).drop("_looked", "_bad")
