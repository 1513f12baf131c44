"""Reading corpus files, fetched pages and golden sets; writing traces and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.parsing import mime_of, suffix

GOLDEN = "id string, question string, expected_answer string, expected_doc_ids array<string>"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def list_files(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Supported files under a path: uri, name, mime, length, modified_at, error, content.

    Content is only read for rows that are kept, and the size test is pushed to the scan,
    so a file over the cap is listed as an error without being opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    name = file_name(F.col("path"))
    wanted = suffix(name).isin(*fixed.FILE_TYPES) & ~name.startswith(".") & ~name.startswith("~$")
    shape = [
        F.col("path").alias("uri"),
        name.alias("name"),
        mime_of(name).alias("mime"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    ]
    fits = files.where((F.col("length") <= max_bytes) & wanted)
    large = files.where((F.col("length") > max_bytes) & wanted)
    return fits.select(*shape, F.lit(None).cast("string").alias("error"), "content").unionByName(
        large.select(*shape, F.lit(f"file larger than {max_bytes} bytes").alias("error"), F.lit(None).cast("binary").alias("content"))
    )


def fetched_pages(pages: DataFrame, content_type: Column | None = None) -> DataFrame:
    """Pages already fetched (url, html) as files with a name and type from the address."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1))) if content_type is not None else F.lit("")
    path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    base = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([^/]*)$", 1)
    name = F.when(base == "", "index.html").otherwise(base)
    unknown = ~suffix(name).isin(*fixed.FILE_TYPES)
    ending = (
        F.when((kind == "application/pdf") & ~F.lower(name).endswith(".pdf"), ".pdf")
        .when(kind.isin("text/html", "") & unknown, ".html")
        .when((kind == "text/plain") & unknown, ".txt")
        .otherwise("")
    )
    named = pages.withColumn("name", F.concat(name, ending))
    return named.withColumn("mime", mime_of(F.col("name"))).withColumn("content", F.encode("html", "UTF-8"))


def read_golden(spark: SparkSession, path: str, kb_id: str) -> DataFrame:
    """Golden items from JSON lines; blank lines are skipped, a missing answer is empty."""
    rows = spark.read.schema(GOLDEN).json(path).where(F.col("question").isNotNull())
    return rows.select(
        F.lit(kb_id).alias("kb_id"),
        F.coalesce("id", F.sha2(F.concat_ws("|", F.lit(kb_id), "question"), 256)).alias("item_id"),
        "question",
        F.coalesce("expected_answer", F.lit("")).alias("expected_answer"),
        F.coalesce("expected_doc_ids", F.array().cast("array<string>")).alias("expected_doc_ids"),
        F.lit("import").alias("origin"),
        F.lit(True).alias("active"),
    )


def write_traces(traces: DataFrame, details: dict[str, DataFrame], path: str) -> None:
    """Traces and their child tables, each partitioned by day."""
    days = traces.select("trace_id", F.to_date("created_at").alias("day"))
    traces.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(f"{path}/traces")
    for name, rows in details.items():
        rows.join(days, "trace_id").write.mode("append").partitionBy("day").parquet(f"{path}/{name}")


def append_audit(rows: DataFrame, path: str) -> None:
    """``rows``: actor, action, target, created_at and a ``details`` map of strings."""
    rows.select("actor", "action", "target", "created_at", F.col("details").cast("map<string,string>")).write.mode(
        "append"
    ).parquet(path)
