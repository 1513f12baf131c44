"""The versioned chunks as a stored table, of which an operation rewrites only the partitions it touches.

Partitions are (kb_id, status, slice), the slice being a hash of the document: a workspace with a third of
all rows is many partitions, and readers of live chunks never open retired ones.  An operation
reads the slices of its documents, works out their new rows with the functions of ``corpus``, and
stores these in a journal, as the partitions they are to be, before it puts them in place by renaming.
Whoever comes next finishes what a failed writer had made ready; an operation is known by its id, so one
that is tried again once done changes nothing.  One writer at a time.

No texts are shuffled: a task writes the partitions it has rows of, so a partition is as many files as
tasks had rows for it, ``TASKS`` a core at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut_lineage, maybe_broadcast
from . import corpus, search

PLACE = ["kb_id", "status", "slice"]
SLICES = 64
TASKS = 4  # a core: the most tasks that write, and so the most files of a partition


def _measured(documents: DataFrame) -> DataFrame:
    """A row per document, stored and broadcast if it is small: then the chunks' texts stay where they are."""
    return maybe_broadcast(cut_lineage(documents, "documents"))


class ChunkStore:
    """Chunks (kb_id, doc_id, doc_version, status and any others) below ``root``."""

    def __init__(self, spark: SparkSession, root: str, slices: int = SLICES):
        self.spark, self.root, self.slices = spark, root.rstrip("/"), slices

    # ---------------------------------------------------------------- files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _mark(self, path: str) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)

    def _marked(self, path: str) -> bool:
        return self._exists(f"{path}/_SUCCESS")

    def _partitions(self, path: str) -> list[str]:
        """The partition folders below ``path`` that are there, as kb_id=.../status=.../slice=...; names alone are listed."""
        found = [""]
        for _ in PLACE:
            below = []
            for name in found:
                fs, at = self._fs(f"{path}/{name}" if name else path)
                below += [f"{name}/{x.getPath().getName()}".lstrip("/") for x in (fs.listStatus(at) if fs.exists(at) else ()) if x.isDirectory() and "=" in x.getPath().getName()]
            found = below
        return found

    # ---------------------------------------------------------------- reading

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64("kb_id", "doc_id"), F.lit(self.slices)).cast("int")

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        tasks = TASKS * self.spark.sparkContext.defaultParallelism
        kinds = {"compression": "zstd", "partitionOverwriteMode": "static"}
        rows.coalesce(tasks).write.mode(mode).options(**kinds).partitionBy(*PLACE).parquet(path)

    def _stored(self) -> DataFrame:
        found = self.spark.read.parquet(f"{self.root}/data").schema
        # partition values are text in paths, and a kb_id must not become a number by its looks
        schema = StructType([StructField(x.name, StringType()) if x.name in ("kb_id", "status") else x for x in found])
        return self.spark.read.schema(schema).parquet(f"{self.root}/data")

    def chunks(self, *statuses: str) -> DataFrame:
        """All chunks, or those of some statuses alone: a filter on partitions."""
        self.recover()
        rows = self._stored()
        return (rows.where(F.col("status").isin(*statuses)) if statuses else rows).drop("slice")

    def live(self, docs: DataFrame) -> DataFrame:
        """A4, with the documents' titles in place of any the chunks carry; retired partitions are not listed for reading."""
        return search.live_chunks(self.chunks("active", "staged").drop("title"), docs)

    # ---------------------------------------------------------------- writing

    def create(self, chunks: DataFrame) -> ChunkStore:
        self._write(chunks.withColumn("slice", self._slice()), f"{self.root}/data", "errorifexists")
        return self

    def rewrite(self, op: str, docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows of the slices that ``docs`` (kb_id, doc_id) lie in by ``change`` of them.

        ``change`` must leave other documents' rows as they are.
        """
        self.recover()
        journal = f"{self.root}/journal/{op}"
        if self._marked(f"{journal}/done"):
            return
        touched = docs.select("kb_id", self._slice().alias("slice")).distinct()
        touched.write.mode("overwrite").parquet(f"{journal}/slices")
        touched = self.spark.read.schema(touched.schema).parquet(f"{journal}/slices")
        # the join is on partition columns: with a small side Spark prunes the scan by it
        before = self._stored().join(touched, ["kb_id", "slice"], "left_semi")
        after = change(before.drop("slice")).withColumn("slice", self._slice())
        self._write(after, f"{journal}/rows", "overwrite")
        # what holds rows and will hold none any more is known before anything is moved
        made = set(self._partitions(f"{journal}/rows"))
        slices = {(r["kb_id"], r["slice"]) for r in touched.toLocalIterator()}
        left = [p for p in self._partitions(f"{self.root}/data") if p not in made and self._place(p) in slices]
        self.spark.createDataFrame([(p,) for p in left], "path string").coalesce(1).write.mode("overwrite").parquet(f"{journal}/left")
        self._mark(f"{journal}/ready")
        self._apply(journal)

    def _place(self, partition: str) -> tuple[str, int]:
        """kb_id and slice of a partition's folder."""
        unescaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        values = [x.split("=", 1)[1] for x in partition.split("/")]
        return unescaped(values[0]), int(values[2])

    def _apply(self, journal: str) -> None:
        # a partition is moved whole, and what was moved is no longer in the journal: a second try goes on where the first ended
        for row in self.spark.read.schema("path string").parquet(f"{journal}/left").toLocalIterator():
            fs, at = self._fs(f"{self.root}/data/{row['path']}")
            fs.delete(at, True)
        for partition in self._partitions(f"{journal}/rows"):
            fs, to = self._fs(f"{self.root}/data/{partition}")
            fs.delete(to, True)
            fs.mkdirs(to.getParent())
            if not fs.rename(self._fs(f"{journal}/rows/{partition}")[1], to):
                raise OSError(f"{partition} of {journal} was not put in place")
        self.spark.catalog.refreshByPath(f"{self.root}/data")
        self._mark(f"{journal}/done")

    def recover(self) -> None:
        """Finishes an operation that was made ready but not put in place."""
        fs, at = self._fs(f"{self.root}/journal")
        if not fs.exists(at):
            return
        for status in fs.listStatus(at):
            journal = status.getPath().toString()
            if self._marked(f"{journal}/ready") and not self._marked(f"{journal}/done"):
                self._apply(journal)

    # ---------------------------------------------------------------- operations

    def _named(self, docs: DataFrame) -> DataFrame:
        """kb_id and doc_id of documents named by doc_id alone or by both; reads two columns."""
        if "kb_id" in docs.columns:
            return docs.select("kb_id", "doc_id")
        return self._stored().select("kb_id", "doc_id").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").distinct()

    def add(self, op: str, chunks: DataFrame) -> None:
        """New rows, such as a new version; of equal chunk, version and status the new ones stay."""
        key = ["kb_id", "doc_id", "chunk_id", "doc_version", "status"]
        new = chunks.select(*self.chunks().columns)
        self.rewrite(op, chunks, lambda rows: rows.join(new.select(*key).distinct(), key, "left_anti").select(*new.columns).unionByName(new))

    def activate(self, op: str, targets: DataFrame) -> None:
        """C4: ``targets`` has doc_id, version and, if known, kb_id."""
        self.rewrite(op, self._named(targets), lambda rows: corpus.activate_versions(rows, _measured(targets.select("doc_id", "version")), _measured))

    def stage(self, op: str, staged: DataFrame) -> None:
        """C5: ``staged`` rows take the place of their documents' former staged copies."""
        docs, new = staged.select("kb_id", "doc_id").distinct(), staged
        self.rewrite(op, docs, lambda rows: corpus.discard_staged(rows, docs, _measured).unionByName(new.select(*rows.columns)))

    def promote(self, op: str) -> None:
        """C6: every staged version becomes the live one; only slices with staged rows are read whole."""
        staged = self._stored().where(F.col("status") == "staged").select("kb_id", "doc_id").distinct()
        self.rewrite(op, staged, lambda rows: corpus.promote_staged(rows, _measured))

    def discard(self, op: str, docs: DataFrame | None = None) -> None:
        named = self._stored().where(F.col("status") == "staged").select("kb_id", "doc_id").distinct() if docs is None else self._named(docs)
        self.rewrite(op, named, lambda rows: corpus.discard_staged(rows, docs, _measured))

    def roll_back(self, op: str, docs: DataFrame) -> None:
        """C7."""
        self.rewrite(op, self._named(docs), lambda rows: corpus.roll_back(rows, docs, _measured))
