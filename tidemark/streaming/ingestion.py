"""Incremental ingestion: each batch is compared with the current documents and adds what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import block_index, corpus, parsing
from ..session import cut_lineage, maybe_broadcast

KEY = ["kb_id", "uri"]
_DOCS = "kb_id string, uri string, doc_id string, version int, content_hash string, title string, mime string, status string, error string"


class CorpusLog:
    """Documents, chunks and (if asked for) postings below ``root``, kept current batch by batch.

    ``documents/batch=n`` and ``chunks/batch=n`` hold what batch n added; a repeated batch replaces its own
    folders.  ``current-n`` is the state of all documents after batch n, one row each, partitioned by a hash
    of their key.  A batch reads, of the current table, the slices its keys lie in, and the log
    written since; not the history.  The log is folded into a new current table when it has
    grown to ``fold`` of its size, so folding costs a fixed number of times what was written.
    A version is live when its document's current row names it: activation is that one row.
    """

    def __init__(self, spark: SparkSession, root: str, slices: int = 64, fold: float = 0.25, keep_index: bool = False):
        self.spark, self.root, self.slices, self.fold, self.keep_index = spark, root.rstrip("/"), slices, fold, keep_index

    # ---------------------------------------------------------------- files

    def _listed(self, folder: str, prefix: str) -> list[int]:
        """The numbers n of finished folders ``prefix``n."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(at)]
        done = [n for n, p in names if n.startswith(prefix) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[len(prefix) :]) for n in done)

    def _bytes(self, folders: list[str]) -> int:
        total = 0
        for folder in folders:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            total += at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        return total

    def _since(self, before: int | None) -> tuple[int | None, list[int]]:
        """The newest current table made before batch ``before``, and the batches logged after it."""
        known = [n for n in self._listed(self.root, "current-") if before is None or n < before]
        last = known[-1] if known else None
        logged = self._listed(f"{self.root}/documents", "batch=")
        return last, [n for n in logged if (last is None or n > last) and (before is None or n < before)]

    def _log(self, table: str, batches: list[int], schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{table}/batch={n}" for n in batches])

    # ---------------------------------------------------------------- reading

    def documents(self, before: int | None = None, slices: list[int] | None = None) -> DataFrame | None:
        """The current row of every document, as of batch ``before``; of some slices alone, if given."""
        last, batches = self._since(before)
        parts = []
        if last is not None:
            parts.append(self.spark.read.schema(f"{_DOCS}, slice int").parquet(f"{self.root}/current-{last}"))
        if batches:
            parts.append(self._log("documents", batches, _DOCS).withColumn("slice", self._slice()))
        if not parts:
            return None
        if slices is not None:
            parts = [p.where(F.col("slice").isin(slices)) for p in parts]
        rows = reduce(DataFrame.unionByName, parts).drop("slice")
        if not batches:
            return rows
        keep = [c for c in rows.columns if c not in KEY]
        return rows.groupBy(*KEY).agg(F.max_by(F.struct(*keep), "version").alias("d")).select(*KEY, "d.*")

    def live_chunks(self) -> DataFrame:
        now = self.documents().where(F.col("status") == "active").select("doc_id", F.col("version").alias("doc_version"))
        return self._log("chunks", self._listed(f"{self.root}/chunks", "batch=")).join(now, ["doc_id", "doc_version"])

    def index(self) -> block_index.Index:
        return block_index.Index(self.spark, f"{self.root}/index", "string")

    def _slice(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.slices)).cast("int")

    # ---------------------------------------------------------------- writing

    def fold_log(self, before: int | None = None, force: bool = False) -> bool:
        """Puts the log into a new current table, if it is due."""
        last, batches = self._since(before)
        if not batches:
            return False
        size = self._bytes([f"{self.root}/documents/batch={n}" for n in batches])
        if not force and last is not None and size < self.fold * self._bytes([f"{self.root}/current-{last}"]):
            return False
        rows = self.documents(before).withColumn("slice", self._slice())
        rows.repartition("slice").sortWithinPartitions(*KEY).write.mode("overwrite").partitionBy("slice").parquet(f"{self.root}/current-{batches[-1]}")
        return True

    def known(self, batch: DataFrame, before: int) -> DataFrame:
        """The current rows of the documents of ``batch`` (kb_id, uri): a read of their slices alone."""
        asked = sorted(r["s"] for r in batch.select(self._slice().alias("s")).distinct().collect())  # ``slices`` numbers at most
        rows = self.documents(before, asked)
        if rows is None:
            return self.spark.createDataFrame([], _DOCS)
        return rows.join(maybe_broadcast(batch.select(*KEY).distinct()), KEY, "left_semi")

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        """Detect changes, then parse, chunk and add versions of what changed.

        ``batch``: kb_id, uri, name, content.
        """
        self.fold_log(batch_id)
        found = batch.withColumn("content_hash", text.content_hash(F.col("content"))).withColumn("mime", parsing.mime_of(F.col("name")))
        known = self.known(batch, batch_id)
        ahead = corpus.detect_changes(found.withColumn("parse_error", F.lit(None).cast("string")), known)
        todo = ahead.where(F.col("outcome") != "unchanged").drop("parse_error", "outcome")
        new_id = F.substring(F.sha2(F.concat_ws("|", *KEY), 256), 1, 32)
        parsed = parsing.parse_documents(
            todo.withColumn("doc_id", F.coalesce("doc_id", new_id)).withColumn("version", F.coalesce("version", F.lit(0)) + 1)
        )
        parsed = cut_lineage(parsed, "parsed")  # documents and chunks both come from it
        docs = parsed.select(
            *KEY, "doc_id", "version", "content_hash", "title", "mime",
            F.when(F.col("parse_error").isNull(), "active").otherwise("error").alias("status"),
            F.col("parse_error").alias("error"),
        )
        chunks = parsing.chunk_documents(parsed).withColumnRenamed("version", "doc_version")
        chunks = chunks.withColumn("chunk_id", F.concat_ws("-", "doc_id", "doc_version", "ord"))
        chunks.write.mode("overwrite").parquet(f"{self.root}/chunks/batch={batch_id}")
        if self.keep_index:
            self._index(docs, self._log("chunks", [batch_id]), batch_id)
        # the documents come last: from here on the batch counts
        docs.write.mode("overwrite").parquet(f"{self.root}/documents/batch={batch_id}")

    def _index(self, docs: DataFrame, chunks: DataFrame, batch_id: int) -> None:
        """Puts the changed documents' postings in place of their former ones; doing it twice gives the same."""
        index = self.index()
        if block_index.exists(index):
            block_index.replace(index, chunks, docs)
        else:
            block_index.build(chunks, index.path)
