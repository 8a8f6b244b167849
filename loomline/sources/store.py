"""Tables as Parquet folders: atomic replacement by documents, upserts, deletes, lists, resuming."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.conf import EngineConf
from loomline.functions import stages
from loomline.schemas import TABLES, schema_of

#: Tables that belong to a document and go with it.
OWNED = ("pages", "chunks", "events", "observations", "instructions", "edges", "appears_in", "query_runs")
#: Those of them that only grow.
APPENDED = ("query_runs",)


def upsert_documents(held: DataFrame, new: DataFrame) -> DataFrame:
    """Held documents with the new ones; a known id takes the new title only."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns))
    both = held.join(n, held["id"] == n["n_id"], "full")
    cols = [F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) if c == "title" else F.when(F.col("id").isNotNull(), F.col(c)).otherwise(F.col(f"n_{c}") if f"n_{c}" in n.columns else F.lit(None)).alias(c) for c in held.columns]
    return both.select(*cols)


def replaced(held: DataFrame, new: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Held rows of other documents, and the new rows."""
    return held.join(doc_ids.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def without(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of documents that are not deleted."""
    return table.join(deleted.select("doc_id"), "doc_id", "left_anti")


def document_list(documents: DataFrame, chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Documents, newest first, with their numbers of chunks and events."""
    c = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunks"))
    e = events.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("events"))
    out = documents.join(c, "id", "left").join(e, "id", "left").na.fill(0, ["chunks", "events"])
    return out.withColumns({"naive_ready": F.col("chunks") > 0, "timeline_ready": F.col("events") > 0}).orderBy(F.desc("uploaded_at"), "id")


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def observation_list(observations: DataFrame, doc_id: str, limit: int = 20) -> DataFrame:
    return observations.where(F.col("doc_id") == doc_id).orderBy("page_start", "window_id").limit(limit)


def titles(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, title``; documents without a title go by their id."""
    d = documents.select(F.col("id").alias("doc_id"), "title")
    return ids.join(d, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "doc_id").alias("title"))


def healthy(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


class Store:
    """The tables of one engine.

    A table is a folder of generations, of which the last one counts; a new one is written aside and renamed into place, so readers see the
    old table or the new one. Rows of tables that belong to documents lie in folders by a hash of ``doc_id`` (their number does not grow with the documents) and
    have a version; a log of heads says which version of a document counts. Replacing the rows of any number of documents appends rows and then
    one file of heads, which makes all of them current at once. ``compact`` drops what no longer counts.
    """

    def __init__(self, spark: SparkSession, conf: EngineConf):
        self.spark, self.conf = spark, conf
        self.version = 0

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _generations(self, name: str) -> list[int]:
        fs, at = self._fs(self.conf.table(name))
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.removeprefix("gen-")) for x in found if x.startswith("gen-"))

    def _at(self, name: str, part: str = "rows") -> str:
        """The folder of the current generation; the first one of a table that was never written."""
        return f"{self.conf.table(name)}/gen-{(self._generations(name) or [0])[-1]}/{part}"

    def _next_version(self) -> int:
        self.version = max(self.version + 1, time.time_ns())
        return self.version

    def exists(self, name: str) -> bool:
        return self._exists(self._at(name))

    def read(self, name: str, doc_ids: DataFrame | str | None = None) -> DataFrame:
        """A table, or its rows of some documents or of one; one that was never written is empty."""
        if not self.exists(name):
            out = self.spark.createDataFrame([], schema_of(name))
        elif name not in OWNED:
            out = self.spark.read.schema(TABLES[name]).parquet(self._at(name))
        else:
            rows = self.spark.read.schema(f"{TABLES[name]}, version long, bucket int").parquet(self._at(name))
            if isinstance(doc_ids, str):
                rows = rows.where(F.col("bucket") == self._bucket(F.lit(doc_ids)))
            out = rows
            if self._exists(self._at(name, "heads")):
                heads = self.spark.read.schema("doc_id string, version long").parquet(self._at(name, "heads")).groupBy("doc_id").agg(F.max("version").alias("head"))
                now = F.col("version") == F.col("head") if name not in APPENDED else F.col("head").isNull() | (F.col("version") > F.col("head"))
                out = rows.join(heads, "doc_id", "left").where(now)
            elif name not in APPENDED:  # rows whose heads were never written do not count
                out = rows.limit(0)
            out = out.select(*schema_of(name).fieldNames())
        if isinstance(doc_ids, str):
            return out.where(F.col("doc_id") == doc_ids)
        return out if doc_ids is None else out.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def _bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.conf.buckets)).cast("int")

    def _put_rows(self, name: str, rows: DataFrame, version: int) -> None:
        schema = schema_of(name)
        whole = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        placed = whole.withColumns({"version": F.lit(version).cast("long"), "bucket": self._bucket(F.col("doc_id"))})
        # documents of one bucket may go to several tasks, so that no task has to take a whole bucket
        placed.repartition("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").write.mode("append").partitionBy("bucket").parquet(self._at(name))

    def replace(self, name: str, rows: DataFrame, doc_ids: DataFrame | None = None) -> None:
        """Write rows; the documents that they belong to, or those of ``doc_ids``, lose their former rows, all at once."""
        version = self._next_version()
        self._put_rows(name, rows, version)
        if doc_ids is None:
            doc_ids = self.spark.read.schema(f"{TABLES[name]}, version long, bucket int").parquet(self._at(name)).where(F.col("version") == version)
        self._put_heads(name, doc_ids, version)

    def _put_heads(self, name: str, doc_ids: DataFrame, version: int) -> None:
        heads = doc_ids.select("doc_id").distinct().withColumn("version", F.lit(version).cast("long"))
        heads.coalesce(1).write.mode("append").parquet(self._at(name, "heads"))

    def append(self, name: str, rows: DataFrame) -> None:
        if name in OWNED:
            self._put_rows(name, rows, self._next_version())
        else:
            rows.select(*schema_of(name).fieldNames()).write.mode("append").parquet(self._at(name))

    def swap(self, name: str, rows: DataFrame) -> None:
        """Replace a whole small table."""
        self._new_generation(name, {"rows": rows})

    def _new_generation(self, name: str, parts: dict[str, DataFrame], by: str | None = None) -> None:
        """Written aside, renamed into place; the generation before it stays for those who read it now."""
        numbers = self._generations(name)
        beside = f"{self.conf.table(name)}/new-{uuid.uuid4().hex}"
        for part, rows in parts.items():
            (rows.write.partitionBy(by) if by and part == "rows" else rows.write).parquet(f"{beside}/{part}")
        fs, at = self._fs(beside)
        if not fs.rename(at, self._fs(f"{self.conf.table(name)}/gen-{(numbers or [0])[-1] + 1}")[1]):
            raise OSError(f"{name}: the new generation was not put into place")
        for n in numbers[:-1]:
            fs.delete(self._fs(f"{self.conf.table(name)}/gen-{n}")[1], True)

    def compact(self, name: str) -> None:
        """Rewrite a table's current rows without what no longer counts."""
        if not self.exists(name):
            return
        if name not in OWNED:
            self.swap(name, self.read(name).coalesce(1))
            return
        version = self._next_version()
        rows = self.read(name).withColumns({"version": F.lit(version).cast("long"), "bucket": self._bucket(F.col("doc_id"))})
        parts = {"rows": rows.repartition("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id")}
        if name not in APPENDED:
            parts["heads"] = rows.select("doc_id", "version").distinct().coalesce(1)
        self._new_generation(name, parts, "bucket")

    def put_documents(self, new: DataFrame) -> None:
        self.swap("documents", upsert_documents(self.read("documents"), _as_documents(new)))

    def delete(self, doc_id: str) -> None:
        """Remove a document and what belongs to it. Its jobs stay."""
        self.swap("documents", self.read("documents").where(F.col("id") != doc_id))
        gone = self.spark.range(1).select(F.lit(doc_id).alias("doc_id"))
        for name in OWNED:
            if self.exists(name):
                self._put_heads(name, gone, self._next_version())

    def save_taxonomies(self, taxonomies: DataFrame) -> None:
        """``taxonomies(doc_id, taxonomy)`` has an array of stages for each of some documents."""
        t = taxonomies.select(F.col("doc_id").alias("t_id"), F.col("taxonomy").alias("t_tax"))
        d = self.read("documents").join(t, F.col("id") == F.col("t_id"), "left")
        self.swap("documents", d.withColumn("taxonomy", F.coalesce("t_tax", "taxonomy")).drop("t_id", "t_tax"))

    def taxonomies(self, doc_ids: DataFrame) -> DataFrame:
        """``doc_id, taxonomy``: each document's stages normalised, or the default ones."""
        d = self.read("documents").select(F.col("id").alias("doc_id"), "taxonomy")
        own = doc_ids.select("doc_id").distinct().join(d, "doc_id", "left")
        return own.select("doc_id", F.when(F.coalesce(F.size("taxonomy"), F.lit(0)) > 0, stages.normalize(F.col("taxonomy"))).otherwise(stages.default_stages()).alias("taxonomy"))


def _as_documents(new: DataFrame) -> DataFrame:
    schema = schema_of("documents")
    return new.select(*(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def latest(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """Of each key the first row in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
