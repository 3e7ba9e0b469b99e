"""File and table sources and sinks of the domain."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlattice import schemas
from adlattice.operators.catalog import project_specs

PLACEHOLDER = "__POPULATE_FROM_SERVER__"
COLLECTIONS = ("spec", "job", "analysis", "compare", "psd_object_analysis")


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of one or many JSON array files."""
    return project_specs(spark.read.schema(schemas.SPEC_RAW).option("multiLine", True).json(path))


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """Layer rows of tree files, in depth-first order; groups have no box."""
    return layer_rows(spark.read.schema(schemas.LAYER_FILE).option("multiLine", True).json(path))


def layer_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("jobId").alias("job_id"), F.col("psdSize.width").alias("psd_w"), F.col("psdSize.height").alias("psd_h"),
                       F.posexplode("layers").alias("ord", "l")).select(
        "job_id", "psd_w", "psd_h", "ord", "l.name", "l.kind", "l.role", "l.depth", (F.col("l.kind") == "group").alias("is_group"), "l.visible", "l.children_count",
        *[F.when(F.col("l.kind") != "group", F.col(f"l.bbox.{a}")).alias(b) for a, b in (("left", "x1"), ("top", "y1"), ("right", "x2"), ("bottom", "y2"))])


def read_events(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """Stage events of line-delimited JSON logs; a broken line is kept in ``bad_line``."""
    schema = schemas.EVENT + ", bad_line string"
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if streaming else spark.read
    raw = reader.schema(schema).option("columnNameOfCorruptRecord", "bad_line").json(path)
    return raw.select(F.col("timestamp").alias("ts"), F.col("jobId").alias("job_id"), F.col("pipelineVersion").alias("version"), "stage", "event",
                      "message", "metrics", F.col("failureCode").alias("failure_code"), "artifact", "bad_line")


def read_jobs(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Job messages as a stream of JSON files."""
    raw = spark.readStream.schema(schemas.JOB_MESSAGE).option("maxFilesPerTrigger", max_files).json(path)
    return raw.withColumnsRenamed({"jobId": "job_id", "specIds": "spec_ids", "targetMedia": "target_media", "psdPath": "psd_path",
                                   "pipelineVersion": "pipeline_version", "pipelineType": "pipeline_type"})


class Tables:
    """The five collections as Parquet tables below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if name not in COLLECTIONS:
            raise ValueError(f"unknown collection {name}")
        return f"{self.root}/{name}"

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def save(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Appends rows stamped with creation and update time."""
        now = F.current_timestamp()
        rows.withColumns({"created_at": now, "updated_at": now}).write.mode("append").partitionBy(*partition_by).parquet(self._path(name))


def lookup(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Latest row per wanted key (by ``updated_at``); a blank key finds nothing."""
    asked = wanted.select(key).filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct()
    rest = [c for c in table.columns if c != key]
    hits = table.join(asked, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*rest), "updated_at").alias("_r"))
    return hits.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def export_ready(analyses: DataFrame, analysis_id: str | None = None, sha256: str | None = None) -> DataFrame:
    """READY analyses, newest first, with the file each goes to; placeholders left in a document fail it.

    ``analyses``: analysis_id, sha256, status, updated_at, document (JSON text).
    """
    ready = analyses.filter("status = 'READY'")
    if analysis_id:
        ready = ready.filter(F.col("analysis_id") == analysis_id)
    if sha256:
        ready = ready.filter(F.col("sha256") == sha256)
    usable = (F.length("sha256") >= 32) & (F.col("sha256") != PLACEHOLDER)
    name = F.when(F.coalesce(usable, F.lit(False)), F.col("sha256")).otherwise(F.col("analysis_id"))
    return ready.select("analysis_id", F.concat(name, F.lit(".json")).alias("file_name"), "updated_at",
                        F.contains("document", F.lit(PLACEHOLDER)).alias("has_placeholder"), "document").orderBy(F.col("updated_at").desc(), "analysis_id")


def write_export(exported: DataFrame, path: str) -> None:
    exported.filter("NOT has_placeholder").select("analysis_id", "file_name", "document").write.mode("overwrite").json(path)


def layout_rows(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON line per placed layer with its layout's header: keys, mode, target size, number of layers.

    A layout is a set of lines of one partition value, not one gathered document, so a layout may have any size.
    """
    heads = placed.groupBy(*keys).agg(F.count("*").alias("layer_count"))
    return placed.join(heads, list(keys))


def write_layout(placed: DataFrame, path: str, keys: Sequence[str]) -> None:
    layout_rows(placed, keys).write.mode("overwrite").partitionBy(keys[0]).json(path)


def write_bundle(manifest: DataFrame, path: str) -> None:
    """Archive entries partitioned by job."""
    manifest.write.mode("overwrite").partitionBy("job_id").json(path)


def store_raw(answers: DataFrame, path: str) -> None:
    """Raw model answers, appended as they came: job_id, model, type, content."""
    answers.select("job_id", "model", "type", "content").write.mode("append").parquet(path)

