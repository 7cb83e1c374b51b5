"""Tables written on the way: cuts in the lineage that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def arrow_uri(uri: str) -> str:
    """A folder's address as Arrow's file systems spell it: no empty host for local files, one scheme for S3."""
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri))


def cut(rows: DataFrame, tag: str, paths: list[str] | None = None) -> DataFrame:
    """``rows`` written as Parquet in the shared folder and read back. The path is added to ``paths``, for
    :func:`dropped`. Rows with a ``table_id`` are written in buckets of it, as many as a shuffle has partitions, so that
    what reads them meets by table without another shuffle; the catalog's entry is gone again at once."""
    spark = rows.sparkSession
    key = uuid.uuid4().hex[:12]
    path = f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}/{tag}-{key}"
    if paths is not None:
        paths.append(path)
    if "table_id" not in rows.columns:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"tessera_{tag}_{key}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "table_id").option("path", path).format("parquet").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no pending result reads any more."""
    for path in paths:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    paths.clear()
