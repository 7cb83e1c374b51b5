"""Incremental runs: the archive of what was done, and the content-addressed cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def selected(inputs: DataFrame, archive: DataFrame, force: bool = False) -> DataFrame:
    """``name, action`` of every input: force, new, retry, changed, out_missing or skip."""
    a = archive.select("name", F.col("status").alias("a_status"), F.col("size").alias("a_size"), F.col("mtime_ns").alias("a_mtime"))
    same = (F.col("size") == F.col("a_size")) & (F.col("mtime_ns") == F.col("a_mtime"))
    action = (
        F.when(F.lit(force), "force")
        .when(F.col("a_status").isNull(), "new")
        .when(F.col("a_status") == "failed", "retry")
        .when((F.col("a_status") == "success") & ~same, "changed")
        .when((F.col("a_status") == "success") & ~F.col("output_present"), "out_missing")
        .when(F.col("a_status") == "success", "skip")
        .otherwise("retry")
    )
    return inputs.join(a, "name", "left").select("name", action.alias("action"))


def pruned(archive: DataFrame, inputs: DataFrame) -> DataFrame:
    """Archive records whose input is still there."""
    return archive.join(inputs.select("name"), "name", "left_semi")


def upserted(archive: DataFrame, results: DataFrame) -> DataFrame:
    """The archive with the records of a run in place of older ones of the same name."""
    both = archive.withColumn("age", F.lit(1)).unionByName(results.withColumn("age", F.lit(0)))
    newest = F.row_number().over(Window.partitionBy("name").orderBy("age"))
    return both.withColumn("place", newest).where("place = 1").drop("age", "place")


def cache_key(content: str, *settings: str):
    """SHA-1 of the content and the settings that the result depends on."""
    return F.sha1(F.concat_ws("|", F.coalesce(F.col(content).cast("string"), F.lit("")), *map(F.lit, settings)).cast("binary"))


def cache_misses(keyed: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache does not hold: the only ones to compute."""
    return keyed.join(cache, key, "left_anti")


def append_results(results: DataFrame, path: str) -> None:
    """Add computed rows to the cache; readers take the newest of a key."""
    results.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, key: str, written: str) -> DataFrame:
    """The newest cached row of every key, by the column ``written``; no cache yet, no rows."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{key} string")
    fields = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(fields, written).alias("row")).select("row.*")


def iso(stamp):
    """A time as text, to the second and with its offset."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssxxx")


RECORD = "struct<name:string,status:string,size:bigint,mtime_ns:bigint,error:string,updated_at:string>"


#: Records of one archive document at most, about.
DOCUMENT_RECORDS = 100_000


def archive_json(archive: DataFrame, parts: int = 1) -> DataFrame:
    """The archive as JSON documents in ``value``: version, time and the records by name, in order; one document,
    or ``parts`` of them by a hash of the name."""
    record = F.struct(*archive.columns)
    items = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", record.alias("record")))))
    grouped = archive.groupBy(F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part")) if parts > 1 else archive
    return grouped.agg(items.alias("items")).select(F.to_json(F.struct(F.lit(1).alias("version"), iso(F.current_timestamp()).alias("updated_at"), "items")).alias("value"))


def archive_rows(documents: DataFrame) -> DataFrame:
    """Records of archive documents in ``value``, whether they list records or map names to them.
    What is no JSON, or no record, gives no row."""
    mapped = F.map_values(F.from_json("value", f"items map<string,{RECORD}>")["items"])
    listed = F.from_json("value", f"items array<{RECORD}>")["items"]
    names = F.map_keys(F.from_json("value", f"items map<string,{RECORD}>")["items"])
    named = F.transform(F.arrays_zip(names.alias("n"), mapped.alias("r")), lambda p: p["r"].withField("name", F.coalesce(p["r"]["name"], p["n"])))
    rows = documents.select(F.explode(F.coalesce(named, listed)).alias("r")).where("r IS NOT NULL")
    return rows.select("r.*").where("name IS NOT NULL")


def write_archive(archive: DataFrame, path: str, records: int = DOCUMENT_RECORDS) -> None:
    """Overwrite the archive at a path: a file for each document of about ``records`` records."""
    parts = max(1, -(-archive.count() // records))
    archive_json(archive, parts).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archive documents at a path; missing or broken ones have none."""
    try:
        return archive_rows(spark.read.text(path, wholetext=True))
    except AnalysisException:
        return archive_rows(spark.createDataFrame([], "value string"))


def json_round_trip(archive: DataFrame) -> DataFrame:
    """The records of an archive by way of its documents, one for each status."""
    record = F.struct(*archive.columns)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", record.alias("record")))))
    documents = archive.groupBy("status", F.pmod(F.xxhash64("name"), F.lit(64)).alias("part")).agg(entries.alias("items")).select(F.to_json(F.struct(F.lit(1).alias("version"), "items")).alias("value"))
    return archive_rows(documents).select(*archive.columns)


def sizes_by_status(archive: DataFrame) -> DataFrame:
    """For each status the number of records, their size and the first name, from maps of name to size."""
    maps = archive.groupBy("status", F.pmod(F.xxhash64("name"), F.lit(64)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("name", "size"))).alias("sizes"))
    rows = maps.select("status", F.explode(F.map_entries("sizes")).alias("e"))
    return rows.groupBy("status").agg(F.count("*").alias("items"), F.sum("e.value").alias("total"), F.min("e.key").alias("first"))
