"""What the operators of this subpackage share: tables, stages on shared storage, words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD_PATTERN)
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1024
#: Bytes of keys that are broadcast at most.
BROADCAST_BYTES = 32_000_000
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and let no batch of texts hold
    more than ``BATCH_ROWS`` rows: a worker's memory follows the batch."""
    context = spark.sparkContext
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessera-ship-")  # the driver serves it as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "tessera.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._tessera_shipped = True


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Batches of so many rows for what is run meanwhile: for narrow rows, of which many fit."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system. Workers live on between
    tasks, and what their allocators keep counts against the executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """The same function of batches, which gives memory back when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of
    our own, which only a session on one machine can have."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark itself resolves it."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()
    return re.sub(r"^file:/+", "file:///", found)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str, paths: list[str] | None = None, compact: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage
    that survives lost executors. The path is added to ``paths``, for :func:`discard`.
    ``compact`` writes with two tasks for each core of the cluster, however many shuffle
    partitions there are: for tables much smaller than the documents."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if compact else df).write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(rows: DataFrame) -> int:
    """About the bytes that rows take in memory: twice their length as JSON."""
    return 2 * (rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0)


def by_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``keys``, a staged table: by broadcast while the keys are measured to be
    few, so that long rows do not move, else by a shuffle."""
    few = bytes_of(keys) <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that no pending result reads any more."""
    for path in paths:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    paths.clear()


def fold_of(doc_id: str = "doc_id", parts: int = 5):
    """Fold of a document: crc32 of its id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


def fold_value(doc_id: int, parts: int) -> int:
    """The same fold in Python."""
    return zlib.crc32(str(doc_id).encode()) % parts


def id_text(column: str = "doc_id"):
    """An id on its way to Python, as text: pandas would make floats of whole numbers beside nulls."""
    return F.col(column).cast("bigint").cast("string").alias("doc_id")


def id_values(texts):
    """The ids back, as a pandas array of whole numbers and nulls."""
    import pandas as pd

    return pd.array([None if t is None else int(t) for t in texts], dtype="Int64")


def words_of(text: str) -> list[str]:
    """Words of a text with A-Z lower-cased."""
    return WORD_RE.findall(text.translate(ASCII_LOWER))
