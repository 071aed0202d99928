"""Session helpers shared by the corpus operators: scratch tables, package shipping, Arrow maps."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegraph-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    This cuts lineage with files that outlive any executor, and gives later joins real sizes. The shuffle
    files of the write go when it has ended. ``discard`` deletes the table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tidegraph/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidegraph_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._tidegraph_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="tidegraph-ship-"), "tidegraph_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(out)


def give_back() -> None:
    """Return memory that earlier tasks of this worker freed to the system; where it can't be done, nothing happens."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped first; each task begins with what earlier ones freed given back."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def byte_groups(batch: pa.RecordBatch, text: str, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``most`` bytes together, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if len(sizes) > begin:
        yield begin, len(sizes)


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def partitions_for(amount: int, each: int, least: int = 1) -> int:
    """Partitions that hold about ``each`` of ``amount``."""
    return max(least, -(-amount // each))
