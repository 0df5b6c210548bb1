"""Session plumbing shared by every operator: where shared files go, and how executors get the code."""

from __future__ import annotations

import contextlib
import gc
import hashlib
import io
import itertools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.window import Window, WindowSpec

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors (once per application and content)."""
    files = sorted(_PACKAGE.rglob("*.py"))
    digest = hashlib.sha1(b"".join(str(p).encode() + p.read_bytes() for p in files)).hexdigest()[:12]
    sc = spark.sparkContext
    name = f"quadloom-{digest}.zip"
    if any(name in str(p) for p in sc._python_includes):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in files:
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    folder = os.path.abspath(tempfile.mkdtemp(prefix="quadloom"))
    path = os.path.realpath(folder) + "/" + name
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is
    unset. On a cluster the setting is needed: no machine's own folder will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="quadloom-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quadloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a shuffle that a task gets at most, where their number is known: some 100 MB of quads.
SHARE = 250_000


@contextlib.contextmanager
def shuffled(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside deal their shuffles to as many tasks as ``rows`` need. These are not joined by their bytes: IRIs
    shrink so much in shuffle files that a task of the usual size holds millions of rows."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // SHARE))
    new = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and that nothing reads any more."""
    for f in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/quadloom/" in f:
            delete(df.sparkSession, f)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, none if it does not exist."""
    fs, hadoop = _file_system(spark, path)
    return sorted(str(f.getPath()) for f in fs.listStatus(hadoop) if f.isDirectory()) if fs.exists(hadoop) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished plans: their shuffle files go with them, else at Spark's next periodic collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def running_window(order: str) -> WindowSpec:
    """All rows up to the current one, for tables of a row per file or task."""
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with a number behind it where a column has that name already."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        found = next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count())) if n.lower() not in used)
        used.add(found.lower())
        out.append(found)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Long texts make 10,000-row Arrow batches too large for a worker; lower the batch size once."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
