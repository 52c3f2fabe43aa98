"""Session helpers: worker import path, shared scratch folder, intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lodestone")
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
    } | conf
    for key, value in base.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers started from now on."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # Workers give freed arrays back to the system instead of keeping them for later.
    env |= {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only in local mode, where it may be unset."""
    set_dir = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


#: Folders of intermediate tables made in this process, and the session that made them.
_made: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def made() -> set[str]:
    """Folders of intermediate tables that are there."""
    return set(_made)


def drop_since(spark: SparkSession, before: set[str], *keep: str) -> None:
    """Delete intermediate tables made since ``before`` but those to ``keep``."""
    for path in made() - before - set(keep):
        drop_path(spark, path)


@atexit.register
def clear() -> None:
    """Delete the intermediate tables of this process; results that read them must have been written by then. Also done at its end."""
    while _made:
        path, spark = _made.popitem()
        with contextlib.suppress(Exception):  # a table may be gone, or the store with the session
            drop_path(spark, path)


#: Spark's setting that deletes a plan's shuffle files when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has run: a table that is written isn't computed again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with tidy(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.path = path
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    target, files = _file(spark, path)
    files.delete(target, True)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target, context = jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc
    return target, target.getFileSystem(context.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file(spark, path)
    return files.exists(target)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename, or fail: a store may refuse without an error of its own."""
    source, files = _file(spark, path)
    target, _ = _file(spark, to)
    if files.exists(target) or not files.rename(source, target):
        raise OSError(f"{path} can't be moved to {to}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any store that Spark reads."""
    target, files = _file(spark, path)
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then put it there; a reader finds the old or the new one."""
    target, files = _file(spark, path)
    fresh, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, target, over)
