"""Shared pieces of the corpus operators: words, scratch tables, shipping code to executors."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import netloom

# Executors may not have this package on their path: functions travel with the plan.
cloudpickle.register_pickle_by_value(netloom)

#: A word, in Java, RE2 and Python regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
WORD_PY = re.compile(WORD)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words of a non-null text: blanks are unified, then every run of them is one gap."""
    blank = F.translate(c, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " ", -1), lambda x: x != "")).cast("long")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after whose last batch a worker gives the memory that it has freed back to the system; workers live on for
    later tasks, and what allocators hold on to counts against their executor."""

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return outer


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="netloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def _shuffles_given_up(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends, not when the driver happens to collect its garbage. Its
    result is in a table or a checkpoint by then. Executors that are lost meanwhile are made up for as ever."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path itself, as Spark's JVM has them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def _written_to(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_given_up(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: cuts lineage, survives lost executors. The table goes
    when the session's JVM ends."""
    path = f"{scratch_dir(df.sparkSession)}/netloom/{name}-{uuid.uuid4().hex}"
    out = _written_to(df, path)
    fs, at = _path(df.sparkSession, path)
    fs.deleteOnExit(at)
    return out


class Scratch:
    """Tables between the steps of an operator, in the shared folder. They are deleted when the block ends, so what
    leaves it is written() first."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_dir(spark)}/netloom/steps-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.made = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{name}-{self.made}"
        self.paths.setdefault(name, []).append(path)
        return _written_to(df, path)

    def counted(self, df: DataFrame, name: str, rows: Column) -> tuple[DataFrame, int]:
        """The table, and for how many of its rows the condition holds, which the same job counts."""
        seen = Observation()
        out = self.written(df.observe(seen, F.count_if(rows).alias("n")), name)
        return out, seen.get.get("n", 0)

    def replaced(self, df: DataFrame, name: str) -> DataFrame:
        """The table in place of those of this name before, of which df may have been made."""
        before = self.paths.pop(name, [])
        out = self.written(df, name)
        for path in before:
            self._delete(path)
        return out

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, which no later step reads."""
        for name in names:
            for path in self.paths.pop(name, []):
                self._delete(path)

    def _delete(self, path: str) -> None:
        fs, at = _path(self.spark, path)
        fs.delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """A small frame inside an operator, written and read again."""
    return written(df, "kept")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add; column names compare without case in Spark."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
