"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Codec of what the library writes: texts take about half the room they take by default.
COMPRESSION = "zstd"

# Bytes of a batch for a Python worker. Beside a task's own rows, Spark and the worker each hold a few batches at once.
BATCH_BYTES = 4 << 20

# Stateful stream operators with timers need this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ship_by_value(module: str) -> None:
    """Send the functions of a module with the task, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(app: str = "voxledger", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings that decide results or bound memory, applied to a session we were handed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # JSON answers with a repeated key keep the last value.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.compression.codec", COMPRESSION)
    return spark


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session for what is run inside; dots are written as two underscores."""
    wanted = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drop_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of what is written inside go with the end of each write, instead of when the driver collects its garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the session names.

    Where none is named and the driver is the only process, as in tests, a
    temporary one serves the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="voxledger-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return os.path.join(shared_dir(spark), f"voxledger-{label}-{uuid.uuid4().hex}")


# Folders that the innermost open ``scratch`` has to remove; None where none is open.
_OPEN: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving, also after a failure, every intermediate result written inside.

    Frames made inside read them, so their rows must be collected or written before.
    """
    written: list[str] = []
    token = _OPEN.set(written)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in written:
            remove(spark, path)


def settle(spark: SparkSession, build: Callable[[], DataFrame | None], label: str, alike: Sequence[str] = ()) -> DataFrame | None:
    """The frame that ``build`` makes, if it makes one, written and read back; what was written on the way to it is removed."""
    path = scratch_folder(spark, label)
    with scratch(spark):
        df = build()
        return None if df is None else _stored(df, path, alike)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """As :func:`scratch_path`, for an intermediate result, which an open ``scratch`` removes."""
    path = scratch_path(spark, label)
    if (written := _OPEN.get()) is not None:
        written.append(path)
    return path


def _together(df: DataFrame, alike: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Columns whose values are alike in a row as one array, and the way back.

    Files hold the elements in turn, so that to the codec the second is nearly a copy of the first.
    """
    alike, columns = [c for c in alike if c in df.columns], df.columns
    if len({df.schema[c].dataType for c in alike}) != 1 or len(alike) == 1:
        return df, lambda stored: stored
    packed = df.select(*(c for c in columns if c not in alike), F.array(*alike).alias("_alike"))
    parts = [F.get("_alike", F.lit(alike.index(c))).alias(c) if c in alike else F.col(c) for c in columns]
    return packed, lambda stored: stored.select(*parts)


def _stored(df: DataFrame, path: str, alike: Sequence[str]) -> DataFrame:
    packed, unpacked = _together(df, alike)
    with drop_shuffles(df.sparkSession):
        packed.write.parquet(path, compression=COMPRESSION)
    return unpacked(df.sparkSession.read.schema(packed.schema).parquet(path))


def materialize(df: DataFrame, label: str, alike: Sequence[str] = ()) -> DataFrame:
    """Write once to the shared folder and read back, so later uses do not recompute.

    ``alike`` names columns of one type, such as a text and its cleaned form, that are
    stored side by side where the frame has them; whoever reads one of them reads all.
    """
    return _stored(df, scratch_folder(df.sparkSession, label), alike)


def materialize_buckets(df: DataFrame, key: str, label: str, alike: Sequence[str] = ()) -> DataFrame:
    """As :func:`materialize`, in buckets of ``key``: groupings and joins by it find the rows in place.

    The catalog names the folder only until its reader is made.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, label)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    packed, unpacked = _together(df, alike)
    placed = packed.repartition(buckets, key).sortWithinPartitions(key)
    with drop_shuffles(spark):
        placed.write.bucketBy(buckets, key).options(path=path, compression=COMPRESSION).saveAsTable(name, format="parquet")
    kept = unpacked(spark.table(name))
    spark.sql(f"DROP TABLE {name}")
    return kept


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path, on whatever file system it lies."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place) if status.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer needed, wherever it lies."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file or folder in one step; False, and nothing done, where the new name is taken."""
    system, place = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    # A folder that is renamed to an existing one would be moved into it.
    return not system.exists(target) and system.rename(place, target)


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right below a path."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place) if status.isFile())


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.mkdirs(place)
