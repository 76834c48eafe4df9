"""High-water mark of a batch ingest, kept beside the data as a numbered log.

A mark is written aside and renamed to the next number, in one step: a job that dies
while saving leaves the old mark in place, and of two jobs that save at once one takes
the number after the other's. The highest number counts, whatever any clock says, so a
mark can be set back by saving an older one. Save after the rows are committed: rows are
then read twice at worst, and the upsert drops the second copy.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from voxledger.session import folders, remove, rename

MARK_TYPE = "since_utc double"
MARK = "mark-"
# Marks that stay: the one that counts, and one for readers that have begun.
KEPT = 2


def _marks(spark: SparkSession, path: str) -> list[str]:
    return [name for name in folders(spark, path) if name.startswith(MARK)]


def read_mark(spark: SparkSession, path: str) -> float | None:
    """The saved mark, or None when there is none or it cannot be read."""
    marks = _marks(spark, path)
    if not marks:
        return None
    try:
        row = spark.read.schema(MARK_TYPE).json(f"{path}/{marks[-1]}").first()
    except AnalysisException:
        return None
    return row[0] if row else None


def save_mark(mark: DataFrame, path: str) -> None:
    """Add a one-row ``since_utc`` frame to the log; null and 0 are not saved. Older marks are removed."""
    spark = mark.sparkSession
    kept = mark.select("since_utc").filter("since_utc IS NOT NULL AND since_utc <> 0").first()
    if kept is None:
        return
    aside = f"{path}/saving-{uuid.uuid4().hex}"
    spark.createDataFrame([tuple(kept)], MARK_TYPE).coalesce(1).write.json(aside)
    while True:
        marks = _marks(spark, path)
        number = int(marks[-1].removeprefix(MARK)) + 1 if marks else 1
        if rename(spark, aside, f"{path}/{MARK}{number:012d}"):
            break
    for old in marks[: len(marks) + 1 - KEPT]:
        remove(spark, f"{path}/{old}")
