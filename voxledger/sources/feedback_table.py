"""The feedback table: create, scan, load, append, upsert; CSV in and out."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.session import COMPRESSION, drop_shuffles, files, folders, make_folder, materialize, remove, rename

CSV = {
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
COLUMN_DDL = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in S.FEEDBACK)


# So many ids are sent to where rows lie, instead of rows being shuffled by id.
FEW_IDS = 50_000

VERSION = "version-"
COMMITS = "_commits"


def _commits(spark: SparkSession, root: str) -> list[str]:
    """Numbers of the committed versions of a table, oldest first."""
    return folders(spark, f"{root}/{COMMITS}")


def _committed(spark: SparkSession, root: str, number: str) -> str:
    """Folder of a committed version."""
    return f"{root}/{spark.read.text(f'{root}/{COMMITS}/{number}').first()[0]}"


def current_path(spark: SparkSession, root: str) -> str:
    """Where the table's rows lie: what the last commit names, or the root while it was never overwritten."""
    commits = _commits(spark, root)
    return _committed(spark, root, commits[-1]) if commits else root


def _places(spark: SparkSession, table: str) -> tuple[str, str]:
    """Root of a table and the folder its name points to."""
    at = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"].rstrip("/")
    parent, _, last = at.rpartition("/")
    return (parent if last.startswith(VERSION) else at), at


def point_to_current(spark: SparkSession, table: str) -> str:
    """Let the name follow the last commit, also one whose job died before it could; returns the root."""
    root, at = _places(spark, table)
    path = current_path(spark, root)
    if path != at:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    return root


def scan_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The whole table by its root; filters and column choice downstream reach the files."""
    return spark.read.schema(S.FEEDBACK).parquet(current_path(spark, path))


def scan_feedback_jdbc(spark: SparkSession, lower_id: int, upper_id: int, partitions: int, **options: str) -> DataFrame:
    """The table in a relational database, read in parallel id ranges."""
    reader = spark.read.format("jdbc").options(**options)
    reader = reader.option("partitionColumn", "id").option("numPartitions", partitions)
    return to_feedback(reader.option("lowerBound", lower_id).option("upperBound", upper_id).load())


def create_feedback_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """Create the table unless it exists."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMN_DDL}) USING parquet OPTIONS (compression '{COMPRESSION}'){where}")


def to_feedback(df: DataFrame) -> DataFrame:
    """Project any frame onto the table's columns; absent ones and nulls take their defaults, a missing time is now."""
    defaults = {
        "source": F.lit(""),
        "created_at": F.localtimestamp(),
        "raw_text": F.lit(""),
        "clean_text": F.lit(""),
        "category": F.lit(S.FALLBACK_CATEGORY),
        "sentiment": F.lit(S.FALLBACK_SENTIMENT),
        "urgency_score": F.lit(S.FALLBACK_URGENCY),
        "priority_score": F.lit(0.0),
    }
    return df.select(
        *[
            F.coalesce(*[c for c in (F.col(f.name) if f.name in df.columns else None, defaults.get(f.name, F.lit(None))) if c is not None])
            .cast(f.dataType)
            .alias(f.name)
            for f in S.FEEDBACK
        ]
    )


def load_append(df: DataFrame, table: str) -> None:
    """Insert rows into the committed version as they come: sorting whole texts would write a large load to disk twice."""
    point_to_current(df.sparkSession, table)
    with drop_shuffles(df.sparkSession):
        to_feedback(df).write.insertInto(table)


def load_overwrite(df: DataFrame, table: str) -> None:
    """Replace all rows by a new version below the table's root.

    One rename of a numbered manifest commits it, for readers by path and by name
    alike: appends and later overwrites first let the name follow the last commit. Of
    two overwrites at once the second to commit fails and changes nothing. The version
    before stays for readers that have begun; older ones are deleted, also the files
    first written at the root.
    """
    spark = df.sparkSession
    root = point_to_current(spark, table)
    before = _commits(spark, root)
    number = f"{int(before[-1]) + 1 if before else 1:09d}"
    folder = f"{VERSION}{number}-{uuid.uuid4().hex[:8]}"
    with drop_shuffles(spark):
        to_feedback(df).write.parquet(f"{root}/{folder}", compression=COMPRESSION)
    aside = f"{root}/_aside-{uuid.uuid4().hex}"
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.text(aside)
    commit(spark, root, aside, number)
    point_to_current(spark, table)
    for old in before[:-1]:
        remove(spark, _committed(spark, root, old))
        remove(spark, f"{root}/{COMMITS}/{old}")
    if before:
        for name in files(spark, root):
            remove(spark, f"{root}/{name}")


def commit(spark: SparkSession, root: str, manifest: str, number: str) -> None:
    """Make a manifest the table's next version."""
    make_folder(spark, f"{root}/{COMMITS}")
    if not rename(spark, manifest, f"{root}/{COMMITS}/{number}"):
        remove(spark, manifest)
        raise RuntimeError(f"version {number} of {root} was committed by another job")


def delivered_ids(incoming: DataFrame, stored: DataFrame, order: str = "id") -> DataFrame:
    """Each id of a delivery, written once: its first ``order``, how many rows hold that (``n``) and the id (``rows``), and whether it is ``stored``.

    Only ids and their order are read and moved. Each task counts equal ones before the
    shuffle, so an id repeated a billion times is not a hot group. Stored ids are first
    narrowed to those of the delivery, so a small delivery does not shuffle the table.
    """
    identified = incoming.filter("external_id IS NOT NULL").groupBy("external_id", F.col(order).alias("first"))
    counted = identified.agg(F.count(F.lit(1)).alias("n")).groupBy("external_id")
    firsts = counted.agg(F.min(F.struct("first", "n")).alias("at"), F.sum("n").alias("rows"))
    ids = stored.select("external_id").filter("external_id IS NOT NULL")
    met = ids.join(firsts.select("external_id"), "external_id", "left_semi").distinct().withColumn("stored", F.lit(True))
    known = firsts.join(met, "external_id", "left")
    return materialize(known.select("external_id", "at.*", "rows", F.coalesce("stored", F.lit(False)).alias("stored")), "delivered")


def new_rows(incoming: DataFrame, stored: DataFrame, order: str = "id") -> DataFrame:
    """Incoming rows whose ``external_id`` is not stored yet, one per id: the first by ``order``.

    Rows without an id always pass and are not moved. The others are told by the ids to
    take or by those to leave, whichever are fewer; where these are few they are sent to the
    rows, which are not shuffled. The joins keep or drop whole rows, so Spark may do them
    before texts are attached. Only where several rows of an id come first together is one
    of them picked.
    """
    delivered = delivered_ids(incoming, stored, order)
    alone, repeated, tied = "not stored AND rows = 1", "not stored AND rows > 1 AND n = 1", "not stored AND n > 1"
    counts = delivered.agg(*(F.count_if(F.expr(kind)).alias(name) for name, kind in (("alone", alone), ("repeated", repeated), ("tied", tied))), F.count(F.lit(1)).alias("all"))
    found = counts.first()
    identified = incoming.filter("external_id IS NOT NULL")

    def sent(ids: DataFrame, count: int) -> DataFrame:
        return F.broadcast(ids) if count <= FEW_IDS else ids

    def met(kind: str, count: int) -> DataFrame:
        ids = delivered.filter(kind).select(F.col("external_id").alias("_met"), "first")
        same = (F.col("external_id") == F.col("_met")) & F.col(order).eqNullSafe(F.col("first"))
        return identified.join(sent(ids, count), same, "left_semi")

    parts = [incoming.filter("external_id IS NULL")]
    others = found["all"] - found["alone"]
    if others < found["alone"]:
        left = sent(delivered.filter(f"not ({alone})").select("external_id"), others)
        parts.append(identified.join(left, "external_id", "left_anti").select(*incoming.columns))
        parts += [met(repeated, found["repeated"])] if found["repeated"] else []
    elif found["alone"] + found["repeated"]:
        parts.append(met("not stored AND n = 1", found["alone"] + found["repeated"]))
    if found["tied"]:
        parts.append(met(tied, found["tied"]).dropDuplicates(["external_id"]))
    return reduce(DataFrame.unionByName, parts)


def upsert_new_only(incoming: DataFrame, table: str, order: str = "id") -> None:
    """Insert what is new and leave stored rows untouched.

    Rows that hold the keys in the table's types are chosen as they come, so that Spark
    may choose below the caller's joins; absent columns are filled in for what is new.
    """
    types = {f.name: f.dataType for f in incoming.schema}
    keyed = all(types.get(f.name) == f.dataType for f in S.FEEDBACK if f.name in ("external_id", order))
    load_append(new_rows(incoming if keyed else to_feedback(incoming), incoming.sparkSession.table(table), order), table)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; quotes and line breaks inside values survive.

    One part file per task, or a single file on request for small results.
    """
    out = df.coalesce(1) if single_file else df
    out.write.options(header=True, quoteAll=True, **CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # Only a text that cannot occur stands for null, so an empty text stays empty.
    return spark.read.schema(schema).options(header=True, multiLine=True, nullValue="\0", **CSV).csv(path)


def write_raw_csv(rows: DataFrame, path: str) -> None:
    write_csv(rows.select("source", "raw_text", "created_at"), path)
