"""Tables that grow by batches: a batch is checked, staged and then listed in one step, so that a reader sees all of it or nothing.

A table is a folder with `parts` (immutable Parquet folders) and `lists` (numbered versions: which parts belong to the table and which batches it
has taken). A new version is renamed into place and never over an existing one, so of two writers one has to look again. A batch that comes a second
time changes nothing; a batch with nothing new writes nothing; one that contradicts what is stored leaves the table as it was.
Parts are merged in levels, as they come in, so a key has few versions and a read follows the number of keys, not of batches. Parts that no list
names any more are left for readers of older versions; `forget_old_parts` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bartide.session import cut_lineage

#: parts of one level that are merged into one of the next
MERGE_AT = 4


@dataclass
class Version:
    number: int = 0
    parts: list[dict] = field(default_factory=list)   # {"folder", "level"}, oldest first
    batches: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Outcome:
    """status: appended, repeated, nothing new or conflict; rows: how many were added or contradict."""

    status: str
    rows: int


def _hadoop(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, table: str) -> Version:
    """The latest version; an empty one where the table has none yet."""
    jvm, folder, fs = _hadoop(spark, f"{table}/lists")
    if not fs.exists(folder):
        return Version()
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    if not names:
        return Version()
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, names[-1]))
    try:
        content = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(int(names[-1].split(".")[0]), content["parts"], content["batches"])


def publish(spark: SparkSession, table: str, new: Version) -> bool:
    """Whether `new` became version new.number: False if another writer was first."""
    jvm, folder, fs = _hadoop(spark, f"{table}/lists")
    fs.mkdirs(folder)
    waiting = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    stream = fs.create(waiting, False)
    stream.write(bytearray(json.dumps({"parts": new.parts, "batches": new.batches}).encode()))
    stream.close()
    nothing = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:  # without OVERWRITE the rename fails where the version exists
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration()).rename(waiting, jvm.org.apache.hadoop.fs.Path(folder, f"{new.number:012d}.json"), nothing)
    except Exception as error:
        fs.delete(waiting, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def read(spark: SparkSession, table: str, schema: StructType, version: Version | None = None) -> DataFrame:
    """All rows of a version, with every version of a key (see `latest`)."""
    parts = (version or current(spark, table)).parts
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}/parts/{p['folder']}" for p in parts])


def _staged(rows: DataFrame, table: str) -> str:
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{table}/parts/{folder}")
    return folder


def append(spark: SparkSession, table: str, rows: DataFrame, batch: str, key: Sequence[str], values: Sequence[str], tolerance: float = 1e-4) -> Outcome:
    """Add the keys of `rows` that the table does not have, after its other keys were compared: where one of `values` is off by more than `tolerance` (as a
    share of what is stored), nothing is written. `batch` names the batch; one that was taken already is not looked at. `rows` has one row a key."""
    while True:
        version = current(spark, table)
        if batch in version.batches:
            return Outcome("repeated", 0)
        stored = read(spark, table, rows.schema, version).select(*key, F.struct(*values).alias("_old"))
        off = [F.abs(F.col(v) - F.col(f"_old.{v}")) > tolerance * F.abs(F.col(f"_old.{v}")) for v in values]
        unlike = [F.col(v).isNull() != F.col(f"_old.{v}").isNull() for v in values]
        wrong = F.col("_old").isNotNull() & F.coalesce(F.greatest(*[x.cast("int") for x in (*off, *unlike)]) > 0, F.lit(False))
        looked = cut_lineage(rows.join(stored, list(key), "left").withColumn("_wrong", wrong))
        counts = looked.agg(F.count_if("_wrong").alias("wrong"), F.count_if(F.col("_old").isNull()).alias("fresh")).first()
        if counts["wrong"]:
            return Outcome("conflict", counts["wrong"])
        if not counts["fresh"]:
            return Outcome("nothing new", 0)
        folder = _staged(looked.where(F.col("_old").isNull()).select(rows.columns), table)
        if publish(spark, table, Version(version.number + 1, [*version.parts, {"folder": folder, "level": 0}], [*version.batches, batch])):
            return Outcome("appended", counts["fresh"])
        # another writer was first: the staged folder belongs to no version; compare with what is stored now


def latest(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row a key, the one of the highest `order`."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in others])


def upsert(spark: SparkSession, table: str, rows: DataFrame, batch: str, key: Sequence[str], order: str) -> Outcome:
    """Add a version of each key of `rows`; readers take the one of the highest `order` (`read_latest`). When MERGE_AT parts of a level have come together
    they are merged into one of the next level with one version a key, so n batches leave fewer than MERGE_AT parts on each of log(n) levels."""
    while True:
        version = current(spark, table)
        if batch in version.batches:
            return Outcome("repeated", 0)
        parts = [*version.parts, {"folder": _staged(latest(rows, key, order), table), "level": 0}]
        while sum(p["level"] == parts[-1]["level"] for p in parts) >= MERGE_AT:
            level = parts[-1]["level"]
            merged = read(spark, table, rows.schema, Version(0, [p for p in parts if p["level"] == level]))
            folder = _staged(latest(merged, key, order), table)
            parts = [*[p for p in parts if p["level"] != level], {"folder": folder, "level": level + 1}]
        if publish(spark, table, Version(version.number + 1, parts, [*version.batches, batch])):
            return Outcome("appended", spark.read.parquet(f"{table}/parts/{parts[-1]['folder']}").count())


def read_latest(spark: SparkSession, table: str, schema: StructType, key: Sequence[str], order: str) -> DataFrame:
    return latest(read(spark, table, schema), key, order)


def forget_old_parts(spark: SparkSession, table: str) -> int:
    """Remove the parts that the current version does not name; the number of them. For times when nobody reads an older version or writes."""
    kept = {p["folder"] for p in current(spark, table).parts}
    jvm, folder, fs = _hadoop(spark, f"{table}/parts")
    old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in kept] if fs.exists(folder) else []
    for path in old:
        fs.delete(path, True)
    return len(old)
