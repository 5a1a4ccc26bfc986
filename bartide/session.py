"""Session settings shared by the bench, the tests and jobs on a cluster."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: rows that one task of a wide window stage is given
TASK_ROWS = 1 << 18
RANK_BUCKETS_KEY = "spark.bartide.rank.buckets"


def build_session(app: str = "bartide", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE and UTC. On a cluster `master` and partitions come from spark-submit."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees (spark.checkpoint.dir). Without that setting a temporary folder, in local mode only: on
    a cluster each machine would have its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bartide-"))
    return folder or context.getCheckpointDir()


_tables: ContextVar[dict | None] = ContextVar("tables of the query being built", default=None)


@contextmanager
def one_set_of_tables() -> Iterator[None]:
    """While a query is built here, functions marked `once` compute their table a single time."""
    token = _tables.set({})
    try:
        yield
    finally:
        _tables.reset(token)


def once(build: Callable[[SparkSession, str], DataFrame], store: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A table that several parts of a query read: checkpointed (by `store`) at its first use within `one_set_of_tables`, plain elsewhere."""
    @wraps(build)
    def table(spark: SparkSession, folder: str) -> DataFrame:
        tables = _tables.get()
        if tables is None:
            return build(spark, folder)
        key = (build.__module__, build.__name__, folder)
        if key not in tables:
            tables[key] = (store or cut_lineage)(build(spark, folder))
        return tables[key]
    return table


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder: what is read several times is computed once, and a lost executor
    does not replay the whole plan. A table that is cut already stays as it is."""
    if any(df is known for known in (_tables.get() or {}).values()):
        return df
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def cut_as_dealt(df: DataFrame) -> DataFrame:
    """`cut_lineage` that remembers by which key the rows are dealt and how they are sorted, so that windows by that key need no other exchange and sort.
    A checkpoint takes both from its plan, which tells them only where adaptive execution did not make it."""
    if any(df is known for known in (_tables.get() or {}).values()):
        return df
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut_lineage(df.select("*"))
    finally:
        conf.set(key, before)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` exchanged by `keys` into a number of partitions that grows with `rows`: a given number is not merged again into fewer large ones, and
    windows by these keys need no other exchange."""
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def rank_buckets(spark: SparkSession) -> int:
    """How many value buckets the rank of a large group is split into (see operators.ranking)."""
    return int(spark.conf.get(RANK_BUCKETS_KEY, "512"))
