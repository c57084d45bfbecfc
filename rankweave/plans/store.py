"""Tables that cut the lineage of an iteration, in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: What queries shuffle goes when they are done, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: dict[str, str] = {}


@contextlib.contextmanager
def clean_shuffles(spark: SparkSession):
    """Queries that run inside leave no shuffle files."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was) if was else spark.conf.unset(CLEANUP)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``; only local sessions without that setting get a base of their own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="rankweave-"))
    return f"{base.rstrip('/')}/rankweave-{uuid.uuid4().hex}"


class Tables:
    """Numbered Parquet tables below one shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = ship(spark), shared_dir(spark), 0

    def put(self, df: DataFrame, by: tuple[str, ...] = (), plain: bool = False) -> DataFrame:
        """``df`` as written and read back; with ``by``, in folders that filters on those columns prune.

        ``plain`` is for plans whose partitions are given and whose rows are large: nothing is left to
        adapt between stages, and Python functions get one row a batch.
        """
        self.n += 1
        path = f"{self.path}/{self.n:05d}"
        settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"} if plain else {}
        was = {k: self.spark.conf.get(k) for k in settings}
        for k, value in settings.items():
            self.spark.conf.set(k, value)
        try:
            with clean_shuffles(self.spark):
                df.write.partitionBy(*by).parquet(path)
        finally:
            for k, value in was.items():
                self.spark.conf.set(k, value)
        return self.spark.read.schema(df.schema).parquet(path)
