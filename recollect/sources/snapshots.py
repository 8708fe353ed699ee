"""Tables that lie in a folder a tenant, and changes that write those tenants' folders alone.

A change reads the folders of the tenants that it names, works on them as on any table, and replaces each by what comes
out (dynamic partition overwrite); a tenant that comes out empty loses its folder. Other tenants' files stay as they are.
The new files are written beside the table before old ones go, so a task or executor that is lost costs its own work;
a driver that is lost while it moves folders leaves some tenants changed and others not, and the change can run again.
One writer a table at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations
from ..operators.cuts import cut

BY = "org_id"


def _dealt(df: DataFrame, by: str, key: str, files: int) -> DataFrame:
    """A tenant's rows in so many files at most, so that one with a large part of all rows is no single task."""
    return df.repartition(by, F.pmod(F.xxhash64(key), F.lit(files)))


def create(df: DataFrame, path: str, by: str = BY, key: str = "id", files: int = 8) -> None:
    _dealt(df, by, key, files).write.mode("error").partitionBy(by).parquet(path)


def read(spark: SparkSession, path: str, schema: DataFrame | None = None) -> DataFrame:
    """The table; a filter by tenant reads that folder alone. schema: a frame whose columns and types it has."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema.schema).parquet(path).select(*schema.columns)


def append(df: DataFrame, path: str, by: str = BY, key: str = "id", files: int = 1) -> None:
    """New rows as new files; no old file is touched."""
    _dealt(df, by, key, files).write.mode("append").partitionBy(by).parquet(path)


def change(spark: SparkSession, path: str, tenants: list, work: Callable[[DataFrame], DataFrame], by: str = BY, key: str = "id", files: int = 8) -> None:
    """Replaces the rows of some tenants by what work makes of them; work must not make rows of others."""
    held = spark.read.parquet(path).filter(F.col(by).isin(tenants))
    done = cut(work(held).select(*held.columns))  # told apart from the files that it replaces
    _dealt(done, by, key, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    alive = {r[0] for r in done.select(by).distinct().collect()}  # at most the tenants named
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for tenant, folder in _folders(spark, path, by, tenants).items():
        if tenant not in alive:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)  # nothing, where there is none


def _folders(spark: SparkSession, path: str, by: str, tenants: list) -> dict:
    """The folder of each tenant, as Spark names it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(conf).makeQualified(root).toString().rstrip("/")
    name = lambda v: jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, None if v is None else str(v))
    return {v: f"{root}/{name(v)}" for v in tenants}


def store(spark: SparkSession, path: str, rows: DataFrame, now: Column, **options) -> None:
    """``mutations.store`` into a table: the tenants of rows are looked at, and new files are all that is written."""
    tenants = [r[0] for r in rows.select(BY).distinct().collect()]  # those of one call
    held = spark.read.parquet(path).filter(F.col(BY).isin(tenants))
    whole = mutations.store(held, rows, now, **options)
    append(cut(whole.join(rows.select("id"), "id", "left_semi").select(*held.columns)), path)


def update(spark: SparkSession, path: str, changes: DataFrame, now: Column) -> None:
    """``mutations.update`` of a table by changes (org_id, id, ...): the folders of their tenants alone."""
    tenants = [r[0] for r in changes.select(BY).distinct().collect()]  # those of one call
    change(spark, path, tenants, lambda held: mutations.update(held, changes.drop(BY), now))


def forget(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Removes memories (org_id, id) for good, all their versions with them."""
    tenants = [r[0] for r in ids.select(BY).distinct().collect()]  # those of one call
    change(spark, path, tenants, lambda held: held.join(ids.select(BY, "id"), [BY, "id"], "left_anti"))
