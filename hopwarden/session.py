"""Session settings and the few helpers every module shares."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the results rely on (time zone) or that suit any size of input.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = 8, **settings: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"} | settings
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Spark's Python workers, once per context.

    Nothing is done where the workers' PYTHONPATH has it already. Else the driver's file server hands out a zip of it.
    """
    root = Path(__file__).resolve().parent.parent
    given = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in given or getattr(context, "_hopwarden_shipped", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="hopwarden-"), "hopwarden_package"), "zip", root, "hopwarden")
    context.addPyFile(made)
    context._hopwarden_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a temporary folder is used on a local master (one process); any other is an error,
    as its executors may not share a folder of this machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(context.master, spark.conf.get("spark.checkpoint.dir", None)))
    return df.checkpoint(eager=True)


def checkpoint_folder(master: str, named: str | None) -> str:
    if named:
        return named
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="hopwarden-")


def once(c: Column) -> Column:
    """The column, computed once a row: a generator of one row each, of which a projection can hold one.

    Filters and later projections are merged into the one below and repeat its expressions at each mention; long array
    expressions then run dozens of times. Nothing is merged into a generator.
    """
    return F.explode(F.array(c))


def null_safe(*columns: Column) -> list[Column]:
    """Columns to hash: Spark's hashes skip nulls, so each value is preceded by its null flag."""
    return [part for c in columns for part in (c.isNull(), c)]


def wide_hash(*columns: Column) -> list[Column]:
    """128 bits of row identity as two bigints, null being a value of its own."""
    parts = null_safe(*columns)
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x9E3779B9), *parts)]
