"""Readers, literals and sinks of the daily jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hopwarden.functions.packed import path_positions

#: Fixed value: rows of a page of the cone service.
CONE_PAGE = 10_000


def read_links(spark: SparkSession, path: str, observers: bool = False) -> DataFrame:
    """Space-separated links 'as1 as2 [vp_ip]'; comment lines and lines without two numbers are skipped."""
    schema = "as1 bigint, as2 bigint" + (", vp_ip string" if observers else "")
    rows = spark.read.csv(path, sep=" ", comment="#", schema=schema, mode="PERMISSIVE")
    return rows.filter("as1 is not null and as2 is not null")


def read_asns(spark: SparkSession, path: str) -> DataFrame:
    """One AS number a line."""
    return spark.read.csv(path, comment="#", schema="asn bigint").filter("asn is not null")


def parse_link_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """'as1 as2,path[,info,recurrent]' lines -> (as1, as2, as_path, info, is_recurrent), as1 < as2.

    Lines with '#' and malformed lines give no rows.
    """
    parts = F.split(F.col(column), ",")
    ends = F.transform(F.split(F.trim(F.get(parts, F.lit(0))), r"\s+"), lambda x: x.try_cast("bigint"))
    rows = lines.filter(~F.col(column).contains("#")).select(
        ends.alias("e"), F.get(parts, F.lit(1)).alias("as_path"), F.get(parts, F.lit(2)).alias("info"), F.get(parts, F.lit(3)).alias("r")
    )
    good = rows.filter(F.size("e") == 2).filter("e[0] is not null and e[1] is not null and as_path is not null")
    return good.select(F.array_min("e").alias("as1"), F.array_max("e").alias("as2"), "as_path", "info", (F.lower(F.trim("r")) == "true").alias("is_recurrent"))


def literal_links(spark: SparkSession, text: str) -> DataFrame:
    """'a-b,c-d' -> (as1, as2)."""
    rows = [tuple(sorted(int(x) for x in link.split("-"))) for link in text.split(",") if link.strip()]
    return spark.createDataFrame(rows, "as1 bigint, as2 bigint")


def literal_paths(spark: SparkSession, text: str) -> DataFrame:
    """'a b,path-c d,path' -> (as1, as2, as_path)."""
    return parse_link_lines(spark.createDataFrame([(x,) for x in text.split("-")], "value string")).select("as1", "as2", "as_path")


def literal_features(spark: SparkSession, text: str) -> DataFrame:
    """'feat=val|feat=val,feat=val|...' -> one row per comma-separated group with a map of its features."""
    rows = spark.createDataFrame([(x,) for x in text.split(",")], "value string")
    return rows.select(F.transform_values(F.expr("str_to_map(value, '[|]', '=')"), lambda _, v: v.cast("double")).alias("features"))


def latest_partition(spark: SparkSession, root: str, column: str, day: str) -> DataFrame:
    """Rows of the newest partition not after the day; empty if there is none."""
    rows = spark.read.parquet(root)
    newest = rows.filter(F.col(column) <= F.lit(day).cast("date")).agg(F.max(column)).first()[0]
    return rows.filter(F.col(column) == F.lit(newest))


def write_day(df: DataFrame, root: str, column: str = "date") -> None:
    """Replace exactly the days that df has; writing twice leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(root)


def has_day(spark: SparkSession, root: str, column: str, day: str) -> bool:
    """Whether a partition exists already (a stage is skipped then unless told to override)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{column}={day}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write_text(df: DataFrame, path: str, how: str = "csv") -> None:
    """Result files: space-separated text with a header, or JSON lines. Paths inside a field must hold no blanks."""
    writer = df.write.mode("overwrite")
    writer.json(path) if how == "json" else writer.csv(path, sep=" ", header=True)


def pipe_path(as_path: Column) -> Column:
    """A path that survives space-separated files: hops joined by '|'."""
    return F.array_join(F.transform(path_positions(as_path), lambda v: F.array_join(v["members"].cast("array<string>"), ",")), "|")


class _Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class PagedCones(DataSource):
    """Customer-cone sizes from a paginated service, a task a page.

    Options: total (number of records), page (rows of a page), and `fetch`, the dotted name of a function
    (offset, page) -> list of (asn, cone); so the transport is the caller's and tests need no network.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_cones"

    def schema(self) -> str:
        return "asn bigint, cone bigint"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.total, self.page, self.fetch = int(options["total"]), int(options.get("page", CONE_PAGE)), options["fetch"]

    def partitions(self):  # noqa: ANN201
        return [_Page(o) for o in range(0, self.total, self.page)]

    def read(self, partition):  # noqa: ANN001, ANN201
        import importlib

        module, _, function = self.fetch.rpartition(".")
        call: Callable = getattr(importlib.import_module(module), function)
        yield from (tuple(r) for r in call(partition.offset, self.page))
