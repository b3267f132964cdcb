"""Parsers of registry data: routing-policy objects (as-sets, aut-nums) and peering-database dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.session import cut_lineage

#: Fixed value: most rounds of the closure over nested as-sets.
CLOSURE_ROUNDS = 10
#: Fixed value: kinds of networks that run an exchange.
EXCHANGE_KINDS = ("route server", "non-profit")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per object; objects stand apart by blank lines, compressed files are read as they are."""
    return spark.read.text(path, lineSep="\n\n")


def _fields(text: Column) -> Column:
    """array<string>: the object's lines, continuations (white space or '+') joined to the field they continue."""
    return F.split(F.regexp_replace(text, r"\n[ \t+]+", " "), "\n")


def _named(text: Column, *names: str) -> Column:
    """array<string>: the values of the fields of these names."""
    pattern = r"(?i)^(?:" + "|".join(names) + r"):\s*"
    return F.transform(F.filter(_fields(text), lambda f: f.rlike(pattern)), lambda f: F.regexp_replace(f, pattern, ""))


def as_sets(objects: DataFrame) -> DataFrame:
    """(name, members array<bigint>, nested array<string>) of every as-set object."""
    name = F.upper(F.regexp_extract("value", r"(?im)^as-set:\s*(\S+)", 1))
    listed = F.filter(F.split(F.upper(F.array_join(_named(F.col("value"), "members"), ",")), r"[\s,]+"), lambda m: m != "")
    numbers = F.transform(F.filter(listed, lambda m: m.rlike(r"^AS[0-9]+$")), lambda m: F.substring(m, 3, 20).try_cast("bigint"))
    nested = F.filter(listed, lambda m: m.rlike(r"^AS[A-Z0-9:_.-]+$") & ~m.rlike(r"^AS[0-9]+$"))
    return objects.select(name.alias("name"), numbers.alias("members"), nested.alias("nested")).filter("name <> ''")


def closure(sets: DataFrame) -> DataFrame:
    """(name, asn): members of each as-set and of all sets nested in it, over at most CLOSURE_ROUNDS levels; cycles end."""
    edges = sets.select("name", F.explode("nested").alias("inner")).distinct()
    reached = cut_lineage(sets.select("name", F.col("name").alias("inner")).distinct())
    frontier = reached
    for _ in range(CLOSURE_ROUNDS):
        step = frontier.join(edges.withColumnRenamed("name", "__n").withColumnRenamed("inner", "__i"), F.col("inner") == F.col("__n"))
        frontier = cut_lineage(step.select("name", F.col("__i").alias("inner")).distinct().join(reached, ["name", "inner"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    members = sets.select(F.col("name").alias("inner"), F.explode("members").alias("asn"))
    return reached.join(members, "inner").select("name", "asn").distinct()


def policy_links(objects: DataFrame) -> DataFrame:
    """(src, dst): aut-num -> AS named in its import/export lines, sets after 'to' expanded, AS-ANY skipped, distinct."""
    src = F.regexp_extract("value", r"(?im)^aut-num:\s*AS([0-9]+)", 1).try_cast("bigint")
    lines = objects.select(src.alias("src"), F.explode(_named(F.col("value"), "import", "mp-import", "export", "mp-export")).alias("line")).filter("src is not null")
    padded = F.concat(F.lit(" "), F.upper(F.regexp_replace("line", r"\s+", "  ")), F.lit(" "))
    direct = F.transform(F.regexp_extract_all(padded, F.lit(r"\s(?:FROM|TO)\s+AS([0-9]+)\s"), F.lit(1)), lambda x: x.try_cast("bigint"))
    named = F.regexp_extract_all(padded, F.lit(r"\sTO\s+(AS[A-Z0-9:_.-]*[A-Z:_.-][A-Z0-9:_.-]*)\s"), F.lit(1))
    expanded = lines.select("src", F.explode(named).alias("name")).filter("name <> 'AS-ANY'").join(closure(as_sets(objects)), "name").select("src", F.col("asn").alias("dst"))
    return lines.select("src", F.explode(direct).alias("dst")).unionByName(expanded).filter("dst is not null").distinct()


_DUMP = (
    "netfac struct<data: array<struct<local_asn: bigint, fac_id: bigint, name: string, country: string, city: string>>>, "
    "netixlan struct<data: array<struct<asn: bigint, ix_id: bigint, name: string>>>, "
    "net struct<data: array<struct<asn: bigint, org_id: bigint, info_type: string>>>, "
    "org struct<data: array<struct<id: bigint, country: string>>>"
)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A peering-database dump (one JSON document) with the parts used here."""
    return spark.read.schema(_DUMP).json(path, multiLine=True)


def facilities(dump: DataFrame) -> DataFrame:
    return dump.select(F.inline("netfac.data")).select(F.col("local_asn").alias("asn"), "fac_id", "name", "country", "city").distinct()


def exchanges(dump: DataFrame) -> DataFrame:
    return dump.select(F.inline("netixlan.data")).distinct()


def exchange_asns(dump: DataFrame, listed: DataFrame) -> DataFrame:
    """(asn): networks run by an exchange that the exchange list (asn) also has."""
    nets = dump.select(F.inline("net.data")).filter(F.lower("info_type").isin(*EXCHANGE_KINDS))
    return nets.select("asn").distinct().join(listed, "asn", "left_semi")


def countries(dump: DataFrame, as_org: DataFrame, org_country: DataFrame) -> DataFrame:
    """(asn, country, source): country by organisation list, overridden by the dump's where that is not empty."""
    by_list = as_org.join(org_country, "org").select("asn", F.col("country").alias("c1"))
    orgs = dump.select(F.inline("org.data")).select(F.col("id").alias("org_id"), F.nullif(F.trim("country"), F.lit("")).alias("c2"))
    by_dump = dump.select(F.inline("net.data")).join(orgs, "org_id").select("asn", "c2").filter("c2 is not null")
    both = by_list.join(by_dump, "asn", "full_outer")
    return both.select("asn", F.coalesce("c2", "c1").alias("country"), F.when(F.col("c2").isNotNull(), "dump").otherwise("list").alias("source")).filter("country is not null")
