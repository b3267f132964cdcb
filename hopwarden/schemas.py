"""Schemas of the tables the jobs exchange, and their creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names and types of the result tables and of what the collectors land. Day columns partition the tables.
TABLES = {
    "updates_links": ("obs_date", "obs_date date, as1 bigint, as2 bigint, vp_ip string"),
    "rib_links": ("month", "month date, as1 bigint, as2 bigint"),
    "irr_links": ("obs_date", "obs_date date, src bigint, dst bigint"),
    "cone": ("cone_month", "cone_month date, asn bigint, cone bigint"),
    "roa": ("roa_date", "roa_date date, asn bigint, prefix string, max_length int"),
    "sample": ("day", "day date, label int, as1 bigint, as2 bigint, as_path string"),
    "new_link": (
        "day",
        "day date, id bigint, asn1 bigint, asn2 bigint, as_path string, observed_at timestamp, prefix string, peer_ip string, peer_asn bigint, "
        "is_recurrent boolean, inference_id bigint",
    ),
    "inference_summary": (
        "day",
        "day date, id bigint, asn1 bigint, asn2 bigint, classification string, confidence_level int, num_legit_inf int, num_susp_inf int, num_paths bigint, "
        "attackers array<bigint>, victims array<bigint>, hijack_types array<int>, is_origin_rpki_valid boolean, is_recurrent boolean, observed_at timestamp, is_local boolean",
    ),
    "inference_details": ("day", "day date, inference_id bigint, model_id int, num_legit_paths bigint, num_susp_paths bigint"),
}


def create_tables(spark: SparkSession, root: str, names: tuple[str, ...] = tuple(TABLES)) -> None:
    """Create the tables that are not there as partitioned parquet below `root`; those that are there stay."""
    for name in names:
        day, columns = TABLES[name]
        spark.sql(f"create table if not exists `{name}` ({columns}) using parquet partitioned by ({day}) location '{root}/{name}'")


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The frame with exactly the columns and types of the table; a missing or a further column is an error."""
    wanted = [c.strip().split(" ", 1) for c in _split(TABLES[name][1])]
    names = {c for c, _ in wanted}
    if names != set(df.columns):
        raise ValueError(f"{name}: missing {sorted(names - set(df.columns))}, not known {sorted(set(df.columns) - names)}")
    return df.select(*[df[c].cast(kind).alias(c) for c, kind in wanted])


def _split(columns: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]
