"""Queries of sampling, forests, the live path in batch, and registry parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.functions import paths
from hopwarden.operators import features, graph, learning, sampling, topology
from hopwarden.operators.distances import attribute_distances
from hopwarden.plans.feature_queries import attributes
from hopwarden.plans.graph_queries import SQL_DAYS, SQL_GRAPH, fresh_links, last_day, ribs, whole_graph
from hopwarden.plans.path_queries import SQL_TOKENS, _collapse_sql, links_with_hops
from hopwarden.plans.registry import Registry
from hopwarden.session import cut_lineage, once, table
from hopwarden.streaming import live

R = Registry()

SAMPLE = 1000

SQL_LABELS = "lab as (select asn, cast(case when degree<10 then 0 when degree<50 then 1 when degree<100 then 2 when degree<500 then 3 else 4 end as int) as label from deg)"
SQL_PATHS = f"p as (select id, array_to_string(path, ' ') as path, path as a from (select id, {_collapse_sql('hops')} as path from tt) where len(path) >= 3)"
SQL_U = "(cast(('0x' || substr(md5({}), 1, 8)) as ubigint)::double + 1) / 4294967296.0::double"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels_of(whole_graph(spark, d))


def _labels_of(known: DataFrame) -> DataFrame:
    deg = topology.degrees(known)
    return deg.select("asn", F.least(paths.degree_bucket(F.col("degree")), F.lit(4)).alias("label"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    rows = links_with_hops(spark, d).select("id", once(paths.collapse(F.col("hops"))).alias("a")).filter(F.size("a") >= 3)
    return rows.select("id", "a", paths.joined(F.col("a")).alias("path"))


def newest(spark: SparkSession, d: str, t: str, day: str = "snapshot_day") -> DataFrame:
    """The rows of a table's newest snapshot."""
    rows = table(spark, d, t)
    return rows.join(F.broadcast(rows.agg(F.max(day).alias(day))), day)


def newest_cones(spark: SparkSession, d: str) -> DataFrame:
    return newest(spark, d, "as_cone", "cone_month").select("asn", "cone")


def _carried(spark: SparkSession, d: str, longer_than: int = 0) -> DataFrame:
    linked = _paths(spark, d).filter(F.size("a") > longer_than).select("path", once(paths.pairs(F.col("a"))).alias("z")).select("path", F.inline("z")).filter("a <> b")
    return linked.select(F.least("a", "b").alias("as1"), F.greatest("a", "b").alias("as2"), "path").distinct()


@R.query(
    f"""with {SQL_GRAPH}, {SQL_LABELS}, n as (select g.as1, g.as2, least(x.label, y.label) as c1, greatest(x.label, y.label) as c2 from g join lab x on g.as1 = x.asn join lab y on g.as2 = y.asn)
    select as1, as2, c1, c2 from n qualify row_number() over (partition by c1, c2 order by {SQL_U.format("'0 ' || as1 || ' ' || as2")}, as1, as2) <= 100"""
)
def ref_k08_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 100 links of each category pair."""
    return sampling.balanced_sample(sampling.categories(whole_graph(spark, d), _labels(spark, d)))


@R.query(
    f"""with tt as ({SQL_TOKENS}), {SQL_PATHS} select a[len(a)] as origin, count(*) as n, count(distinct path) as n_paths from p group by all"""
)
def ref_k09_path_index(spark: SparkSession, d: str) -> DataFrame:
    """Paths of three hops or more by their origin."""
    rows = _paths(spark, d).select(paths.victim(F.col("a")).alias("origin"), "path")
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths"))


SQL_SAMPLING = f"""
    {SQL_GRAPH}, {SQL_LABELS}, tt as ({SQL_TOKENS}), {SQL_PATHS},
    carried as (select distinct least(z[1], z[2]) as as1, greatest(z[1], z[2]) as as2, path from (select path, unnest(list_zip(a[1:len(a)-1], a[2:])) as z from p) where z[1] <> z[2]),
    cat as (select g.as1, g.as2, least(x.label, y.label) as c1, greatest(x.label, y.label) as c2 from g join lab x on g.as1 = x.asn join lab y on g.as2 = y.asn)"""


NEGATIVE_SQL = f"""with recursive {SQL_SAMPLING}, named as (select * from cat semi join carried using (as1, as2)),
    raw as (select c1, c2, count(*) as n, count(*) / (sum(count(*)) over ())::double as r from named group by all), w as (select c1, c2, r / (sum(r) over ()) / n as w from raw),
    leaf as (select as1, as2 from g where as1 in (select asn from deg where degree = 1) or as2 in (select asn from deg where degree = 1)),
    tri as (select distinct g.as1, g.as2 from g join near a on g.as1 = a.asn join near b on g.as2 = b.asn and a.other = b.other),
    cand as (select as1, as2 from named anti join leaf using (as1, as2) anti join tri using (as1, as2)),
    bfs as (select as1, as2, as1 as node from cand union select b.as1, b.as2, n.other from bfs b join near n on b.node = n.asn
      where not (n.asn in (b.as1, b.as2) and n.other in (b.as1, b.as2))),
    ok as (select as1, as2 from tri union select as1, as2 from bfs where node = as2),
    drawn as (select as1, as2 from named semi join ok using (as1, as2) join w using (c1, c2) order by -ln({SQL_U.format("'0 ' || as1 || ' ' || as2")}) / w, as1, as2 limit {SAMPLE})
    select as1, as2, arg_min(path, md5('0 ' || path)) as path from drawn join carried using (as1, as2) group by all"""


@R.query(NEGATIVE_SQL)
def ref_k03_negative_sample(spark: SparkSession, d: str) -> DataFrame:
    """Existing links by category, no bridges, each with a path."""
    return sampling.negative_sample(whole_graph(spark, d), _labels(spark, d), _carried(spark, d), SAMPLE)


POSITIVE_SQL = f"""with {SQL_DAYS}, {SQL_SAMPLING}, raw as (select c1, c2, pow(count(*) / (sum(count(*)) over ())::double, 0.75) as r from cat group by all), pr as (select c1, c2, r / (sum(r) over ()) as p from raw),
    num as (select asn, label, row_number() over (partition by label order by md5('0 ' || asn)) - 1 as i from lab), sz as (select label, count(*) as m from lab group by label),
    dr as (select c1, c2, unnest(range(1, greatest(1, ceil(p * 4 * {SAMPLE}))::bigint + 1)) as draw from pr),
    ix as (select least(floor({SQL_U.format("'01 ' || c1 || ' ' || c1 || ' ' || c2 || ' ' || draw")} * x.m), x.m - 1)::bigint as i1, least(floor({SQL_U.format("'02 ' || c2 || ' ' || c1 || ' ' || c2 || ' ' || draw")} * y.m), y.m - 1)::bigint as i2, c1, c2
           from dr join sz x on x.label = c1 join sz y on y.label = c2),
    fp as (select distinct least(x.asn, y.asn) as as1, greatest(x.asn, y.asn) as as2 from ix join num x on x.label = c1 and x.i = i1 join num y on y.label = c2 and y.i = i2 where x.asn <> y.asn),
    st as (select a[len(a)] as origin, arg_min(path, md5('0 ' || path)) as path from p group by all),
    bo as (select fp.as1, fp.as2, x.path as px, y.path as py, x.path is not null and (y.path is null or fp.as1::varchar < fp.as2::varchar) as f
           from fp anti join g on fp.as1 = g.as1 and fp.as2 = g.as2 left join st x on x.origin = fp.as1 left join st y on y.origin = fp.as2 where x.path is not null or y.path is not null)
    select as1, as2, if(f, as1, as2) as attacker, if(f, as2, as1) as victim, if(f, px, py) || ' ' || if(f, as2, as1) as path from bo
    order by {SQL_U.format("'0 ' || as1 || ' ' || as2")}, as1, as2 limit {SAMPLE}"""


@R.query(POSITIVE_SQL)
def ref_k04_positive_sample(spark: SparkSession, d: str) -> DataFrame:
    """Forged links by category pair."""
    origins = _paths(spark, d).select(paths.victim(F.col("a")).alias("origin"), "path")
    return _forged(spark, d, whole_graph(spark, d), _labels(spark, d), origins)


def _forged(spark: SparkSession, d: str, known: DataFrame, labels: DataFrame, origins: DataFrame) -> DataFrame:
    counts = sampling.categories(known, labels).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    probabilities = cut_lineage(features.category_probability(counts, 0.75).select("c1", "c2", "p"))
    registry = topology.undirected(ribs(spark, d))
    return sampling.forged_links(labels, probabilities, known, registry, origins, SAMPLE)


@R.query()
def ref_k01_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of ASes by degree and cone."""
    return sampling.cluster_ases(topology.degree_and_cone(whole_graph(spark, d), ribs(spark, d).select("as1", "as2"), newest_cones(spark, d)))


KEYS = ("as1", "as2", "label")


def families(spark: SparkSession, d: str, links: DataFrame, graph_: DataFrame | None = None) -> dict[str, DataFrame]:
    """The feature families of links without paths: topological, bidirectional with neighbouring observers, distances."""
    graph_ = cut_lineage(whole_graph(spark, d)) if graph_ is None else graph_
    recent = table(spark, d, "updates_links").filter(F.col("obs_date") > F.date_sub(F.lit(last_day(spark, d)), features.BIDI_DAYS))
    observers = table(spark, d, "new_link").select(F.col("peer_asn").alias("asn")).distinct()
    both = features.bidirectional(links, recent, ribs(spark, d)).join(features.neighbouring_observers(links, graph_, observers), ["as1", "as2"])
    return {
        "topological": graph.topological_features(links, graph_),
        "bidirectionality": both,
        "peeringdb": attribute_distances(links, graph_, attributes(spark, d)),
    }


def _met(spark: SparkSession, d: str, known: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(as1, as2) and (origin): the known links that some path runs over and the labelled ASes where some path ends.

    The paths are read once: the last hop of each is one more pair, of the AS with itself, beside those of its links.
    """
    last = paths.victim(F.col("a"))
    steps = F.concat(F.filter(paths.pairs(F.col("a")), lambda z: z["a"] != z["b"]), F.array(F.struct(last.alias("a"), last.alias("b"))))
    met = _paths(spark, d).select(F.inline(steps)).select(F.least("a", "b").alias("as1"), F.greatest("a", "b").alias("as2"), F.lit(1).alias("side"))
    asked = known.select("as1", "as2").unionByName(labels.select(F.col("asn").alias("as1"), F.col("asn").alias("as2"))).withColumn("side", F.lit(2))
    both = cut_lineage(met.unionByName(asked).groupBy("as1", "as2").agg(F.bit_or("side").alias("side")).filter("side = 3").select("as1", "as2"))
    return both.filter("as1 < as2"), both.filter("as1 = as2").select(F.col("as1").alias("origin"))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Existing links (label 0) and forged ones (label 1) with all families; nothing in them comes from a verdict."""
    known = cut_lineage(whole_graph(spark, d))
    labels = cut_lineage(_labels_of(known))
    carried, origins = _met(spark, d, known, labels)
    # the links drawn are those of ref_k03 and ref_k04; which paths they have does not matter here
    forged = _forged(spark, d, known, labels, origins.withColumn("path", F.lit(""))).select("as1", "as2")
    real = cut_lineage(sampling.negative_links(known, labels, carried, SAMPLE))
    made = {n: cut_lineage(f) for n, f in families(spark, d, forged.unionByName(real), known).items()}
    of = lambda links: {n: f.join(links, ["as1", "as2"], "left_semi") for n, f in made.items()}
    return cut_lineage(features.training_frame(of(forged), of(real)))


def _names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in KEYS]


@R.query()
def ref_m05_inference(spark: SparkSession, d: str) -> DataFrame:
    """Forests of all cost weights, trained on forged and existing links, applied to the links first seen on the last day."""
    rows = training_rows(spark, d)
    names = _names(rows)
    models = learning.train_all(rows, names)
    links = cut_lineage(fresh_links(spark, d))
    asked = features.join_families([f.fillna(1.0) for f in families(spark, d, links).values()], ["as1", "as2"])
    return learning.infer(cut_lineage(asked), models, names).select("as1", "as2", "label", "proba", "sensitivity")


@R.query()
def ref_m06_importance(spark: SparkSession, d: str) -> DataFrame:
    """How much each feature decides in a forest of the training rows."""
    rows = training_rows(spark, d)
    names = _names(rows)
    found = learning.importance(learning.train(rows, names), names)
    return spark.createDataFrame(sorted(found.items()), "feature string, importance double")


@R.query()
def ref_m07_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """TPR and FPR of a forest on held-out forged and existing links."""
    rows = training_rows(spark, d)
    return learning.evaluate(rows, _names(rows))


@R.query(
    f"""with s as (select cast(observed_at as date) as day, least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, cast(classification = 'sus' as int) as label from inference_summary),
    q as (select max(day) as d from s), ok as (select day from s group by day having count(distinct label) = 2)
    select s.day, as1, as2, label from s semi join ok using (day), q where s.day between d - 60 and d"""
)
def ref_m02_training_window(spark: SparkSession, d: str) -> DataFrame:
    """Labelled links of the last 60 days, days without either label left out."""
    rows = table(spark, d, "inference_summary").select(
        F.to_date("observed_at").alias("day"), *topology.link_columns("asn1", "asn2"), (F.col("classification") == "sus").cast("int").alias("label")
    )
    return features.training_window(rows, rows.agg(F.max("day")).first()[0], 60)


@R.query()
def ref_c04_path_scores(spark: SparkSession, d: str) -> DataFrame:
    """Path forests trained on the forged and existing samples, applied to the paths of all sightings."""
    metrics = {"degree": topology.degrees(whole_graph(spark, d)), "cone": newest_cones(spark, d)}
    sets = {m: [f"{m}_{i}" for i in range(1, 7)] for m in metrics}
    sets["cone&degree"] = sets["cone"] + sets["degree"]
    forged, real = (f(spark, d).select("as1", "as2", "path", F.lit(label).alias("label")) for f, label in ((ref_k04_positive_sample, 1), (ref_k03_negative_sample, 0)))
    keyed = forged.unionByName(real).withColumn("id", F.concat_ws(" ", "label", "as1", "as2"))  # a link once per label
    samples = cut_lineage(keyed.select("id", "label", F.split("path", " ").cast("array<bigint>").alias("hops")))
    known = cut_lineage(features.pattern_features(samples, "id", "hops", metrics).join(samples.select("id", "label"), "id"))
    rows = features.pattern_features(links_with_hops(spark, d), "id", "hops", metrics)
    return learning.path_scores(known, rows, sets).select("id", *sets)


@R.query(
    f"""with recursive t as ({SQL_TOKENS}),
    rows as (select least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, asn1 < asn2 as fwd, cast(floor(epoch(observed_at)) as bigint) as ts, array_to_string(hops, ' ') as path, peer_ip as vp
             from t where asn1 <> asn2 and observed_at is not null),
    s as (select as1, as2, min(ts) as first_seen from rows group by all
          union all select s.as1, s.as2, (select min(r.ts) from rows r where r.as1 = s.as1 and r.as2 = s.as2 and r.ts >= s.first_seen + 300) as nxt
          from s where exists (select 1 from rows r where r.as1 = s.as1 and r.as2 = s.as2 and r.ts >= s.first_seen + 300))
    select r.as1, r.as2, s.first_seen, count(*) as n_rows, count(distinct path) as n_paths, count(distinct vp) as n_observers, min(fwd) <> max(fwd) as confirmed
    from rows r join s on r.as1 = s.as1 and r.as2 = s.as2 and r.ts >= s.first_seen and r.ts < s.first_seen + 300 group by all"""
)
def ref_w06_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Buffered links of the sightings: five minutes from the first one, confirmed by the other direction."""
    rows = links_with_hops(spark, d)
    seconds = F.floor(F.unix_micros(F.col("observed_at").cast("timestamp")) / 1_000_000).cast("bigint")
    return live.sessions(rows.select(F.col("asn1").alias("src"), F.col("asn2").alias("dst"), seconds.alias("ts"), paths.joined(F.col("hops")).alias("path"), F.col("peer_ip").alias("vp")))


@R.query(
    """select vp_ip as peer, 64500::bigint as peer_asn, 'U' as kind, '10.' || (as1 % 256) || '.0.0/16' as prefix, as1 || ' ' || as2 as as_path
       from updates_links where vp_ip is not null and as1 is not null and as2 is not null
       union all select vp_ip, 64500, 'W', '10.' || (as2 % 256) || '.0.0/16', null from updates_links where vp_ip is not null and as1 is not null and as2 is not null"""
)
def ref_w02_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Update messages, packed from the daily links as JSON, flattened to rows."""
    net = lambda c: F.concat(F.lit("10."), (F.col(c) % 256).cast("string"), F.lit(".0.0/16"))
    message = F.to_json(
        F.struct(
            F.lit("ris_message").alias("type"),
            F.struct(
                F.lit(1.5).alias("timestamp"),
                F.col("vp_ip").alias("peer"),
                F.lit("64500").alias("peer_asn"),
                F.array("as1", "as2").alias("path"),
                F.array(F.struct(F.lit("h").alias("next_hop"), F.array(net("as1")).alias("prefixes"))).alias("announcements"),
                F.array(net("as2")).alias("withdrawals"),
            ).alias("data"),
        )
    )
    packed = table(spark, d, "updates_links").filter("vp_ip is not null and as1 is not null and as2 is not null").select(message.alias("value"))
    return live.flatten_messages(packed).drop("ts")
