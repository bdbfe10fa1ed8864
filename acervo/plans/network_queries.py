"""Queries over the keyword network. Keywords are split at semicolons and bars here, as SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import keyword_network as N
from acervo.plans.registry import query, sql_squeeze
from acervo.runtime import cut, table

_LABEL = sql_squeeze("lower(translate({}, '–—', '--'))")
SQL_CLEAN = rf"""
  k as (select distinct record_id, {_LABEL.format("u")} as key from (
    select record_id, trim(unnest(regexp_split_to_array(keywords, '[;|]'))) as u from master_records
    where keywords is not null and lower(trim(keywords)) not in ('', 'nan', 'none', 'null', 'na', 'n/a'))
    where lower(u) not in ('', 'nan', 'none', 'null', 'na', 'n/a')),
  r as (select {_LABEL.format("alias")} as key, any_value(action) as action, any_value({_LABEL.format("canonical")}) as canonical
    from keyword_thesaurus group by 1),
  c as (select distinct record_id, case when action = 'merge' then canonical else k.key end as keyword
    from k left join r on k.key = r.key where k.key <> '' and (action is null or action <> 'exclude')),
  w as (select keyword, count(*) as df, ln(((select count(distinct record_id) from c) + 1) / (count(*) + 1)) + 1 as idf from c group by keyword)
"""
LEAST = N.PROFILES["balanced"]
SQL_EDGES = f"""{SQL_CLEAN},
  t as (select record_id, sum(idf) as total, count(*) as n from c join w using (keyword) group by record_id),
  p as (select a.record_id as source, b.record_id as target, sum(idf) as inter, count(*) as shared_count
    from c a join c b on a.keyword = b.keyword and a.record_id < b.record_id join w on w.keyword = a.keyword group by 1, 2),
  e as (select source, target, inter / (x.total + y.total - inter) as weight, shared_count,
      shared_count / (x.n + y.n - shared_count) as jaccard
    from p join t x on x.record_id = source join t y on y.record_id = target
    where shared_count >= 2 and inter / (x.total + y.total - inter) + 1e-12 >= {{0}})
"""
_PAIRS = SQL_EDGES.format(0)
SQL_EDGES = SQL_EDGES.format(LEAST)


def clean(spark, d):
    r = table(spark, d, "master_records").where(
        "keywords is not null and lower(trim(keywords)) not in ('', 'nan', 'none', 'null', 'na', 'n/a')"
    )
    split = r.select("record_id", F.explode(F.split("keywords", "[;|]")).alias("keyword")).distinct()
    return N.clean_keywords(split.withColumn("keyword", F.trim("keyword")), table(spark, d, "keyword_thesaurus"))


def edges(spark, d):
    return N.network_edges(cut(clean(spark, d)), LEAST)


@query("clean_keywords", f"with {SQL_CLEAN} select record_id, keyword from c")
def clean_keywords(spark, d):
    return clean(spark, d)


@query("keyword_weights", f"with {SQL_CLEAN} select keyword, df, round(idf, 6) as idf from w")
def keyword_weights(spark, d):
    return N.keyword_weights(clean(spark, d)).withColumn("idf", F.round("idf", 6))


@query("keyword_network", f"with {SQL_EDGES} select source, target, round(weight, 6) as weight, shared_count, round(jaccard, 6) as jaccard from e")
def keyword_network(spark, d):
    return edges(spark, d).withColumn("weight", F.round("weight", 6)).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "network_profiles",
    f"""with {_PAIRS} select profile, count(*) as edges, count(distinct source) as sources from e,
    (values {", ".join(f"('{k}', {v}, false)" for k, v in N.PROFILES.items())}, ('control', {N.CONTROL}, true)) v(profile, least, plain)
    where (case when plain then jaccard else weight end) + 1e-12 >= least group by profile""",
)
def network_profiles(spark, d):
    """Edges at each named threshold of the weight, and at the control threshold of plain Jaccard similarity."""
    words = cut(clean(spark, d))
    return N.profile_counts(words, N.PROFILES).unionAll(N.profile_counts(words, {"control": N.CONTROL}, plain=True))


@query("network_degrees", f"with {SQL_EDGES} select record_id, count(*) as degree from (select source as record_id from e union all select target from e) group by record_id")
def network_degrees(spark, d):
    return N.network_degrees(cut(clean(spark, d)), LEAST)


@query("network_components")
def network_components(spark, d):
    """Records of the network with their component."""
    return N.network_components(cut(clean(spark, d)), LEAST).withColumnRenamed("component", "component_id")


@query(
    "network_topic_agreement",
    f"""with {SQL_EDGES}, a as (select record_id, max(publication_year) as topic from master_records where publication_year is not null group by 1)
    select count(*) as eligible_edges, coalesce(sum((x.topic = y.topic)::int), 0)::bigint as same_topic_edges,
      (select sum(v * (v - 1)) / (sum(v) * (sum(v) - 1)) from (select count(*) as v from a group by topic)) as baseline_share,
      coalesce(sum((x.topic = y.topic)::int), 0) / count(*) as same_topic_share
    from e join a x on x.record_id = source join a y on y.record_id = target""",
)
def network_topic_agreement(spark, d):
    """Whether linked records agree in their year, as a stand-in for a topic."""
    a = table(spark, d, "master_records").where("publication_year is not null")
    a = a.groupBy("record_id").agg(F.max("publication_year").alias("topic"))
    return N.network_agreement(cut(clean(spark, d)), a, LEAST)


@query(
    "co_keyword_edges",
    f"""with {SQL_CLEAN}, f as (select c.* from c join w using (keyword) where df between 2 and 400)
    select a.keyword as first_keyword, b.keyword as second_keyword, count(*) as records
    from f a join f b on a.record_id = b.record_id and a.keyword < b.keyword group by 1, 2""",
)
def co_keyword_edges(spark, d):
    c = cut(clean(spark, d))
    f = c.join(N.keyword_weights(c).where("df between 2 and 400").select("keyword"), "keyword", "left_semi")
    a = f.select("record_id", F.col("keyword").alias("first_keyword"))
    b = f.select("record_id", F.col("keyword").alias("second_keyword"))
    return (
        a.join(b, "record_id").where("first_keyword < second_keyword")
        .groupBy("first_keyword", "second_keyword").agg(F.count(F.lit(1)).alias("records"))
    )
