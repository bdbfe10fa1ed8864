"""Similarity network of records by their keywords, weighted by rarity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import label_key
from acervo.operators.components import connected_components
from acervo.runtime import broadcast_if_small, cut, known

#: Named thresholds of the weighted similarity.
PROFILES = {"exploratory": 0.10, "balanced": 0.20, "strict": 0.30}
#: The plain Jaccard similarity that the weighted one is compared with.
CONTROL = 0.20
EPS = 1e-12
#: Members of a class that one list holds, and nodes of the trees that one task remembers.
LISTED, TREES_KEPT = 500, 500_000


def clean_keywords(keywords: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``record_id, keyword`` after the thesaurus: exclusions dropped, variants merged.

    ``keywords`` has ``record_id, keyword``; ``rules`` has ``alias, action, canonical``.
    """
    r = rules.select(label_key("alias").alias("key"), "action", label_key("canonical").alias("canonical")).dropDuplicates(["key"])
    k = keywords.select("record_id", label_key(known("keyword")).alias("key")).where("key <> ''").distinct()
    return (
        k.join(broadcast_if_small(r), "key", "left")
        .where("action is null or action <> 'exclude'")
        .select("record_id", F.when(F.col("action") == "merge", F.col("canonical")).otherwise(F.col("key")).alias("keyword"))
        .distinct()
    )


def keyword_weights(clean: DataFrame) -> DataFrame:
    """``keyword, df, idf`` with idf = ln((N + 1) / (df + 1)) + 1."""
    n = clean.select("record_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = clean.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("keyword", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def keyword_classes(clean: DataFrame, min_shared: int = 2) -> tuple[DataFrame, DataFrame]:
    """Records of equal keyword sets as one class, and the members of the classes.

    The first table has ``class, ids, idfs, total, n, m``: the keywords by number in order of
    their idf, the sum and the number of them, and the number of members. The second has
    ``class, record_id``. Sets of fewer than ``min_shared`` keywords share too few with any.
    """
    weights = cut(keyword_weights(clean).select("keyword", "idf", F.monotonically_increasing_id().alias("id")))
    sets = (
        clean.join(weights, "keyword")
        .groupBy("record_id")
        .agg(F.sort_array(F.collect_list(F.struct("idf", "id"))).alias("kws"))
        .where(F.size("kws") >= min_shared)
    )
    sets = cut(sets)
    classes = sets.groupBy("kws").agg(F.count(F.lit(1)).alias("m"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    members = cut(sets.join(classes, "kws").select("class", "record_id"))
    told = classes.select(
        "class", F.col("kws.id").alias("ids"), F.col("kws.idf").alias("idfs"),
        F.aggregate("kws", F.lit(0.0), lambda s, k: s + k["idf"]).alias("total"), F.size("kws").alias("n"), "m",
    )
    return told, members


def class_edges(classes: DataFrame, least: float = 0.20, min_shared: int = 2, plain: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, weight, shared_count, jaccard`` of every pair of classes that is linked, once, and the ``carry`` columns of both.

    Classes meet in the two rarest keywords that they share (the one, where one is enough), the
    rarest of which is in the prefix of either: before it, what is left cannot reach the
    threshold. Their sets come along, so a pair is scored where it meets and never shuffled.
    A column ``x`` of ``carry`` gives ``x_a`` and ``x_b``.
    """
    deep = min_shared > 1
    whole = F.col("n" if plain else "total")
    reach = F.expr("aggregate(slice(idfs, 1, i + 1), 0D, (s, x) -> s + " + ("1D)" if plain else "x)"))
    first = classes.select("*", F.posexplode("ids").alias("i", "k")).where(reach + 1e-9 * whole >= F.lit(least) * whole)
    rows = first.withColumn("j", F.explode(F.slice("ids", F.lit(1), F.col("i")))) if deep else first.withColumn("j", F.lit(None).cast("bigint"))
    own = ["class", "ids", "idfs", "total", "n", *carry]
    on = ["k", "j"] if deep else ["k"]
    side = lambda x: rows.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in own))
    inter = F.expr("aggregate(zip_with(ids_a, idfs_a, (k, v) -> if(array_contains(shared, k), v, 0D)), 0D, (s, x) -> s + x)")
    rarest = F.element_at("shared", -1) == F.col("k")
    return (
        side("a").join(side("b"), on)
        .where("class_a < class_b")
        .withColumn("shared", F.array_intersect("ids_a", "ids_b"))
        .withColumn("shared_count", F.size("shared"))
        .where(F.col("shared_count") >= min_shared)
        .where(rarest & (F.element_at("shared", -2) == F.col("j")) if deep else rarest)
        .withColumn("inter", inter)
        .withColumn("weight", F.col("inter") / (F.col("total_a") + F.col("total_b") - F.col("inter")))
        .withColumn("jaccard", F.col("shared_count") / (F.col("n_a") + F.col("n_b") - F.col("shared_count")))
        .where(F.col("jaccard" if plain else "weight") + EPS >= least)
        .select(
            F.col("class_a").alias("a"), F.col("class_b").alias("b"), "weight", F.col("shared_count").cast("bigint").alias("shared_count"),
            "jaccard", *(f"{c}_{x}" for c in carry for x in "ab"),
        )
    )


def network_edges(clean: DataFrame, least: float = 0.20, min_shared: int = 2, plain: bool = False) -> DataFrame:
    """Edges between records that share ``min_shared`` keywords and reach ``least``, in weight or in ``plain`` Jaccard similarity.

    The weight is the idf of the shared keywords over the idf of all keywords of either.
    Records with equal keyword sets are compared once, as one class; the members of a class
    come along in lists of ``LISTED`` at most, so no edge is shuffled.
    """
    classes, members = keyword_classes(clean, min_shared)
    list_of = F.pmod(F.xxhash64("record_id"), F.ceil(F.col("m") / LISTED))
    lists = members.join(classes.select("class", "m"), "class").groupBy("class", list_of.alias("list")).agg(F.collect_list("record_id").alias("who"))
    lists = cut(lists.select("class", "list", "who"))
    across = class_edges(classes.join(lists.select("class", "who"), "class"), least, min_shared, plain, ("who",))
    across = across.withColumn("x", F.explode("who_a")).withColumn("y", F.explode("who_b"))
    alike = classes.where(F.lit(1.0) + EPS >= least).where("m > 1").select("class", F.lit(1.0).alias("weight"), F.col("n").cast("bigint").alias("shared_count"), F.lit(1.0).alias("jaccard"))
    pair = lists.join(alike, "class").join(lists.select("class", F.col("list").alias("other"), F.col("who").alias("whom")), "class")
    within = pair.where("list <= other").withColumn("x", F.explode("who")).withColumn("y", F.explode("whom")).where("list < other or x < y")
    columns = (F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "weight", "shared_count", "jaccard")
    return across.select(*columns).unionByName(within.select(*columns))


def profile_counts(clean: DataFrame, least: dict[str, float], min_shared: int = 2, plain: bool = False) -> DataFrame:
    """``profile, edges, sources`` of the network at every threshold: its edges and the records that are the lesser end of one.

    Counted by classes: a record is a source if a class linked to its own holds a greater one.
    """
    classes, members = keyword_classes(clean, min_shared)
    tops = members.groupBy("class").agg(F.max("record_id").alias("top"))
    classes = classes.join(tops, "class")
    found = class_edges(classes, min(least.values()), min_shared, plain, ("m", "top"))
    score = F.col("jaccard" if plain else "weight")
    ends = found.select(score.alias("score"), F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.col("top_b").alias("top"), (F.col("m_a") * F.col("m_b")).alias("edges")),
        F.struct(F.col("b").alias("class"), F.col("top_a").alias("top"), F.lit(0).cast("bigint").alias("edges")),
    )).alias("e")).select("score", "e.*")
    own = classes.where("m > 1").select(F.lit(1.0).alias("score"), "class", "top", F.expr("m * (m - 1) div 2").alias("edges"))
    reached = lambda v: F.col("score") + EPS >= v
    by_class = ends.unionByName(own).groupBy("class").agg(
        *(f for k, v in least.items() for f in (F.max(F.when(reached(v), F.col("top"))).alias(f"top_{k}"), F.sum(F.when(reached(v), F.col("edges"))).alias(f"edges_{k}")))
    )
    by_class = cut(by_class)
    sources = members.join(by_class.drop(*(f"edges_{k}" for k in least)), "class").agg(*(F.count_if(F.col("record_id") < F.col(f"top_{k}")).alias(f"sources_{k}") for k in least))
    edges = by_class.agg(*(F.sum(f"edges_{k}").alias(f"edges_{k}") for k in least))
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("profile"), F.col(f"edges_{k}").alias("edges"), F.col(f"sources_{k}").alias("sources")) for k in least)))
    return edges.crossJoin(sources).select(one.alias("p")).select("p.*").where("edges > 0")


def network_degrees(clean: DataFrame, least: float = 0.20, min_shared: int = 2) -> DataFrame:
    """``record_id, degree`` of every record with an edge, counted by classes."""
    classes, members = keyword_classes(clean, min_shared)
    ends = class_edges(classes, least, min_shared, carry=("m",)).select(F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.col("m_b").alias("degree")), F.struct(F.col("b").alias("class"), F.col("m_a").alias("degree")),
    )).alias("e")).select("e.*")
    own = classes.where("m > 1").where(F.lit(1.0) + EPS >= least).select("class", (F.col("m") - 1).alias("degree"))
    return members.join(ends.unionByName(own).groupBy("class").agg(F.sum("degree").alias("degree")), "class").select("record_id", "degree")


def _forests(links: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect what the given ones do; a task keeps those that join two of its trees."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = root(a), root(b)
                keep.append(p != q)
                up[p] = q
            # what is forgotten costs links that were not needed
            if len(up) > TREES_KEPT:
                up.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return links.mapInArrow(run, "a bigint, b bigint")


def network_components(clean: DataFrame, least: float = 0.20, min_shared: int = 2) -> DataFrame:
    """``record_id, component`` of every record with an edge: the least record of its component, found by classes."""
    classes, members = keyword_classes(clean, min_shared)
    own = classes.where("m > 1").where(F.lit(1.0) + EPS >= least).select(F.col("class").alias("a"), F.col("class").alias("b"))
    links = cut(_forests(class_edges(classes, least, min_shared).select("a", "b")).unionByName(own))
    told = members.join(connected_components(links).withColumnRenamed("node", "class"), "class")
    names = told.groupBy("component").agg(F.min("record_id").alias("first"))
    return told.join(names, "component").select("record_id", F.col("first").alias("component"))


def network_agreement(clean: DataFrame, assigned: DataFrame, least: float = 0.20, min_shared: int = 2) -> DataFrame:
    """``topic_agreement`` of the network, counted by the topics of classes; ``assigned`` has each record once."""
    classes, members = keyword_classes(clean, min_shared)
    topics = members.join(assigned.where("topic is not null"), "record_id").groupBy("class", "topic").agg(F.count(F.lit(1)).alias("v"))
    topics = topics.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("topic", "v"))).alias("topics"), F.sum("v").alias("e"))
    classes = cut(classes.join(topics, "class"))
    both = "aggregate(map_entries(topics_a), 0L, (s, x) -> s + x.value * coalesce(try_element_at(topics_b, x.key), 0L))"
    across = class_edges(classes, least, min_shared, carry=("e", "topics")).select((F.col("e_a") * F.col("e_b")).alias("edges"), F.expr(both).alias("same"))
    own = classes.where(F.lit(1.0) + EPS >= least).select(
        F.expr("e * (e - 1) div 2").alias("edges"), F.expr("aggregate(map_values(topics), 0L, (s, v) -> s + v * (v - 1) div 2)").alias("same")
    )
    within = across.unionByName(own).agg(
        F.coalesce(F.sum("edges"), F.lit(0)).alias("eligible_edges"), F.coalesce(F.sum("same"), F.lit(0)).alias("same_topic_edges")
    )
    return _against_chance(within, assigned)


def degrees(edges: DataFrame) -> DataFrame:
    """``record_id, degree`` of every record with an edge."""
    return (
        edges.select(F.explode(F.array("source", "target")).alias("record_id"))
        .groupBy("record_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def topic_agreement(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Share of edges within one topic, and the share that chance pairs would have."""
    a = assigned.select(F.col("record_id").alias("source"), F.col("topic").alias("ts"))
    b = assigned.select(F.col("record_id").alias("target"), F.col("topic").alias("tt"))
    within = edges.join(a, "source").join(b, "target").agg(
        F.count(F.lit(1)).alias("eligible_edges"), F.coalesce(F.sum(F.expr("int(ts = tt)")), F.lit(0)).alias("same_topic_edges")
    )
    return _against_chance(within, assigned)


def _against_chance(within: DataFrame, assigned: DataFrame) -> DataFrame:
    base = (
        assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("v"))
        .agg((F.sum(F.col("v") * (F.col("v") - 1)) / (F.sum("v") * (F.sum("v") - 1))).alias("baseline_share"))
    )
    return within.crossJoin(base).withColumn("same_topic_share", F.col("same_topic_edges") / F.col("eligible_edges"))
