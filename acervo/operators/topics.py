"""Diagnostics of partitions, topics and their terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """``group..., entropy, categories``: Shannon entropy (nats) of a category, NULL for fewer than two."""
    n = df.where(F.col(category).isNotNull()).groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*group))
    return (
        n.withColumn("h", -p * F.log(p))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("categories"), F.sum("h").alias("h"))
        .select(*group, F.when(F.col("categories") > 1, F.col("h")).alias("entropy"), "categories")
    )


def dominant(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """``group..., dominant, share, coverage``: the commonest known value (ties: the lesser), its share, the share known."""
    n = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    seen = F.col(category).isNotNull()
    w = Window.partitionBy(*group)
    first = n.withColumn("known", F.sum(F.when(seen, F.col("n")).otherwise(0)).over(w)).withColumn("all", F.sum("n").over(w))
    best = first.where(seen).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), category))).where("r = 1")
    return best.select(
        *group,
        F.col(category).alias("dominant"),
        (F.col("n") / F.col("known")).alias("share"),
        (F.col("known") / F.col("all")).alias("coverage"),
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, ari, nmi``: adjusted Rand index and normalised mutual information of two partitions."""
    t = contingency(df, a, b)
    pairs = lambda x: x * (x - 1) / 2
    joint = (
        t.withColumn("ra", F.sum("n").over(Window.partitionBy(a)))
        .withColumn("rb", F.sum("n").over(Window.partitionBy(b)))
    )
    total = t.agg(F.sum("n").alias("total"))
    inner = joint.crossJoin(F.broadcast(total)).agg(
        F.sum(pairs(F.col("n"))).alias("sij"),
        F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("ra") * F.col("rb")))).alias("mi"),
        F.max("total").alias("total"),
    )

    def side(c: str) -> DataFrame:
        m = t.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total))
        p = F.col("n") / F.col("total")
        return m.agg(F.sum(pairs(F.col("n"))).alias(f"s_{c}"), F.sum(-p * F.log(p)).alias(f"h_{c}"))

    all_ = inner.crossJoin(side(a)).crossJoin(side(b))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / pairs(F.col("total"))
    most = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return all_.select(
        F.col("total").cast("bigint").alias("n"),
        ((F.col("sij") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"),
        (F.col("mi") / F.nullif((F.col(f"h_{a}") + F.col(f"h_{b}")) / 2, F.lit(0.0))).alias("nmi"),
    )


def class_terms(tokens: DataFrame, top: int = 10) -> DataFrame:
    """``topic, term, weight, rank`` by class-based TF-IDF: sublinear counts, smooth idf over topics, length 1.

    ``tokens`` has ``topic, term``, one row per occurrence. Ties go to the lesser term.
    """
    tf = tokens.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = tf.select("topic").distinct().agg(F.count(F.lit(1)).alias("topics"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = (
        tf.join(df, "term").crossJoin(F.broadcast(n))
        .withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("topics")) / (1 + F.col("df"))) + 1))
    )
    of_topic = Window.partitionBy("topic")
    w = w.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_topic)))
    ranked = w.withColumn("rank", F.row_number().over(of_topic.orderBy(F.round("weight", 10).desc(), "term")))
    return ranked.where(F.col("rank") <= top).select("topic", "term", "weight", "rank")


def diversity(terms: DataFrame) -> DataFrame:
    """One row ``diversity``: distinct terms over all terms."""
    return terms.agg((F.countDistinct("term") / F.count(F.lit(1))).alias("diversity"))


def lexical_metrics(terms: DataFrame) -> DataFrame:
    """Per topic: share of terms no other topic has, mean and largest Jaccard to others, entropy of weights."""
    held = Window.partitionBy("term")
    t = terms.withColumn("topics", F.count(F.lit(1)).over(held))
    p = F.col("weight") / F.sum("weight").over(Window.partitionBy("topic"))
    own = t.withColumn("h", -p * F.log(p)).groupBy("topic").agg(
        F.avg((F.col("topics") == 1).cast("double")).alias("unique_share"), F.sum("h").alias("term_entropy"), F.count(F.lit(1)).alias("n")
    )
    sizes = own.select("topic", "n")
    a = terms.select(F.col("topic").alias("ta"), "term")
    b = terms.select(F.col("topic").alias("tb"), "term")
    shared = a.join(b, "term").where("ta <> tb").groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("c"))
    pairs = (
        shared.join(sizes.select(F.col("topic").alias("ta"), F.col("n").alias("na")), "ta")
        .join(sizes.select(F.col("topic").alias("tb"), F.col("n").alias("nb")), "tb")
        .select("ta", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("j"))
        .groupBy("ta")
        .agg(F.sum("j").alias("sum_j"), F.max("j").alias("max_j"))
    )
    n = sizes.agg(F.count(F.lit(1)).alias("topics"))
    return (
        own.join(pairs, own["topic"] == pairs["ta"], "left").crossJoin(F.broadcast(n))
        .select(
            "topic", "unique_share", "term_entropy",
            (F.coalesce("sum_j", F.lit(0.0)) / F.nullif(F.col("topics") - 1, F.lit(0))).alias("mean_similarity"),
            F.coalesce("max_j", F.lit(0.0)).alias("max_similarity"),
        )
    )


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap of two assignments of documents: ``left_topic, right_topic, overlap, jaccard, relation``.

    Both have ``document_id, topic``. A pair is one_to_one when each is the other's best.
    """
    l = left.select("document_id", F.col("topic").alias("left_topic"))
    r = right.select("document_id", F.col("topic").alias("right_topic"))
    both = l.join(r, "document_id")
    n = both.groupBy("left_topic", "right_topic").agg(F.count(F.lit(1)).alias("overlap"))
    nl = F.sum("overlap").over(Window.partitionBy("left_topic"))
    nr = F.sum("overlap").over(Window.partitionBy("right_topic"))
    j = n.withColumn("jaccard", F.col("overlap") / (nl + nr - F.col("overlap")))
    j = j.withColumn("bl", F.max("jaccard").over(Window.partitionBy("left_topic"))).withColumn(
        "br", F.max("jaccard").over(Window.partitionBy("right_topic"))
    )
    top_l, top_r = F.col("jaccard") == F.col("bl"), F.col("jaccard") == F.col("br")
    relation = (
        F.when(top_l & top_r & (F.col("jaccard") >= 0.15), "one_to_one")
        .when(top_l & (F.col("jaccard") >= 0.08), "split")
        .when(top_r & (F.col("jaccard") >= 0.08), "combined")
        .when(F.col("jaccard") >= 0.05, "partial")
        .otherwise("weak")
    )
    return j.select("left_topic", "right_topic", "overlap", "jaccard", relation.alias("relation"))


def over_time(df: DataFrame, topic: str, year: str) -> DataFrame:
    """``topic, year, n, in_year, share`` with a row for every topic in every year, zeros included."""
    d = df.where(F.col(topic).isNotNull() & F.col(year).isNotNull())
    n = d.groupBy(F.col(topic).alias("topic"), F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    years = n.groupBy("year").agg(F.sum("n").alias("in_year"))
    topics = n.select("topic").distinct()
    return (
        topics.crossJoin(years).join(n, ["topic", "year"], "left")
        .select("topic", "year", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "in_year",
                (F.coalesce("n", F.lit(0)) / F.col("in_year")).alias("share"))
    )


def umass(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """``topic, umass``: mean of ln((codocuments + 1) / documents) over ordered term pairs.

    ``terms`` has ``topic, term, rank``; ``tokens`` has distinct ``document_id, term``.
    """
    asked = terms.select("term").distinct()
    held = tokens.join(asked, "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    a = terms.select("topic", F.col("term").alias("ta"), F.col("rank").alias("ra"))
    b = terms.select("topic", F.col("term").alias("tb"), F.col("rank").alias("rb"))
    wanted = a.join(b, "topic").where("ra > rb")
    lists = held.groupBy("document_id").agg(F.sort_array(F.collect_set("term")).alias("t"))
    co = (
        lists.select("document_id", F.explode("t").alias("ta"), "t")
        .select("ta", F.explode("t").alias("tb"))
        .where("ta <> tb")
        .groupBy("ta", "tb")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return (
        wanted.join(df.select(F.col("term").alias("tb"), "df"), "tb")
        .join(co, ["ta", "tb"], "left")
        .groupBy("topic")
        .agg(F.avg(F.log((F.coalesce("c", F.lit(0)) + 1) / F.col("df"))).alias("umass"))
    )


def ambiguity(margin: Column, probability: Column, least_margin: float, least_probability: float) -> Column:
    """Whether an assignment is unsure: little probability or little margin."""
    return F.coalesce(margin < least_margin, F.lit(True)) | F.coalesce(probability < least_probability, F.lit(True))
