"""Review of labels, topics and exports: modes, bindings, alerts, samples, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.classify import cascade


def modes(df: DataFrame, by_mode: dict[str, Column]) -> DataFrame:
    """``df`` once for every mode whose predicate a row meets, with ``mode``; a null predicate is not met."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in by_mode.items()]))
    return df.withColumn("mode", F.explode(met))


def alerts(by_name: dict[str, Column]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in by_name.items()]))


def set_fingerprint(key: str) -> Column:
    """An aggregate that is equal for equal sets of keys, in any order: no set is gathered."""
    return F.sum(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"))


def bind_labels(proposals: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """``topics`` with the label proposed for them and how it is ``bound``.

    A proposal holds where its fingerprint is the topic's; failing that, where its descriptor and count
    both are; else the topic is 'unbound' and its label null. Both sides have
    ``topic, descriptor, n, fingerprint``; proposals have ``label`` too.
    """
    p = proposals.select(F.col(topic).alias("_t"), F.col("descriptor").alias("_d"), F.col("n").alias("_n"), F.col("fingerprint").alias("_f"), "label")
    same = F.col("_f") == F.col("fingerprint")
    alike = (F.col("_d") == F.col("descriptor")) & (F.col("_n") == F.col("n"))
    bound = cascade([(F.coalesce(same, F.lit(False)), "fingerprint"), (F.coalesce(alike, F.lit(False)), "descriptor")], "unbound")
    joined = topics.join(p, topics[topic] == p["_t"], "left").withColumn("bound", bound)
    return joined.withColumn("label", F.when(F.col("bound") != "unbound", F.col("label"))).drop("_t", "_d", "_n", "_f")


def reconciled(kept: DataFrame, moved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Kept rows with blanks of ``columns`` filled from the least value that their moved rows had, and ``n_moved``."""
    told = moved.groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in columns], F.count(F.lit(1)).alias("n_moved"))
    rows = kept.join(told, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns})
    return rows.withColumn("n_moved", F.coalesce("n_moved", F.lit(0).cast("bigint"))).drop(*(f"_{c}" for c in columns))


def accounting_issues(expected: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Keys whose ``expected`` and ``counted`` numbers differ; a key that one side lacks counts 0 there."""
    both = expected.join(counted, key, "full").select(
        key, F.coalesce("expected", F.lit(0).cast("bigint")).alias("expected"), F.coalesce("counted", F.lit(0).cast("bigint")).alias("counted")
    )
    return both.where("expected <> counted")


def mixture_aggregates(theta: DataFrame, key: str, least: float = 0.10) -> DataFrame:
    """Per topic of ``key, topic, share``: mean, median, mass, documents it dominates (ties: the least topic), documents from ``least`` on."""
    top = theta.groupBy(key).agg(F.max_by("topic", F.struct("share", (-F.col("topic")).alias("t"))).alias("topic"))
    dominant = top.groupBy("topic").agg(F.count(F.lit(1)).alias("dominant"))
    return (
        theta.groupBy("topic")
        .agg(F.avg("share").alias("mean"), F.percentile("share", 0.5).alias("median"), F.sum("share").alias("mass"), F.count_if(F.col("share") >= least).alias("present"))
        .join(dominant, "topic", "left")
        .withColumn("dominant", F.coalesce("dominant", F.lit(0).cast("bigint")))
    )


def positions(df: DataFrame, group: list[str], score: str, key: str, competitive: int = 3) -> DataFrame:
    """``position`` by score within a group, and its ``status``: preferred, competitive or rejected."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), key)
    p = F.col("position")
    return df.withColumn("position", F.row_number().over(w)).withColumn(
        "status", cascade([(p == 1, "preferred"), (p <= competitive, "competitive")], "rejected")
    )


def strata_samples(df: DataFrame, group: list[str], key: str, orders: dict[str, list[Column]], size: int) -> DataFrame:
    """``size`` rows of every group by each order: ``stratum, pick`` and the columns of ``df``; ties go to the lesser key."""
    out = []
    for name, order in orders.items():
        picked = df.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy(*order, key))).where(F.col("pick") <= size)
        out.append(picked.withColumn("stratum", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def multi_label_sample(df: DataFrame, key: str, orders: dict[str, list[Column]], size: int) -> DataFrame:
    """Rows among the first ``size`` by any of the orders, with the ``strata`` that chose them."""
    tops = [df.orderBy(*order, key).limit(size).select(key, F.lit(name).alias("stratum")) for name, order in orders.items()]
    return reduce(DataFrame.unionByName, tops).groupBy(key).agg(F.array_sort(F.collect_set("stratum")).alias("strata"))


def best_with_margin(df: DataFrame, group: str, score: str, least: float = 0.84, margin: float = 0.07) -> DataFrame:
    """The best score of each group, its margin to the second, and whether that settles it: matched, ambiguous or none."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc())
    top = df.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    both = top.groupBy(group).agg(F.max(score).alias("best"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("second"))
    gap = F.col("best") - F.coalesce("second", F.lit(0.0))
    status = cascade([(F.col("best") < least, "none"), (gap < margin, "ambiguous")], "matched")
    return both.select(group, "best", gap.alias("margin"), status.alias("status"))


def superseded(df: DataFrame, key: str, precedence: dict[str, int], column: str) -> DataFrame:
    """The row of each key whose ``column`` takes precedence (greatest number; others 0), with the number of rows it hides."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in precedence.items() for x in kv])[F.col(column)], F.lit(0))
    return df.groupBy(key).agg(F.max_by(column, F.struct(rank, F.col(column))).alias(column), (F.count(F.lit(1)) - 1).alias("hidden"))


def cache_states(candidates: DataFrame, asked: DataFrame, key: str, status: str, errors: str) -> DataFrame:
    """Every asked key: 'retry' where its cached status is an error, 'done' where it is another, 'missing' where none is cached."""
    cached = candidates.groupBy(key).agg(F.max(F.struct(F.col(status).isNotNull().cast("int"), F.col(status)))[status].alias("_s"), F.lit(True).alias("_in"))
    state = cascade([(F.col("_in").isNull(), "missing"), (F.coalesce(F.col("_s").rlike(errors), F.lit(False)), "retry")], "done")
    return asked.select(key).distinct().join(cached, key, "left").select(key, state.alias("state"))
