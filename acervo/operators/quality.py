"""Quality of data and of decisions: profiles, audits, confusion, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.runtime import known


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, filled, distinct_values``: one pass for all columns."""
    aggs = [
        x
        for c in columns
        for x in (F.count(known(F.col(c).cast("string"))).alias(f"f_{c}"), F.countDistinct(known(F.col(c).cast("string"))).alias(f"d_{c}"))
    ]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def confusion(df: DataFrame, truth: Column, said: Column, group: list[str] | None = None) -> DataFrame:
    """True and false positives and negatives, precision, recall, F1, agreement and Cohen's kappa."""
    d = df.where(truth.isNotNull() & said.isNotNull())
    n = F.count_if
    counts = d.groupBy(*(group or [])).agg(
        n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    seen = (tp + tn) / total
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return (
        counts.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
        .withColumn("f1", div(2 * tp, 2 * tp + fp + fn)).withColumn("agreement", seen)
        .withColumn("kappa", div(seen - chance, 1 - chance))
    )


def weighted_precision(sample: DataFrame, population: DataFrame) -> DataFrame:
    """Precision and recall weighted to a population, per source and in total (a rollup).

    ``sample``: ``source, decided (bool), relevant (bool)``; ``population``: ``source, decided, records``.
    """
    rates = sample.where("relevant is not null").groupBy("source", "decided").agg(F.avg(F.col("relevant").cast("double")).alias("rate"))
    w = population.join(rates, ["source", "decided"])
    hit = F.col("rate") * F.col("records")
    inside = F.when(F.col("decided"), hit).otherwise(0.0)
    size = F.when(F.col("decided"), F.col("records")).otherwise(0)
    return w.rollup("source").agg(
        (F.sum(inside) / F.nullif(F.sum(size), F.lit(0))).alias("precision"), (F.sum(inside) / F.nullif(F.sum(hit), F.lit(0.0))).alias("recall")
    )


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
