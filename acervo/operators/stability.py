"""Stability of partitions, intervals, scores over many criteria, assignments of clusters."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bootstrap_share(df: DataFrame, group: list[str], flag: str, samples: int = 500, seed: int = 42) -> DataFrame:
    """``group..., share, low, high``: 95 % bootstrap interval of a share.

    A resample of n yes/no rows is a binomial draw, so only the counts of a group are needed
    and no group is gathered.
    """
    n = df.where(F.col(flag).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("yes"))

    @F.pandas_udf("struct<low:double,high:double>")
    def draw(name: pd.Series, n: pd.Series, yes: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for g, size, k in zip(name, n, yes):
            rng = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big")])
            means = np.sort(rng.binomial(int(size), k / size, samples) / size)
            out.append((means[int(0.025 * (samples - 1))], means[int(0.975 * (samples - 1))]))
        return pd.DataFrame(out, columns=["low", "high"])

    name = F.concat_ws("|", *[F.col(g).cast("string") for g in group])
    return n.withColumn("i", draw(name, "n", "yes")).select(*group, (F.col("yes") / F.col("n")).alias("share"), "i.low", "i.high")


def run_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Means and deviations of runs, the base run's comparison with itself left out."""
    r = runs.where("seed <> base_seed")
    return r.groupBy("base_seed").agg(
        F.count(F.lit(1)).alias("runs"), *[x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"sd_{m}"))]
    )


def term_stability(base: DataFrame, runs: DataFrame) -> DataFrame:
    """``topic, stability``: mean over runs of the best Jaccard of a topic's terms with any topic of the run.

    ``base``: ``topic, term``; ``runs``: ``run, topic, term``.
    """
    nb = base.groupBy("topic").agg(F.count(F.lit(1)).alias("nb"))
    nr = runs.groupBy("run", F.col("topic").alias("other")).agg(F.count(F.lit(1)).alias("nr"))
    shared = base.join(runs.withColumnRenamed("topic", "other"), "term").groupBy("run", "topic", "other").agg(F.count(F.lit(1)).alias("c"))
    j = shared.join(nb, "topic").join(nr, ["run", "other"]).withColumn("j", F.col("c") / (F.col("nb") + F.col("nr") - F.col("c")))
    best = j.groupBy("run", "topic").agg(F.max("j").alias("j"))
    grid = nb.select("topic").crossJoin(runs.select("run").distinct())
    return grid.join(best, ["run", "topic"], "left").groupBy("topic").agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("stability"))


def multi_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``df`` with ``score``: weighted mean of min-max scaled metrics, weights of missing ones shared out.

    A negative weight prefers small values.
    """
    lo_hi = df.agg(*[x for m in weights for x in (F.min(m).alias(f"_lo_{m}"), F.max(m).alias(f"_hi_{m}"))])
    j = df.crossJoin(F.broadcast(lo_hi))
    total, used = F.lit(0.0), F.lit(0.0)
    for m, w in weights.items():
        span = F.nullif(F.col(f"_hi_{m}") - F.col(f"_lo_{m}"), F.lit(0.0))
        x = F.when(F.col(m).isNotNull(), F.coalesce((F.col(m) - F.col(f"_lo_{m}")) / span, F.lit(1.0)))
        x = 1 - x if w < 0 else x
        total = total + F.coalesce(x * abs(w), F.lit(0.0))
        used = used + F.when(x.isNotNull(), F.lit(abs(w))).otherwise(0.0)
    return j.withColumn("score", total / F.nullif(used, F.lit(0.0))).drop(*lo_hi.columns)


def co_assignment(df: DataFrame, key: str, topic: str) -> DataFrame:
    """``first, second, n, scaled``: documents that hold two topics, scaled by the largest."""
    d = df.select(key, topic).distinct()
    pairs = d.select(key, F.col(topic).alias("first")).join(d.select(key, F.col(topic).alias("second")), key).where("first < second")
    n = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select("first", "second", "n", (F.col("n") / F.col("top")).alias("scaled"))


def _hungarian(cost: list[list[float]]) -> list[int]:
    """Least-cost assignment of rows to columns (rows <= columns) by shortest augmenting paths."""
    n, m = len(cost), len(cost[0])
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def assign(overlaps: DataFrame, most: int = 2_000) -> list[tuple[str, str, float]]:
    """The one-to-one assignment of clusters of greatest total overlap.

    ``overlaps``: ``left, right, overlap``. The matrix of clusters (not documents) comes to
    the driver; more than ``most`` clusters on a side are refused.
    """
    sides = overlaps.agg(F.countDistinct("left").alias("a"), F.countDistinct("right").alias("b")).first()
    if max(sides["a"], sides["b"]) > most:
        raise ValueError(f"{max(sides['a'], sides['b'])} clusters; at most {most} are assigned")
    rows = overlaps.groupBy("left", "right").agg(F.sum("overlap").alias("o")).collect()
    if not rows:
        return []
    left, right = sorted({r["left"] for r in rows}), sorted({r["right"] for r in rows})
    value = {(r["left"], r["right"]): float(r["o"]) for r in rows}
    flip = len(left) > len(right)
    a, b = (right, left) if flip else (left, right)
    got = _hungarian([[-(value.get((y, x), 0.0) if flip else value.get((x, y), 0.0)) for y in b] for x in a])
    pairs = [((b[j], a[i]) if flip else (a[i], b[j])) for i, j in enumerate(got) if j >= 0]
    return sorted((x, y, value.get((x, y), 0.0)) for x, y in pairs if value.get((x, y), 0.0) > 0)


def npmi(terms: DataFrame, windows: DataFrame) -> DataFrame:
    """``topic, npmi``: mean normalised pointwise mutual information of term pairs over text windows.

    ``terms``: ``topic, term``; ``windows``: distinct ``window, term``.
    """
    held = windows.join(terms.select("term").distinct(), "term", "left_semi")
    total = windows.agg(F.countDistinct("window").alias("total"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lists = held.groupBy("window").agg(F.sort_array(F.collect_set("term")).alias("t"))
    co = (
        lists.select(F.explode("t").alias("ta"), "t").select("ta", F.explode("t").alias("tb")).where("ta < tb")
        .groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("c"))
    )
    a, b = terms.select("topic", F.col("term").alias("ta")), terms.select("topic", F.col("term").alias("tb"))
    p = (
        a.join(b, "topic").where("ta < tb").join(co, ["ta", "tb"], "left")
        .join(df.select(F.col("term").alias("ta"), F.col("df").alias("da")), "ta")
        .join(df.select(F.col("term").alias("tb"), F.col("df").alias("db")), "tb")
        .crossJoin(F.broadcast(total))
    )
    pab = F.col("c") / F.col("total")
    value = F.log(pab * F.col("total") * F.col("total") / (F.col("da") * F.col("db"))) / F.nullif(-F.log(pab), F.lit(0.0))
    return p.groupBy("topic").agg(F.avg(F.when(F.col("c").isNull(), F.lit(-1.0)).otherwise(F.coalesce(value, F.lit(1.0)))).alias("npmi"))


def ranked_by(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """``df`` with its rank: ranges of the score are counted, then rows ranked within a range.

    A global rank without one task that holds all rows.
    """
    parts = df.repartitionByRange(F.col(score).desc(), *ties).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(F.col(score).desc(), *ties)))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    return parts.join(F.broadcast(ahead), "_p").withColumn("rank", F.col("_a") + F.col("_i")).drop("_p", "_i", "_a")
