"""Joins the engine offers beyond plain equi-joins: fallback, validated, interpolating, last-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.runtime import broadcast_if_small


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last by ``order`` (ties: the greatest row)."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return picked.select(key, *[F.col("r")[c].alias(c) for c in rest])


def fallback(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], right_id: str, left_id: str) -> DataFrame:
    """Left rows with the one right row that the first telling key finds.

    ``keys`` are pairs of columns in order of trust. Returns ``left_id, right_id, status, by``:
    'matched' with one candidate, 'ambiguous' with several, 'standalone' with none. A row
    that a key finds is not looked up by later keys.
    """
    out = None
    rest = left
    for k, (a, b) in enumerate(keys):
        r = right.select(F.col(b).alias("_key"), F.col(right_id).alias("_rid")).where("_key is not null and _key <> ''")
        r = r.groupBy("_key").agg(F.min("_rid").alias("_rid"), F.max("_rid").alias("_max"))
        joined = rest.join(r, rest[a] == r["_key"], "left")
        hit = joined.where("_key is not null").select(
            F.col(left_id),
            F.when(F.col("_rid") == F.col("_max"), F.col("_rid")).alias(right_id),
            F.when(F.col("_rid") == F.col("_max"), "matched").otherwise("ambiguous").alias("status"),
            F.lit(a).alias("by"),
        )
        out = hit if out is None else out.unionByName(hit)
        rest = joined.where("_key is null").drop("_key", "_rid", "_max")
    none = rest.select(left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit("standalone").alias("status"), F.lit("").alias("by"))
    return out.unionByName(none)


def validated(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A 1:1 join; fails while running where a key is missing on one side."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit(f"keys of {key} do not match"))).otherwise(F.lit(True))
    return both.where(checked).drop("_l", "_r")


def interpolated(points: DataFrame, curve: DataFrame, x: str, group: str, y: str) -> DataFrame:
    """``points`` with ``y`` of each group's curve at ``x``, linear between known places, flat outside.

    Both tables are sorted together once per group: the known place before and after every
    point is carried by a window, so no range join happens.
    """
    p = points.select(group, F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.struct(*points.columns).alias("_p"))
    c = curve.select(group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    all_ = p.unionByName(c).withColumn("_k", F.when(F.col("_y").isNotNull(), F.struct("_x", "_y")))
    w = Window.partitionBy(group).orderBy("_x")
    before = all_.withColumn("_b", F.last("_k", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "_a", F.first("_k", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    )
    b, a = F.col("_b"), F.col("_a")
    value = (
        F.when(b.isNull(), a["_y"]).when(a.isNull(), b["_y"]).when(a["_x"] == b["_x"], b["_y"])
        .otherwise(b["_y"] + (a["_y"] - b["_y"]) * (F.col("_x") - b["_x"]) / (a["_x"] - b["_x"]))
    )
    return before.where("_p is not null").select(*[F.col("_p")[c].alias(c) for c in points.columns], value.alias(y))


def first_of_either(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Left rows with the least right id that any of the keys finds."""
    out = None
    for a, b in on:
        part = left.where(F.col(a).isNotNull()).join(right.select(F.col(b).alias("_k"), right_id), F.col(a) == F.col("_k")).select(left_id, right_id)
        out = part if out is None else out.unionAll(part)
    return out.groupBy(left_id).agg(F.min(right_id).alias(right_id))


def overrides(df: DataFrame, decisions: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` replaced where ``decisions`` has one for the key."""
    d = decisions.select(key, F.col("decision").alias("_d")).dropDuplicates([key])
    return df.join(broadcast_if_small(d), key, "left").withColumn(column, F.coalesce("_d", column)).drop("_d")


def contained(df: DataFrame, text: Column, needles: DataFrame, needle: str, least: int, gram: int = 5) -> DataFrame:
    """Rows whose ``text`` holds a needle of more than ``least`` characters, anywhere.

    The first and last word of a needle may be parts of words in the text; those between are
    whole there, so a needle meets texts by its longest inner word. One without an
    inner word meets them by its first ``gram`` letters, listed at every place of the text. Both are
    equi-joins with the containment test after them. Null and shorter needles find nothing.
    """
    n = needles.where(F.length(needle) > least).select(F.col(needle).alias("_n")).distinct()
    words = F.split("_n", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    n = n.withColumn("_w", longest)
    rows = df.withColumn("_t", text)
    whole = rows.withColumn("_w", F.explode(F.array_distinct(F.split("_t", " ")))).join(n.where("_w is not null"), "_w")
    bare = n.where("_w is null").withColumn("_w", F.substring("_n", 1, gram))
    hits = whole
    if not bare.isEmpty():
        places = F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1)))

        def grams(k: int) -> Column:
            return F.array_distinct(F.transform(places, lambda p: F.substring(F.col("_t"), p, F.lit(k))))

        # needles shorter than ``gram`` are listed by their own length: ``gram`` passes at most
        for (k,) in bare.select(F.length("_w")).distinct().collect():
            hits = hits.unionByName(rows.withColumn("_w", F.explode(grams(k))).join(bare.where(F.length("_w") == k), "_w"))
    return hits.where(F.contains("_t", F.col("_n"))).drop("_t", "_w", "_n").distinct()
