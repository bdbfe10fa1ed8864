"""Record-level operators: inference, evidence, flags, fills, corrections, sentence picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.text import clean_value
from acervo.runtime import broadcast_if_small


def infer(column: Column, rules: list[tuple[Column, str]]) -> Column:
    """The value, or where it is blank that of the first rule that holds."""
    out = F.when(clean_value(column) != "", column)
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(""))


def evidence(text: Column, pattern: str, around: int = 40) -> Column:
    """Excerpts around every match of a pattern."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)(.{{0,{around}}}(?:{pattern}).{{0,{around}}})"), F.lit(1))


def flags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def fill(df: DataFrame, source: DataFrame, key: str, columns: list[str], overwrite: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with blanks of ``columns`` filled from ``source``, and ``changed``: which were. Doing it twice changes nothing."""
    s = source.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    j = df.join(broadcast_if_small(s), key, "left")

    def takes(c: str) -> Column:
        new = F.col(f"_s_{c}").isNotNull() & ~F.col(f"_s_{c}").eqNullSafe(F.col(c))
        blank = F.col(c).isNull() | (clean_value(F.col(c).cast("string")) == "")
        return new if c in overwrite else new & blank

    j = j.withColumn("changed", F.array_compact(F.array(*[F.when(takes(c), F.lit(c)) for c in columns])))
    for c in columns:
        j = j.withColumn(c, F.when(F.array_contains("changed", c), F.col(f"_s_{c}")).otherwise(F.col(c)))
    return j.drop(*[f"_s_{c}" for c in columns])


def corrected(df: DataFrame, corrections: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Point updates ``key, field, value, evidence``: only allowed fields, only with evidence."""
    ok = corrections.where(F.col("field").isin(*allowed) & (clean_value("evidence") != ""))
    wide = ok.groupBy(key).pivot("field", allowed).agg(F.max("value"))
    j = df.join(broadcast_if_small(wide.select(key, *[F.col(c).alias(f"_c_{c}") for c in allowed])), key, "left")
    for c in allowed:
        j = j.withColumn(c, F.coalesce(F.col(f"_c_{c}").try_cast(df.schema[c].dataType), F.col(c)))
    return j.drop(*[f"_c_{c}" for c in allowed])


def where_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition, or all rows where none does."""
    some = df.agg(F.coalesce(F.max(condition.cast("int")), F.lit(0)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).where(condition | (F.col("_some") == 0)).drop("_some")


def pick_sentences(sentences: Column, pattern: str, most: int = 2, prefix: int = 40, chars: int = 300) -> Column:
    """The first sentences that match, distinct in their beginnings, cut to a length."""
    hit = F.filter(sentences, lambda s: s.rlike(pattern))
    kept = F.aggregate(
        hit,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(F.exists(acc, lambda k: F.left(k, F.lit(prefix)) == F.left(s, F.lit(prefix))), acc).otherwise(F.array_append(acc, s)),
    )
    return F.transform(F.slice(kept, 1, most), lambda s: F.left(s, F.lit(chars)))


def latest(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The last row of every group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_top_up(df: DataFrame, score: str, least: float, minimum: int, *ties: str) -> DataFrame:
    """Rows at or above a threshold; where that leaves too few, the best ``minimum``.

    The best rows are a bounded top-k, so nothing is ordered in one task.
    """
    enough = df.agg((F.count_if(F.col(score) >= least) >= minimum).alias("_enough"))
    above = df.crossJoin(F.broadcast(enough)).where(F.col("_enough") & (F.col(score) >= least)).drop("_enough")
    top = df.orderBy(F.col(score).desc(), *ties).limit(minimum).crossJoin(F.broadcast(enough)).where(~F.col("_enough")).drop("_enough")
    return above.unionByName(top)


def carried_over(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A new export with what people had entered in the old one."""
    o = old.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = new.join(o, key, "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(F.nullif(F.col(f"_o_{c}"), F.lit("")), F.col(c)))
    return j.drop(*[f"_o_{c}" for c in columns])


def search_either(df: DataFrame, metadata: Column, hits: DataFrame, key: str) -> DataFrame:
    """Rows that match in their metadata or in the index; ``text_only`` marks those of the index alone."""
    h = hits.select(key).distinct().withColumn("_hit", F.lit(True))
    j = df.join(h, key, "left").withColumn("_m", F.coalesce(metadata, F.lit(False)))
    return j.where(F.col("_m") | F.col("_hit").isNotNull()).withColumn("text_only", ~F.col("_m")).drop("_m", "_hit")
