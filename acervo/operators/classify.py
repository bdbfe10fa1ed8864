"""Rule-based classification of texts: weighted term lists, proximity, cascades, prototypes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import text as T


@dataclass(frozen=True)
class Rule:
    """Terms looked for in some columns, what each column's hits weigh, and words that must stand near."""

    name: str
    terms: tuple[str, ...]
    weights: dict[str, int]
    near: tuple[str, ...] = ()
    window: int = 8
    drop: tuple[str, ...] = field(default=())


def hits(df: DataFrame, rule: Rule) -> dict[str, Column]:
    """Terms of a rule found in each of its columns."""
    out = {}
    for name in rule.weights:
        text = F.col(f"_t_{name}") if f"_t_{name}" in df.columns else T.norm(F.coalesce(F.col(name), F.lit("")))
        if rule.drop:
            text = T.drop_phrases(text, list(rule.drop))
        found = T.phrase_hits(text, list(rule.terms))
        if rule.near:
            close = T.near_hit(text, [t for t in rule.terms if " " not in t], list(rule.near), rule.window)
            found = F.when(close, found).otherwise(F.array().cast("array<string>"))
        out[name] = found
    return out


def scores(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``score``, ``reasons`` (rules that hit) and ``evidence`` (terms found), all Catalyst.

    The normal form of each column and the hits of each rule are made as a column once.
    """
    names = []
    texts = sorted({c for r in rules for c in r.weights})
    for c in texts:
        df = df.withColumn(f"_t_{c}", T.norm(F.coalesce(F.col(c), F.lit(""))))
    for r in rules:
        for col, found in hits(df, r).items():
            name = f"_h_{r.name}_{col}"
            df = df.withColumn(name, found)
            names.append((r, col, name))
    score = sum((F.when(F.size(n) > 0, F.lit(r.weights[c])).otherwise(F.lit(0)) for r, c, n in names), F.lit(0))
    by_rule = [F.when(sum((F.size(n) for q, _, n in names if q is r), F.lit(0)) > 0, F.lit(r.name)) for r in rules]
    evidence = F.array_distinct(F.flatten(F.array(*[F.col(n) for _, _, n in names])))
    return df.withColumn("score", score).withColumn("reasons", F.array_compact(F.array(*by_rule))).withColumn("evidence", evidence).drop(*[n for _, _, n in names], *[f"_t_{c}" for c in texts])


def cascade(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The status of the first case that holds."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, status in cases[1:]:
        out = out.when(condition, F.lit(status))
    return out.otherwise(F.lit(otherwise))


def prototype_similarity(tokens: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``document_id, prototype, similarity``: TF-IDF cosine of documents to a few prototypes.

    Both inputs have one row per token: ``document_id, term`` and ``prototype, term``.
    Only terms of prototypes reach the join; idf is taken over the documents.
    """
    n = tokens.select("document_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    tf = tokens.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    d = tf.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = d.groupBy("document_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ld"))
    p = prototypes.groupBy("prototype", "term").agg(F.count(F.lit(1)).alias("tf")).join(idf, "term").withColumn("p", (1 + F.log("tf")) * F.col("idf"))
    lp = p.groupBy("prototype").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("lp"))
    dots = d.select("document_id", "term", "w").join(F.broadcast(p.select("prototype", "term", "p")), "term").groupBy("document_id", "prototype").agg(F.sum(F.col("w") * F.col("p")).alias("dot"))
    return dots.join(length, "document_id").join(F.broadcast(lp), "prototype").select("document_id", "prototype", (F.col("dot") / (F.col("ld") * F.col("lp"))).alias("similarity"))


__all__ = ["Rule", "cascade", "hits", "prototype_similarity", "scores"]
