"""Search: inverted index, posting intersection, facets, ranked scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import text as T


def index_rows(df: DataFrame, key: str, text: Column | str) -> DataFrame:
    """``token, key``: distinct tokens of every row."""
    return df.select(F.explode(T.search_tokens(text)).alias("token"), F.col(key))


def postings(rows: DataFrame, key: str, chunk: int = 100_000) -> DataFrame:
    """``token, part, docs``: sorted postings by ranges of ``chunk`` keys, so no row grows with the corpus."""
    cut_up = rows.withColumn("part", F.floor(F.col(key) / chunk).cast("int"))
    return cut_up.groupBy("token", "part").agg(F.sort_array(F.collect_list(key)).alias("docs"))


def holding_all(rows: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """Keys that hold every token."""
    return (
        rows.where(F.col("token").isin(*tokens)).groupBy(key)
        .agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(set(tokens))).select(key)
    )


def facet(df: DataFrame, equal: dict[str, object], words: list[str], over: list[str]) -> DataFrame:
    """Rows that match all facets and hold every word somewhere in the named columns."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in over]))
    out = df
    for c, v in equal.items():
        out = out.where(F.col(c) == F.lit(v))
    for w in words:
        out = out.where(F.contains(hay, F.lit(w.lower())))
    return out


def ranked(df: DataFrame, key: str, query: list[str], fields: dict[str, float], phrase_bonus: float, top: int) -> DataFrame:
    """``key, score``: field weights per query token found, a bonus for the whole phrase; the best ``top``."""
    phrase = " ".join(query)
    score = F.lit(0.0)
    for name, weight in fields.items():
        text = F.concat(F.lit(" "), F.coalesce(T.norm(name), F.lit("")), F.lit(" "))
        for q in query:
            score = score + F.when(F.contains(text, F.lit(f" {q} ")), F.lit(weight)).otherwise(0.0)
        score = score + F.when(F.contains(text, F.lit(f" {phrase} ")), F.lit(phrase_bonus)).otherwise(0.0)
    return df.select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(top)


def best_part(df: DataFrame, key: str, text: str, query: list[str], split: str = r"\n[ \t]*\n") -> DataFrame:
    """``key, pos, hits``: the paragraph with most occurrences of query words (ties: the first)."""
    parts = df.select(key, F.posexplode(F.split(text, split)).alias("pos", "part"))
    hits = sum((F.regexp_count(T.norm("part"), F.lit(rf"(?<![a-z0-9]){q}(?![a-z0-9])")) for q in query), F.lit(0))
    best = parts.withColumn("hits", hits).where("hits > 0").groupBy(key).agg(F.max(F.struct("hits", (-F.col("pos")).alias("back"))).alias("b"))
    return best.select(key, (-F.col("b")["back"]).cast("int").alias("pos"), F.col("b")["hits"].alias("hits"))
