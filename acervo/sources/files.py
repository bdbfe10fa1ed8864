"""Files in and out: delimited text, JSON, text folders, reports, exports, caches."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, parts: int | None = None) -> DataFrame:
    """A CSV with a header, quoted line breaks and an optional byte-order mark; gzip by suffix.

    A missing file gives an empty table of the schema. All columns are text unless a schema
    says otherwise. A gzip file is one task to read, so it is spread over ``parts`` after.
    """
    if not _exists(spark, path):
        kind = schema if isinstance(schema, T.StructType) else T.StructType() if schema is None else T._parse_datatype_string(schema)
        return spark.createDataFrame([], kind)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.csv(path)
    if df.columns and df.columns[0].startswith(BOM):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip(BOM).strip('"'))
    if schema is not None:
        kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        df = df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind])
    return df.repartition(parts) if parts and path.endswith(".gz") else df


def read_json(spark: SparkSession, path: str, schema: str, after: str | None = None) -> DataFrame:
    """JSON documents, one a file, tolerant of broken ones; ``after`` skips a script's prefix."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    body = F.regexp_extract("value", rf"(?s){re.escape(after)}\s*=?\s*(.*?);?\s*$", 1) if after else F.col("value")
    return raw.select("file", F.from_json(body, schema).alias("json")).where("json is not null")


def rehead(df: DataFrame, order: str, is_header: Column, names: dict[str, list[str]], group: str | None = None) -> DataFrame:
    """A sheet whose header row may appear again and move columns.

    ``df`` has ``order`` and ``cells`` (array). Each row is read by the last header above it;
    ``names`` maps an output column to the texts that head it.
    """
    w = Window.partitionBy(*([group] if group else [])).orderBy(order)
    h = F.last(F.when(is_header, F.transform("cells", lambda c: F.lower(F.trim(c)))), ignorenulls=True).over(w)
    rows = df.withColumn("_h", h).where(~is_header & F.col("_h").isNotNull())

    def pick(heads: list[str]) -> Column:
        at = F.greatest(*[F.array_position("_h", x.lower()) for x in heads], F.lit(0)) if len(heads) > 1 else F.array_position("_h", heads[0].lower())
        return F.when(at > 0, F.try_element_at("cells", at.cast("int")))

    return rows.select(*([group] if group else []), order, *[pick(heads).alias(name) for name, heads in names.items()])


def read_texts(spark: SparkSession, folder: str, known: DataFrame | None = None, key: str = "key") -> DataFrame:
    """``key, text`` of every text file of a folder, by name without suffix, but for keys already known."""
    raw = spark.read.text(folder, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]+$", "").alias(key), F.col("value").alias("text")
    )
    return raw if known is None else raw.join(known.select(key), key, "left_anti")


def read_reports(spark: SparkSession, folder: str, suffix: str = "md") -> DataFrame:
    """``date, title, items`` of dated Markdown reports (YYYY-MM-DD or YYYY-Www in the name)."""
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    date = F.regexp_extract("name", r"(\d{4}-(?:\d{2}-\d{2}|W\d{2}))", 1)
    return raw.where(F.endswith("name", F.lit(f".{suffix}")) & (date != "")).select(
        date.alias("date"),
        F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1).alias("title"),
        F.regexp_extract_all("text", F.lit(r"(?m)^###\s+\d+\.\s+(.+)$"), F.lit(1)).alias("items"),
        F.length("text").alias("chars"),
    )


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns that exist, in order, as CSV with a header."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not in the table yet; its columns grow as needed."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.option("mergeSchema", True).parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the columns of either, missing ones NULL, in the order of the first."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the last by ``order`` for every key."""
    from acervo.operators.joins import last_wins

    return last_wins(evolve(old, new), key, order)


def export_json(df: DataFrame, path: str, by: list[str], dictionary: str | None = None) -> DataFrame | None:
    """Compact JSON files partitioned by ``by``; one text column may become numbers into a written dictionary."""
    terms = None
    if dictionary:
        from acervo.operators.stability import ranked_by

        named = ranked_by(df.select(dictionary).distinct().withColumn("_s", F.lit(0)), "_s", dictionary)
        terms = named.select(dictionary, (F.col("rank") - 1).alias("code"))
        terms.write.mode("overwrite").json(f"{path}/_terms")
        df = df.join(terms, dictionary).drop(dictionary).withColumnRenamed("code", dictionary)
    df.write.mode("overwrite").partitionBy(*by).json(f"{path}/rows")
    return terms


def write_documents(df: DataFrame, path: str, key: str, text: str) -> None:
    """One folder per document; what is not in ``df`` any more is not in the folder either."""
    df.select(F.col(key).alias("document"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def missing_vectors(df: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose content has no cached vector under the same fingerprint."""
    return df.withColumn("fingerprint", F.sha2(F.coalesce(text, F.lit("")), 256)).join(cache.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def load_config(path: str, overrides: list[str] = (), env: dict[str, str] | None = None) -> dict:
    """A JSON or YAML configuration with ``a.b=value`` overrides; values are JSON where they can be."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        out = yaml.safe_load(body) or {}
    else:
        out = json.loads(body)
    for item in [*[f"{k}={v}" for k, v in (env or {}).items()], *overrides]:
        name, _, value = item.partition("=")
        at = out
        *parents, last = name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out
