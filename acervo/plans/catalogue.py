"""Named queries of the core and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acervo.operators.packed_values import split_packed
from acervo.plans import content_queries, detail_queries, network_queries, record_queries, review_queries, stream_queries, text_queries, topic_queries  # noqa: F401
from acervo.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from acervo.runtime import table

@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author and keyword of every record, one a row, with its position."""
    records = table(spark, sf_dir, "master_records").select("record_id", "authors", "keywords").distinct()
    return split_packed(records, "record_id", {"authors": True, "keywords": False}).distinct()
