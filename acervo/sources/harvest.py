"""Harvest sources: paged works as JSON, OAI-PMH and Atom as XML, flattened by Catalyst.

``register(spark)`` adds the ``acervo_works`` data source. It pages through a service with
a cursor; a date filter is pushed to the server. ``pages`` (a folder of page files) stands
in for the service where there is no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WORK = (
    "id string, display_name string, publication_year int, publication_date string, doi string, type string, "
    "authorships array<struct<author:struct<display_name:string>>>, "
    "primary_location struct<source:struct<display_name:string,type:string>>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, "
    "keywords array<struct<display_name:string>>, open_access struct<is_oa:boolean,oa_url:string>, "
    "abstract_inverted_index map<string,array<int>>"
)


def fetch(url: str, tries: int = 4, wait: float = 1.0, opener=urllib.request.urlopen) -> str:
    """A page over HTTP, tried again with growing pauses."""
    for k in range(tries):
        try:
            with opener(url) as r:
                return r.read().decode("utf-8")
        except (urllib.error.URLError, TimeoutError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


class Works(DataSource):
    """Works of a paged service: one row per work as JSON text; options url or pages, query, since, max_pages."""

    @classmethod
    def name(cls) -> str:
        return "acervo_works"

    def schema(self) -> str:
        return "term string, page int, work string"

    def reader(self, schema) -> DataSourceReader:
        return WorksReader(dict(self.options))


class Term(InputPartition):
    def __init__(self, term: str):
        self.term = term


class WorksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Term(t) for t in self.options.get("query", "").split("|")]

    def read(self, partition: Term) -> Iterator[tuple[str, int, str]]:
        most = int(self.options["max_pages"]) if "max_pages" in self.options else None
        since = self.options.get("since", "")
        folder = self.options.get("pages")
        cursor, page = "*", 0
        while cursor and (most is None or page < most):
            if folder:
                file = Path(folder) / f"{partition.term.replace(' ', '_')}-{page}.json"
                if not file.exists():
                    return
                body = json.loads(file.read_text(encoding="utf-8"))
            else:
                asked = {"search": partition.term, "cursor": cursor} | ({"filter": f"from_publication_date:{since}"} if since else {})
                body = json.loads(fetch(f"{self.options['url']}?{urlencode(asked)}"))
            for work in body.get("results") or []:
                if not since or (work.get("publication_date") or "9999") >= since:
                    yield partition.term, page, json.dumps(work)
            cursor = (body.get("meta") or {}).get("next_cursor")
            page += 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Works)


def _either(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def records_of_works(works: DataFrame) -> DataFrame:
    """Flat bibliographic records of nested works."""
    from acervo.functions.text import from_inverted, pages

    w = works.select("term", F.from_json("work", WORK).alias("w")).where("w.id is not null")
    c = F.col
    names = F.array_join(F.transform("w.authorships", lambda a: a["author"]["display_name"]), "; ")
    words = F.array_join(F.transform("w.keywords", lambda k: k["display_name"]), "; ")
    return w.select(
        F.regexp_extract("w.id", r"([^/]+)$", 1).alias("record_id"),
        c("term").alias("search_term"),
        names.alias("authors"),
        c("w.display_name").alias("title"),
        F.when(c("w.abstract_inverted_index").isNotNull(), from_inverted(c("w.abstract_inverted_index"))).alias("abstract"),
        words.alias("keywords"),
        c("w.publication_year").alias("publication_year"),
        F.try_to_timestamp("w.publication_date", F.lit("yyyy-MM-dd")).cast("date").alias("publication_date"),
        c("w.doi").alias("doi"),
        c("w.type").alias("document_type"),
        _either(c("w.primary_location.source.display_name"), F.lit("unknown")).alias("origin"),
        pages(c("w.biblio.first_page"), c("w.biblio.last_page")).alias("pages"),
        c("w.open_access.is_oa").alias("is_oa"),
        c("w.open_access.oa_url").alias("pdf_url"),
    ).dropDuplicates(["record_id"])


def _texts(xml: str, tag: str) -> Column:
    return F.expr(f"xpath({xml}, \"//*[local-name()='{tag}']/text()\")")


def records_of_oai(pages_: DataFrame, terms: list[str], year_from: int = 2020, xml: str = "xml") -> DataFrame:
    """Records of OAI-PMH pages (column ``xml``): deleted ones skipped, local term and year filter."""
    records = pages_.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)(<(?:\w+:)?record\b.*?</(?:\w+:)?record>)"), F.lit(1))).alias("rec"))
    live = records.where(~F.col("rec").rlike(r'status="deleted"'))
    bare = live.select(F.regexp_replace("rec", r"(</?)\w+:", "$1").alias("rec")).select(F.regexp_replace("rec", r'\s\w+:\w+="[^"]*"', "").alias("rec"))
    year = F.regexp_extract(F.array_join(_texts("rec", "date"), " "), r"((?:19|20)\d{2})", 1).try_cast("int")
    flat = bare.select(
        F.try_element_at(_texts("rec", "identifier"), F.lit(1)).alias("record_id"),
        F.try_element_at(_texts("rec", "title"), F.lit(1)).alias("title"),
        F.array_join(_texts("rec", "creator"), "; ").alias("authors"),
        F.try_element_at(_texts("rec", "description"), F.lit(1)).alias("abstract"),
        F.array_join(_texts("rec", "subject"), "; ").alias("keywords"),
        year.alias("publication_year"),
    )
    hay = F.lower(F.concat_ws(" ", "title", "abstract", "keywords"))
    wanted = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(hay, t)) if terms else F.lit(True)
    return flat.where((F.col("publication_year") >= year_from) & wanted).dropDuplicates(["record_id"])


def records_of_atom(pages_: DataFrame, kinds: list[str], prefix: str, year_from: int = 2020, xml: str = "xml") -> DataFrame:
    """Records of Atom pages (column ``xml``): kinds of document, first year, DOI, page and PDF links; id by handle."""
    entries = pages_.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))).alias("e"))
    bare = entries.select(F.regexp_replace("e", r"(</?)\w+:", "$1").alias("e")).select(F.regexp_replace("e", r'\s\w+:\w+="[^"]*"', "").alias("e"))
    links = F.expr("xpath(e, \"//*[local-name()='link']/@href\")")
    told = F.array_join(F.concat(_texts("e", "identifier"), links), " ")
    year = F.regexp_extract(F.array_join(F.concat(_texts("e", "date"), _texts("e", "published")), " "), r"((?:19|20)\d{2})", 1).try_cast("int")
    flat = bare.select(
        F.try_element_at(_texts("e", "title"), F.lit(1)).alias("title"),
        F.array_join(F.concat(_texts("e", "name"), _texts("e", "creator")), "; ").alias("authors"),
        F.try_element_at(F.concat(_texts("e", "summary"), _texts("e", "description")), F.lit(1)).alias("abstract"),
        F.lower(F.array_join(_texts("e", "type"), "|")).alias("document_type"),
        year.alias("publication_year"),
        F.nullif(F.regexp_extract(told, r"(10\.\d{4,9}/[^\s<\"]+)", 1), F.lit("")).alias("doi"),
        F.try_element_at(F.filter(links, lambda u: ~F.endswith(F.lower(u), F.lit(".pdf"))), F.lit(1)).alias("url"),
        F.try_element_at(F.filter(links, lambda u: F.endswith(F.lower(u), F.lit(".pdf"))), F.lit(1)).alias("pdf_url"),
        F.nullif(F.regexp_extract(told, r"handle/([\w.]+/\w+)", 1), F.lit("")).alias("handle"),
    )
    wanted = F.exists(F.array(*[F.lit(k.lower()) for k in kinds]), lambda k: F.contains("document_type", k)) if kinds else F.lit(True)
    kept = flat.where((F.col("publication_year") >= year_from) & (wanted | (F.col("document_type") == "")))
    named = kept.withColumn("record_id", F.concat(F.lit(prefix), F.coalesce("handle", F.left(F.sha2(F.coalesce("url", "title"), 256), F.lit(16)))))
    return named.drop("handle").dropDuplicates(["record_id"])


def key_values(df: DataFrame, id_: str, key: str, value: str) -> DataFrame:
    """Key-value rows of items as one map per item, values of one key joined in order."""
    one = df.groupBy(id_, key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("v"))
    return one.groupBy(id_).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "v")))).alias("values"))
