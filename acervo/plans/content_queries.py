"""Queries over content: classification, sections, citations, bags of words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.functions import arrow
from acervo.functions import identifiers as I
from acervo.functions import text as T
from acervo.operators import classify
from acervo.plans.registry import query, sql_norm
from acervo.runtime import table

RULES = [
    classify.Rule("leadership", ("liderazgo", "leadership", "lideranca", "kepemimpinan"), {"title": 3, "abstract": 1}),
    classify.Rule("team", ("equipo directivo", "senior team", "equipe diretiva", "tim pimpinan"), {"title": 2, "abstract": 1}),
    classify.Rule("planning", ("planificacion", "planning", "planejamento"), {"abstract": 1}),
]


def _has(t, term):
    return f"contains(' ' || {t} || ' ', ' {term} ')"


def _any(t, terms):
    return "(" + " or ".join(_has(t, x) for x in terms) + ")"


_SCORE = " + ".join(f"{w} * {_any('t' if c == 'title' else 'a', r.terms)}::int" for r in RULES for c, w in r.weights.items())


@query(
    "rule_scores",
    f"""with n as (select distinct record_id, {sql_norm("coalesce(title, '')")} as t, {sql_norm("coalesce(abstract, '')")} as a from master_records),
    s as (select record_id, {_SCORE} as score, {_any('t', RULES[0].terms)} as in_title from n)
    select record_id, score::int as score, case when score >= 4 then 'high' when in_title or score >= 2 then 'review' else 'low' end as status from s""",
)
def rule_scores(spark, d):
    """Weighted term rules over title and abstract, then the first case of a cascade."""
    r = table(spark, d, "master_records").select("record_id", "title", "abstract").distinct()
    s = classify.scores(r, RULES)
    in_title = F.size(T.phrase_hits(T.norm(F.coalesce("title", F.lit(""))), list(RULES[0].terms))) > 0
    status = classify.cascade([(F.col("score") >= 4, "high"), (in_title | (F.col("score") >= 2), "review")], "low")
    return s.select("record_id", "score", status.alias("status")).distinct()


@query(
    "status_changes",
    f"""with n as (select distinct record_id, {sql_norm("coalesce(title, '')")} as t, {sql_norm("coalesce(abstract, '')")} as a from master_records),
    s as (select record_id, {_SCORE} as score from n)
    select before, after, count(*) as n from (select case when score >= 4 then 'high' when score >= 2 then 'review' else 'low' end as before,
      case when score >= 3 then 'high' when score >= 1 then 'review' else 'low' end as after from s) where before <> after group by 1, 2""",
)
def status_changes(spark, d):
    """What another set of thresholds would change."""
    s = classify.scores(table(spark, d, "master_records").select("record_id", "title", "abstract").distinct(), RULES)
    at = lambda hi, lo: classify.cascade([(F.col("score") >= hi, "high"), (F.col("score") >= lo, "review")], "low")
    return s.select(at(4, 2).alias("before"), at(3, 1).alias("after")).where("before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


PROTOTYPES = {"leadership": "school leadership senior team distributed practice", "management": "gestion escolar planificacion institucional recursos"}
_PROTO = " union all ".join(f"select '{k}' as prototype, unnest(string_split('{v}', ' ')) as term" for k, v in PROTOTYPES.items())


@query(
    "prototype_similarity",
    f"""with tok as (select doc_id, unnest(string_split({sql_norm('text')}, ' ')) as term from documents where text is not null),
    tf as (select doc_id, term, count(*) as tf from tok where term <> '' group by 1, 2), df as (select term, count(*) as df from tf group by 1),
    idf as (select term, ln((1 + (select count(distinct doc_id) from tf)) / (1 + df)) + 1 as idf from df),
    w as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join idf using (term)), ld as (select doc_id, sqrt(sum(w * w)) as ld from w group by 1),
    p0 as (select prototype, term, count(*) as tf from ({_PROTO}) group by 1, 2), p as (select prototype, term, (1 + ln(tf)) * idf as p from p0 join idf using (term)),
    lp as (select prototype, sqrt(sum(p * p)) as lp from p group by 1)
    select w.doc_id, p.prototype, round(sum(w * p) / (any_value(ld) * any_value(lp)), 6) as similarity from w join p using (term)
    join ld on ld.doc_id = w.doc_id join lp on lp.prototype = p.prototype group by 1, 2""",
)
def prototype_similarity(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    tokens = docs.select(F.col("doc_id").alias("document_id"), F.explode(F.split(T.norm("text"), " ")).alias("term")).where("term <> ''")
    protos = spark.createDataFrame(list(PROTOTYPES.items()), "prototype string, text string")
    got = classify.prototype_similarity(tokens, protos.select("prototype", F.explode(F.split("text", " ")).alias("term")))
    return got.select(F.col("document_id").alias("doc_id"), "prototype", F.round("similarity", 6).alias("similarity"))


@query(
    "bigram_counts",
    f"""with w as (select doc_id, string_split({sql_norm('text')}, ' ') as w from documents where text is not null),
    g as (select doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as gram from w where len(w) > 1)
    select gram, count(*) as tf, count(distinct doc_id) as df from g group by gram having count(distinct doc_id) >= 5""",
)
def bigram_counts(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split(T.norm("text"), " ").alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    g = docs.where("size(w) > 1").select("doc_id", F.explode(pairs).alias("gram"))
    per = g.groupBy("gram", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("gram").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")).where("df >= 5")


@query("article_sections")
def article_sections(spark, d):
    """The sections of full texts with their lengths."""
    docs = table(spark, d, "documents").where("doc_kind = 'fulltext' and text is not null")
    s = docs.select("doc_id", F.explode(arrow.section_map(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.name").alias("section"), F.length("s.text").alias("n_chars"))


@query("unicode_texts")
def unicode_texts(spark, d):
    """Texts in composed form with plain signs, without a list of sources at their end."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", arrow.cut_sources(arrow.unicode_text(F.col("text"))).alias("text"))


@query("citations")
def citations(spark, d):
    """A reference for every record, the last row of a repeated id."""
    r = table(spark, d, "master_records")
    w = Window.partitionBy("record_id").orderBy(F.col("ingested_at").desc_nulls_last())
    r = r.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    c = F.col
    return r.select("record_id", arrow.citations(c("authors"), c("publication_year"), c("title"), c("origin"), F.nullif(I.doi("doi"), F.lit(""))).alias("reference"))


@query(
    "paragraphs",
    r"""with p as (select doc_id, unnest(string_split(regexp_replace(replace(text, chr(13), ''), '\n[ \t]*\n\s*', chr(1), 'g'), chr(1))) as p from documents where text is not null)
    select doc_id, count(*) as n from p where length(trim(p, ' ')) >= 80 and not regexp_matches(p, '^#') group by doc_id""",
)
def paragraphs(spark, d):
    """How many substantive paragraphs a document has."""
    docs = table(spark, d, "documents").where("text is not null")
    parts = F.split(F.regexp_replace(F.replace("text", F.lit("\r"), F.lit("")), r"\n[ \t]*\n[ \t\n\f\r]*", "\x01"), "\x01")
    kept = F.filter(parts, lambda p: (F.length(F.trim(p)) >= 80) & ~F.startswith(p, F.lit("#")))
    return docs.select("doc_id", F.size(kept).cast("bigint").alias("n")).where("n > 0")


@query(
    "report_items",
    r"""select doc_id, unnest(regexp_extract_all(text, '### (\d+)\.', 1))::int as item from documents where doc_kind = 'weekly_report' and text is not null""",
)
def report_items(spark, d):
    """Numbered items of weekly reports."""
    docs = table(spark, d, "documents").where("doc_kind = 'weekly_report' and text is not null")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"### (\d+)\."), F.lit(1))).alias("item")).select("doc_id", F.col("item").cast("int").alias("item"))
