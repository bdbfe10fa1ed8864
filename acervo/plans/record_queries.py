"""Queries over records: joins, duplicates, corpus, quality, search, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.functions import identifiers as I
from acervo.functions import text as T
from acervo.operators import dedup, joins, quality, retrieval, sampling
from acervo.plans.registry import query, sql_ascii, sql_clean, sql_doi, sql_norm
from acervo.runtime import broadcast_if_small, cut, table

NULLS = "('', 'nan', 'none', 'null', 'na', 'n/a')"
_LAST = "select * from (select *, row_number() over (partition by record_id order by ingested_at desc nulls last) as _r from master_records) where _r = 1"


def _latest(spark, d):
    r = table(spark, d, "master_records")
    w = Window.partitionBy("record_id").orderBy(F.col("ingested_at").desc_nulls_last())
    return r.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


@query(
    "documents_with_records",
    f"""select doc_id, d.record_id, r.title is not null as known, coalesce(d.publication_year, r.publication_year) as year
    from documents d left join ({_LAST}) r on r.record_id = d.record_id""",
)
def documents_with_records(spark, d):
    """Left join by key, the last row of a repeated key winning, with columns coalesced."""
    r = joins.last_wins(table(spark, d, "master_records").select("record_id", "ingested_at", "title", "publication_year"), "record_id", "ingested_at")
    docs = table(spark, d, "documents").select("doc_id", "record_id", F.col("publication_year").alias("y"))
    return docs.join(r, "record_id", "left").select(
        "doc_id", "record_id", F.col("title").isNotNull().alias("known"), F.coalesce("y", "publication_year").alias("year")
    )


@query(
    "fallback_matches",
    f"""with c as (select distinct candidate_id, {sql_ascii('match_title')} as t from metadata_enrichment),
    r as (select record_id, {sql_ascii('title')} as t from master_records),
    m as (select t, min(record_id) as a, max(record_id) as b from r where t <> '' group by t)
    select candidate_id, case when a = b then a end as record_id,
      case when m.t is null then 'standalone' when a = b then 'matched' else 'ambiguous' end as status,
      case when m.t is null then '' else 't' end as by from c left join m on m.t = c.t""",
)
def fallback_matches(spark, d):
    """Candidates to records by title: one match, several, or none."""
    c = table(spark, d, "metadata_enrichment").select("candidate_id", T.ascii_key("match_title").alias("t")).distinct()
    r = table(spark, d, "master_records").select("record_id", T.ascii_key("title").alias("t"))
    return joins.fallback(c, r, [("t", "t")], "record_id", "candidate_id")


@query(
    "corpus_records",
    f"""with c as (select distinct document_id, record_id, {sql_doi('doi_normalized')} as k from corpus_builder),
    r as (select record_id, {sql_doi('doi')} as k from master_records),
    x as (select document_id, r.record_id from c join r on r.record_id = c.record_id
      union all select document_id, r.record_id from c join r on r.k = c.k where c.k <> '' and r.k <> '')
    select document_id, min(record_id) as record_id from x group by document_id""",
)
def corpus_records(spark, d):
    """The first record that either the id or the DOI finds."""
    c = table(spark, d, "corpus_builder").select("document_id", F.col("record_id").alias("rid"), F.nullif(I.doi("doi_normalized"), F.lit("")).alias("k")).distinct()
    r = table(spark, d, "master_records").select("record_id", F.col("record_id").alias("rid"), F.nullif(I.doi("doi"), F.lit("")).alias("k"))
    return joins.first_of_either(c, r, [("rid", "rid"), ("k", "k")], "document_id", "record_id")


@query("records_with_documents", "select distinct record_id from master_records where record_id in (select record_id from documents where record_id is not null)")
def records_with_documents(spark, d):
    return table(spark, d, "master_records").join(table(spark, d, "documents").select("record_id"), "record_id", "left_semi").select("record_id").distinct()


@query("records_pending", "select distinct record_id from master_records where record_id not in (select record_id from documents where record_id is not null)")
def records_pending(spark, d):
    return table(spark, d, "master_records").join(table(spark, d, "documents").select("record_id"), "record_id", "left_anti").select("record_id").distinct()


@query("shared_record_ids", "select record_id from corpus_builder where record_id is not null intersect select record_id from documents where record_id is not null")
def shared_record_ids(spark, d):
    c = table(spark, d, "corpus_builder").select("record_id").where("record_id is not null")
    return c.intersect(table(spark, d, "documents").select("record_id").where("record_id is not null"))


@query(
    "union_of_sources",
    """select * from (select *, row_number() over (partition by id order by priority, title) as r from (
      select record_id as id, title, 1 as priority from master_records where record_id is not null
      union all select record_id, title, 2 from corpus_builder where record_id is not null)) where r = 1""",
)
def union_of_sources(spark, d):
    """Tables put together by name, the first in order of trust kept for every id."""
    a = table(spark, d, "master_records").where("record_id is not null").select(F.col("record_id").alias("id"), "title", F.lit(1).alias("priority"))
    b = table(spark, d, "corpus_builder").where("record_id is not null").select(F.col("record_id").alias("id"), "title", F.lit(2).alias("priority"))
    w = Window.partitionBy("id").orderBy("priority", F.col("title").asc_nulls_last())
    return a.unionByName(b, allowMissingColumns=True).withColumn("r", F.row_number().over(w)).where("r = 1")


@query(
    "interpolated_values",
    """with k as (select event_type as g, date_trunc('hour', ts) as h, avg(value) as v from events group by 1, 2),
    c as (select g, epoch(h) as x, v from k where hour(h) % 6 = 0),
    p as (select distinct g, epoch(h) as x from k where hour(h) % 6 <> 0),
    b as (select p.g, p.x, max(c.x) filter (where c.x <= p.x) as bx, min(c.x) filter (where c.x >= p.x) as ax from p left join c on c.g = p.g group by 1, 2)
    select b.g, b.x::bigint as x, round(case when bx is null then y2.v when ax is null then y1.v when bx = ax then y1.v
      else y1.v + (y2.v - y1.v) * (b.x - bx) / (ax - bx) end, 6) as v
    from b left join c y1 on y1.g = b.g and y1.x = bx left join c y2 on y2.g = b.g and y2.x = ax""",
)
def interpolated_values(spark, d):
    """Hourly means that fall between six-hourly ones, read off the line between those."""
    h = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    k = table(spark, d, "events").groupBy(F.col("event_type").alias("g"), h.alias("h")).agg(F.avg("value").alias("v"))
    x = F.unix_timestamp("h")
    curve = k.where("hour(h) % 6 = 0").select("g", x.cast("double").alias("x"), "v")
    points = k.where("hour(h) % 6 <> 0").select("g", x.alias("x"))
    return joins.interpolated(points, curve, "x", "g", "v").select("g", "x", F.round("v", 6).alias("v"))


@query(
    "title_pairs",
    f"""with r as (select distinct record_id, {sql_ascii('title')} as t from ({_LAST}) where publication_year is not null)
    select t as title, count(*) as records from r where length(t) >= 12 group by t having count(*) > 1""",
)
def title_pairs(spark, d):
    r = _latest(spark, d).where("publication_year is not null").select("record_id", T.ascii_key("title").alias("title")).where("length(title) >= 12")
    return r.groupBy("title").agg(F.count(F.lit(1)).alias("records")).where("records > 1")


@query("duplicate_components")
def duplicate_components(spark, d):
    """Records of one publication by DOI, link, title and abstract, never two DOIs together; the row that stands for them."""
    r = _latest(spark, d)
    keyed = cut(dedup.with_keys(r).select("record_id", "k_doi", "k_url", "k_title", "k_names", "k_abstract", "year"))
    parts = dedup.constrained_components(dedup.candidate_links(keyed), keyed.where("k_doi is not null").select(F.col("record_id").alias("node"), F.col("k_doi").alias("doi")))
    return dedup.survivors(r, cut(parts))


@query("merged_records")
def merged_records(spark, d):
    """One merged row per publication."""
    return dedup.merged(_latest(spark, d), cut(duplicate_components(spark, d)))


@query("fuzzy_title_pairs")
def fuzzy_title_pairs(spark, d):
    """Pairs of distinct titles of one year with a gestalt ratio of 0.92 or more."""
    return dedup.fuzzy_titles(_latest(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(
    "group_survivors",
    f"""with c as (select distinct duplicate_group_id as g, document_id, has_pdf, doi_normalized, title, abstract, keywords from corpus_builder where duplicate_group_id is not null)
    select g, arg_max(document_id, (coalesce(has_pdf, false)::int, ({sql_clean('doi_normalized')} <> '')::int + ({sql_clean('title')} <> '')::int
      + ({sql_clean('abstract')} <> '')::int + ({sql_clean('keywords')} <> '')::int, length({sql_clean('abstract')}), document_id)) as document_id from c group by g""",
)
def group_survivors(spark, d):
    c = table(spark, d, "corpus_builder").where("duplicate_group_id is not null")
    filled = sum(((T.clean_value(x) != "").cast("int") for x in ("doi_normalized", "title", "abstract", "keywords")), F.lit(0))
    rank = F.struct(F.coalesce("has_pdf", F.lit(False)).cast("int"), filled, F.length(T.clean_value("abstract")), F.col("document_id"))
    return c.groupBy(F.col("duplicate_group_id").alias("g")).agg(F.max_by("document_id", rank).alias("document_id"))


@query(
    "corpus_checks",
    f"""with c as (select distinct document_id, text_for_modeling as t, year, title, language_detected as l from corpus_builder),
    f as (select document_id, list_filter([case when {sql_clean('title')} = '' then 'missing_title' end,
      case when {sql_clean('t')} = '' then 'missing_text' when length({sql_clean('t')}) < 200 then 'short_text' end,
      case when try_cast(year as double) is null then 'bad_year' when try_cast(year as double) not between 1990 and 2030 then 'year_out_of_range' end,
      case when {sql_clean('l')} in ('', 'und') then 'unknown_language' end], lambda x: x is not null) as reasons from c)
    select document_id, array_to_string(reasons, '|') as reasons from f where len(reasons) > 0""",
)
def corpus_checks(spark, d):
    """All reasons for which a row fails, not the first alone."""
    c = table(spark, d, "corpus_builder").select("document_id", "text_for_modeling", "year", "title", "language_detected").distinct()
    t, y = T.clean_value("text_for_modeling"), F.expr("try_cast(year as double)")
    reasons = F.array_compact(
        F.array(
            F.when(T.clean_value("title") == "", "missing_title"),
            F.when(t == "", "missing_text").when(F.length(t) < 200, "short_text"),
            F.when(y.isNull(), "bad_year").when(~y.between(1990, 2030), "year_out_of_range"),
            F.when(T.clean_value("language_detected").isin("", "und"), "unknown_language"),
        )
    )
    return c.select("document_id", reasons.alias("r")).where("size(r) > 0").select("document_id", F.array_join("r", "|").alias("reasons")).distinct()


@query(
    "longest_texts",
    """select record_id, document_id from (select record_id, document_id, row_number() over (partition by record_id
      order by length(text_for_modeling) desc nulls last, document_id) as r from corpus_builder where record_id is not null) where r = 1""",
)
def longest_texts(spark, d):
    c = table(spark, d, "corpus_builder").where("record_id is not null")
    w = Window.partitionBy("record_id").orderBy(F.length("text_for_modeling").desc_nulls_last(), "document_id")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("record_id", "document_id")


@query(
    "annual_coverage",
    """with y as (select unnest(generate_series((select min(publication_year) from master_records where publication_year between 1990 and 2030),
      (select max(publication_year) from master_records where publication_year between 1990 and 2030)))::int as year)
    select year, count(r.record_id) as records, coalesce(count(r.record_id) filter (where r.is_oa), 0) as open_access
    from y left join master_records r on r.publication_year = y.year group by year""",
)
def annual_coverage(spark, d):
    r = table(spark, d, "master_records").where("publication_year between 1990 and 2030")
    span = r.agg(F.min("publication_year").alias("lo"), F.max("publication_year").alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    n = r.groupBy(F.col("publication_year").alias("year")).agg(F.count("record_id").alias("records"), F.count_if(F.coalesce("is_oa", F.lit(False)) & F.col("record_id").isNotNull()).alias("open_access"))
    zero = F.lit(0)
    return years.join(n, "year", "left").select("year", F.coalesce("records", zero).cast("bigint").alias("records"), F.coalesce("open_access", zero).cast("bigint").alias("open_access"))


@query(
    "token_frequencies",
    f"""with t as (select doc_id, lang, unnest(string_split({sql_norm('text')}, ' ')) as term from documents where text is not null)
    select term, count(*) as tf, count(distinct doc_id) as df, count(distinct lang) as langs from t where term <> '' group by term having count(distinct doc_id) >= 3""",
)
def token_frequencies(spark, d):
    """Counts of every term: first per document, so the distinct counts need no second copy of the words."""
    docs = table(spark, d, "documents").where("text is not null")
    t = docs.select("doc_id", "lang", F.explode(F.split(T.norm("text"), " ")).alias("term")).where("term <> ''")
    per = t.groupBy("term", "doc_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"), F.countDistinct("lang").alias("langs")).where("df >= 3")


@query(
    "odd_tokens",
    r"""with t as (select unnest(regexp_extract_all(lower(text), '[^\s.,;:()\[\]"«»“”!?¿¡]+')) as w from documents where text is not null),
    r as (select w, case when regexp_matches(w, '^[a-z]+[0-9]+[a-z0-9]*$') then 'mixed' when regexp_matches(w, '@') then 'at_sign' when length(w) > 25 then 'long' end as reason from t)
    select reason, w as token, count(*) as n from r where reason is not null group by 1, 2""",
)
def odd_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    t = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r'([^\s.,;:()\[\]"«»“”!?¿¡]+)'), F.lit(1))).alias("token"))
    reason = F.when(F.col("token").rlike("^[a-z]+[0-9]+[a-z0-9]*$"), "mixed").when(F.contains("token", F.lit("@")), "at_sign").when(F.length("token") > 25, "long")
    return t.withColumn("reason", reason).where("reason is not null").groupBy("reason", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filled_columns",
    "select 'title' as column, count(*) filter (where {0}) as filled, count(distinct title) filter (where {0}) as distinct_values from master_records".format(f"lower(trim(title)) not in {NULLS}")
    + "".join(f" union all select '{c}', count(*) filter (where lower(trim({c})) not in {NULLS}), count(distinct {c}) filter (where lower(trim({c})) not in {NULLS}) from master_records" for c in ("authors", "abstract", "keywords", "doi", "url")),
)
def filled_columns(spark, d):
    return quality.profile(table(spark, d, "master_records"), ["title", "authors", "abstract", "keywords", "doi", "url"])


@query(
    "label_confusion",
    """with c as (select distinct document_id, language_detected in ('es', 'pt') as said, language_metadata, language_detected from corpus_builder),
    t as (select *, case when lower(language_metadata) in ('es', 'spa', 'español', 'castellano', 'es-ar', 'pt', 'por', 'português', 'pt-br') then true
      when lower(language_metadata) in ('en', 'eng', 'english', 'en_us', 'id', 'ind', 'indonesian', 'fr', 'fra', 'français') then false end as truth from c),
    n as (select count(*) filter (where truth and said)::double tp, count(*) filter (where not truth and said)::double fp,
      count(*) filter (where truth and not said)::double fn, count(*) filter (where not truth and not said)::double tn from t where truth is not null and said is not null)
    select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
      round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as agreement,
      round(((tp + tn) / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)))
        / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))), 6) as kappa from n""",
)
def label_confusion(spark, d):
    c = table(spark, d, "corpus_builder").select("document_id", "language_metadata", "language_detected").distinct()
    m = F.lower("language_metadata")
    truth = F.when(m.isin("es", "spa", "español", "castellano", "es-ar", "pt", "por", "português", "pt-br"), True).when(
        m.isin("en", "eng", "english", "en_us", "id", "ind", "indonesian", "fr", "fra", "français"), False
    )
    got = quality.confusion(c, truth, F.col("language_detected").isin("es", "pt"))
    return got.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "agreement", "kappa")])


@query(
    "weighted_precision",
    """with s as (select source, doc_kind = 'abstract' as decided, lang = 'es' as relevant from documents where lang is not null and source is not null and doc_kind is not null),
    p as (select source, decided, count(*) as records from s group by 1, 2), r as (select source, decided, avg(relevant::int) as rate from s group by 1, 2),
    w as (select source, decided, records, rate * records as hit from p join r using (source, decided))
    select source, round(sum(case when decided then hit else 0 end) / nullif(sum(case when decided then records else 0 end), 0), 6) as precision,
      round(sum(case when decided then hit else 0 end) / nullif(sum(hit), 0), 6) as recall from w group by rollup (source)""",
)
def weighted_precision(spark, d):
    docs = table(spark, d, "documents").where("lang is not null and source is not null and doc_kind is not null")
    s = docs.select("source", F.expr("doc_kind = 'abstract' as decided"), F.expr("lang = 'es' as relevant"))
    got = quality.weighted_precision(s, s.groupBy("source", "decided").agg(F.count(F.lit(1)).alias("records")))
    return got.select("source", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("repeated_ids", "select record_id, count(*) as n from master_records group by record_id having count(*) > 1")
def repeated_ids(spark, d):
    return quality.repeated(table(spark, d, "master_records"), "record_id")


@query(
    "quality_report",
    """select 'rows' as metric, '' as grp, count(*)::double as value from documents
    union all select 'by_kind', coalesce(doc_kind, ''), count(*) from documents group by doc_kind
    union all select 'mean_chars', coalesce(lang, ''), round(avg(n_chars), 6) from documents group by lang""",
)
def quality_report(spark, d):
    docs = table(spark, d, "documents")
    one = docs.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("metric"), F.lit("").alias("grp"), "value")
    kind = docs.groupBy("doc_kind").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("by_kind").alias("metric"), F.coalesce("doc_kind", F.lit("")).alias("grp"), "value")
    mean = docs.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("value")).select(F.lit("mean_chars").alias("metric"), F.coalesce("lang", F.lit("")).alias("grp"), "value")
    return one.unionByName(kind).unionByName(mean)


_IDX = rf"""t as (select doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', ' ', 'g'), '[a-z0-9]+'))) as token
  from documents where text is not null), i as (select * from t where length(token) between 2 and 40 and regexp_matches(token, '[a-z]'))"""


@query("inverted_index", f"with {_IDX} select token, (doc_id // 100000)::int as part, list(doc_id order by doc_id) as docs from i group by 1, 2")
def inverted_index(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return retrieval.postings(retrieval.index_rows(docs, "doc_id", "text"), "doc_id")


@query("posting_intersection", f"with {_IDX} select doc_id from i where token in ('leadership', 'school', 'team') group by doc_id having count(distinct token) = 3")
def posting_intersection(spark, d):
    rows = retrieval.index_rows(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return retrieval.holding_all(rows, "doc_id", ["leadership", "school", "team"])


@query(
    "facet_search",
    """select doc_id, lang, doc_kind from documents where doc_kind = 'fulltext' and contains(lower(concat_ws(' ', text, source)), 'equipo') and contains(lower(concat_ws(' ', text, source)), 'gestión')""",
)
def facet_search(spark, d):
    found = retrieval.facet(table(spark, d, "documents"), {"doc_kind": "fulltext"}, ["equipo", "gestión"], ["text", "source"])
    return found.select("doc_id", "lang", "doc_kind")


@query(
    "ranked_search",
    f"""with n as (select record_id, ' ' || coalesce({sql_norm('title')}, '') || ' ' as t, ' ' || coalesce({sql_norm('abstract')}, '') || ' ' as a from ({_LAST})),
    s as (select record_id, 10.0 * (contains(t, ' school ')::int + contains(t, ' leadership ')::int) + 20.0 * contains(t, ' school leadership ')::int
      + 3.0 * (contains(a, ' school ')::int + contains(a, ' leadership ')::int) + 20.0 * contains(a, ' school leadership ')::int as score from n)
    select record_id, score::double as score from s where score > 0 order by score desc, record_id limit 20""",
)
def ranked_search(spark, d):
    return retrieval.ranked(_latest(spark, d), "record_id", ["school", "leadership"], {"title": 10.0, "abstract": 3.0}, 20.0, 20)


@query("best_paragraphs")
def best_paragraphs(spark, d):
    """For every document that holds the words, the paragraph that holds most of them."""
    docs = table(spark, d, "documents").where("text is not null")
    return retrieval.best_part(docs, "doc_id", "text", ["school", "leadership", "equipo", "directivo"])


@query("record_page", f"select record_id, publication_year from ({_LAST}) order by publication_year desc nulls last, record_id limit 50 offset 100")
def record_page(spark, d):
    """The third page of fifty, newest first."""
    r = _latest(spark, d).select("record_id", "publication_year")
    return r.orderBy(F.col("publication_year").desc_nulls_last(), "record_id").offset(100).limit(50)


@query(
    "stratified_sample",
    """select doc_kind, doc_id from (select doc_kind, doc_id, row_number() over (partition by doc_kind order by sha256('42:' || doc_id::varchar)) as r
      from documents where doc_kind in ('abstract', 'fulltext', 'library_note')) where r <= case doc_kind when 'abstract' then 30 when 'fulltext' then 20 else 10 end""",
)
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents"), "doc_kind", "doc_id", {"abstract": 30, "fulltext": 20, "library_note": 10}).select("doc_kind", "doc_id")


@query(
    "round_robin_sample",
    """select doc_id, lang, turn from (select doc_id, lang, row_number() over (partition by lang order by sha256('42:' || doc_id::varchar)) as turn
      from documents where lang is not null) where turn <= 40 order by turn, lang limit 40""",
)
def round_robin_sample(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    return sampling.round_robin(docs, "lang", "doc_id", 40).select("doc_id", "lang", "turn")


@query(
    "overridden_labels",
    """with d as (select 'pt-BR' as language_metadata, 'pt' as decision union all select 'castellano', 'es' union all select 'English', 'en')
    select distinct document_id, coalesce(d.decision, c.language_metadata) as language_metadata from corpus_builder c left join d using (language_metadata)""",
)
def overridden_labels(spark, d):
    decisions = spark.createDataFrame([("pt-BR", "pt"), ("castellano", "es"), ("English", "en")], "language_metadata string, decision string")
    c = table(spark, d, "corpus_builder").select("document_id", "language_metadata")
    out = c.join(broadcast_if_small(decisions), "language_metadata", "left")
    return out.select("document_id", F.coalesce("decision", "language_metadata").alias("language_metadata")).distinct()
