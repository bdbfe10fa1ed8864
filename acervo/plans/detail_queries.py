"""Queries over record-level operators, stability and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import records as R
from acervo.operators import retrieval, stability
from acervo.plans.record_queries import _IDX, _LAST, _latest
from acervo.plans.registry import query, sql_clean, sql_norm
from acervo.plans.topic_queries import _TOK, _terms, _tokens
from acervo.runtime import cut, table

FLAGS = {"has_year": r"\b(?:19|20)[0-9]{2}\b", "has_survey": r"(?i)encuestas|surveys|angket|question", "has_place": r"Villa|Puerto|Laguna|Paso"}


@query(
    "inferred_sources",
    f"""select distinct record_id, case when {sql_clean('source')} <> '' then source when url like '%repo1%' then 'repository'
      when {sql_clean('openalex_id')} <> '' then 'index' else '' end as source from master_records""",
)
def inferred_sources(spark, d):
    r = table(spark, d, "master_records")
    rules = [(F.col("url").like("%repo1%"), "repository"), (T.clean_value("openalex_id") != "", "index")]
    return r.select("record_id", R.infer(F.col("source"), rules).alias("source")).distinct()


@query(
    "pattern_flags",
    "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in FLAGS.items())
    + "], lambda x: x is not null), '|') as flags from documents where text is not null",
)
def pattern_flags(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(R.flags(F.col("text"), FLAGS), "|").alias("flags"))


@query("year_evidence", r"select doc_id, len(regexp_extract_all(text, '(?is).{0,40}(?:reforma|reform).{0,40}')) as n from documents where regexp_matches(text, '(?is)reforma|reform')")
def year_evidence(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?is)reforma|reform"))
    return docs.select("doc_id", F.size(R.evidence(F.col("text"), "reforma|reform")).cast("bigint").alias("n"))


@query(
    "filled_years",
    f"""with s as (select record_id, max(publication_year) as y from documents where record_id is not null group by 1)
    select r.record_id, coalesce(r.publication_year, s.y) as publication_year, (r.publication_year is null and s.y is not null)::int as n_changed
    from ({_LAST}) r left join s on s.record_id = r.record_id""",
)
def filled_years(spark, d):
    s = table(spark, d, "documents").where("record_id is not null").groupBy("record_id").agg(F.max("publication_year").alias("publication_year"))
    got = R.fill(_latest(spark, d).select("record_id", "publication_year"), s, "record_id", ["publication_year"])
    return got.select("record_id", "publication_year", F.size("changed").alias("n_changed"))


@query(
    "metadata_or_text",
    f"""with {_IDX}, h as (select doc_id from i where token in ('leadership', 'team') group by 1 having count(distinct token) = 2),
    m as (select doc_id, coalesce(contains(lower(source), 'andamio'), false) as m from documents)
    select m.doc_id, not m as text_only from m left join h on h.doc_id = m.doc_id where m or h.doc_id is not null""",
)
def metadata_or_text(spark, d):
    docs = table(spark, d, "documents")
    hits = retrieval.holding_all(retrieval.index_rows(docs.where("text is not null"), "doc_id", "text"), "doc_id", ["leadership", "team"])
    return R.search_either(docs.select("doc_id", "source"), F.contains(F.lower("source"), F.lit("andamio")), hits, "doc_id").select("doc_id", "text_only")


@query("core_titles", f"with n as (select record_id, {sql_norm('title')} as t from ({_LAST}) where title is not null) select record_id from n where contains(t, 'leadership') or not exists (select 1 from n where contains(t, 'leadership'))")
def core_titles(spark, d):
    n = _latest(spark, d).where("title is not null").select("record_id", T.norm("title").alias("t"))
    return R.where_or_all(n, F.contains("t", F.lit("leadership"))).select("record_id")


@query(
    "picked_sentences",
    r"""with s as (select doc_id, generate_subscripts(p, 1) as i, trim(unnest(p), ' ') as s from (
      select doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null)),
    h as (select * from s where length(s) >= 20 and regexp_matches(s, '(?i)reform|encuestas|surveys')),
    f as (select *, row_number() over (partition by doc_id, left(s, 40) order by i) as r from h),
    k as (select *, row_number() over (partition by doc_id order by i) as pos from f where r = 1)
    select doc_id, pos, left(s, 300) as sentence from k where pos <= 2""",
)
def picked_sentences(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    picked = R.pick_sentences(T.sentences("text", 20), "(?i)reform|encuestas|surveys")
    return docs.select("doc_id", F.posexplode(picked).alias("pos", "sentence")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "sentence")


@query("latest_candidates", "select candidate_id, match_source, queried_at from (select *, row_number() over (partition by candidate_id order by queried_at desc nulls last, match_source) as r from metadata_enrichment) where r = 1")
def latest_candidates(spark, d):
    c = table(spark, d, "metadata_enrichment")
    return R.latest(c, ["candidate_id"], F.col("queried_at").desc_nulls_last(), F.col("match_source")).select("candidate_id", "match_source", "queried_at")


@query(
    "similarity_with_top_up",
    """with c as (select distinct candidate_id, title_similarity from metadata_enrichment where title_similarity is not null),
    n as (select count(*) filter (where title_similarity >= 0.9995) >= 40 as enough from c),
    r as (select *, row_number() over (order by title_similarity desc, candidate_id) as r from c)
    select candidate_id, title_similarity from r, n where case when enough then title_similarity >= 0.9995 else r <= 40 end""",
)
def similarity_with_top_up(spark, d):
    c = table(spark, d, "metadata_enrichment").where("title_similarity is not null").select("candidate_id", "title_similarity").distinct()
    return R.with_top_up(c, "title_similarity", 0.9995, 40, "candidate_id")


@query(
    "topic_co_assignment",
    """with d as (select distinct record_id, doc_kind from documents where record_id is not null and doc_kind is not null),
    n as (select a.doc_kind as first, b.doc_kind as second, count(*) as n from d a join d b on a.record_id = b.record_id and a.doc_kind < b.doc_kind group by 1, 2)
    select first, second, n, round(n / max(n) over (), 6) as scaled from n""",
)
def topic_co_assignment(spark, d):
    docs = table(spark, d, "documents").where("record_id is not null and doc_kind is not null")
    return stability.co_assignment(docs, "record_id", "doc_kind").withColumn("scaled", F.round("scaled", 6))


@query(
    "term_stability",
    f"""with {_TOK}, lt as (select lang, doc_kind as topic, unnest(string_split({sql_norm('text')}, ' ')) as term from documents where text is not null and doc_kind is not null and lang is not null),
    lc as (select lang as run, topic, term, count(*) as c from lt where length(term) >= 4 group by 1, 2, 3),
    lr as (select * from (select *, row_number() over (partition by run, topic order by c desc, term) as r from lc) where r <= 10),
    nb as (select topic, count(*) as nb from terms group by 1), nr as (select run, topic as other, count(*) as nr from lr group by 1, 2),
    sh as (select run, t.topic, lr.topic as other, count(*) as c from terms t join lr using (term) group by 1, 2, 3),
    b as (select run, topic, max(c / (nb + nr - c)) as j from sh join nb using (topic) join nr using (run, other) group by 1, 2)
    select nb.topic, round(avg(coalesce(j, 0)), 6) as stability from nb cross join (select distinct run from lr) r left join b on b.run = r.run and b.topic = nb.topic group by nb.topic""",
)
def term_stability(spark, d):
    """How far the terms of a kind recur in the parts of the corpus in one language each."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").where("text is not null and doc_kind is not null and lang is not null")
    t = docs.select(F.col("lang").alias("run"), F.col("doc_kind").alias("topic"), F.explode(F.split(T.norm("text"), " ")).alias("term")).where("length(term) >= 4")
    c = t.groupBy("run", "topic", "term").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("run", "topic").orderBy(F.col("c").desc(), "term")
    runs = c.withColumn("r", F.row_number().over(w)).where("r <= 10").select("run", "topic", "term")
    return stability.term_stability(_terms(spark, d).select("topic", "term"), cut(runs)).withColumn("stability", F.round("stability", 6))


@query(
    "topic_npmi",
    f"""with {_TOK}, h as (select distinct doc_id, term from tok), z as (select count(distinct doc_id) as total from h where length(term) >= 4),
    df as (select term, count(*) as df from h where term in (select term from terms) group by 1),
    p as (select x.topic, x.term as ta, y.term as tb from terms x join terms y on x.topic = y.topic and x.term < y.term),
    co as (select a.term as ta, b.term as tb, count(*) as c from h a join h b on a.doc_id = b.doc_id and a.term < b.term
      where a.term in (select term from terms) and b.term in (select term from terms) group by 1, 2)
    select p.topic, round(avg(case when c is null then -1 else coalesce(ln(c * total / (da.df * db.df)) / nullif(-ln(c / total), 0), 1) end), 6) as npmi
    from p left join co using (ta, tb) join df da on da.term = ta join df db on db.term = tb, z group by p.topic""",
)
def topic_npmi(spark, d):
    windows = _tokens(spark, d).select(F.col("doc_id").alias("window"), "term").distinct()
    return stability.npmi(cut(_terms(spark, d)), windows).select("topic", F.round("npmi", 6).alias("npmi"))


@query("source_intervals")
def source_intervals(spark, d):
    """The share of open-access records of each journal with its bootstrap interval."""
    r = _latest(spark, d).where("origin is not null")
    return stability.bootstrap_share(r, ["origin"], "is_oa")


@query(
    "journal_scores",
    f"""with j as (select origin, count(*)::double as n, avg(is_oa::int) as oa, avg(length(abstract)) as len from ({_LAST}) where origin is not null group by 1),
    s as (select origin, (n - min(n) over ()) / nullif(max(n) over () - min(n) over (), 0) as a, (oa - min(oa) over ()) / nullif(max(oa) over () - min(oa) over (), 0) as b,
      (len - min(len) over ()) / nullif(max(len) over () - min(len) over (), 0) as c, oa, len from j)
    select origin, round((0.5 * coalesce(a, 1) + case when oa is null then 0 else 0.3 * coalesce(b, 1) end + case when len is null then 0 else 0.2 * (1 - coalesce(c, 1)) end)
      / (0.5 + case when oa is null then 0 else 0.3 end + case when len is null then 0 else 0.2 end), 6) as score from s""",
)
def journal_scores(spark, d):
    j = _latest(spark, d).where("origin is not null").groupBy("origin").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("is_oa").cast("int")).alias("oa"), F.avg(F.length("abstract")).alias("len")
    )
    return stability.multi_score(j, {"n": 0.5, "oa": 0.3, "len": -0.2}).select("origin", F.round("score", 6).alias("score"))


@query("document_ranks", "select doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents where n_chars is not null")
def document_ranks(spark, d):
    """A global rank by length."""
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return stability.ranked_by(cut(docs), "n_chars", "doc_id").select("doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("spanish_order", f"select record_id, title from ({_LAST}) where title is not null and lower(title) like 'la %' order by strip_accents(lower(title)), record_id limit 50")
def spanish_order(spark, d):
    """Titles in the order of their plain form, accents and capitals aside."""
    r = _latest(spark, d).where("title is not null and lower(title) like 'la %'").select("record_id", "title")
    return r.orderBy(T.strip_accents(F.lower("title")), "record_id").limit(50)


@query(
    "knowledge_base",
    f"""select 'record' as collection, record_id as id, left({sql_clean('abstract')}, 500) as sample from ({_LAST})
    union all select 'document', doc_id::varchar, left({sql_clean('text')}, 3000) from documents where doc_kind = 'fulltext'
    union all select 'corpus', document_id, left({sql_clean('text_for_modeling')}, 3000) from (select distinct document_id, text_for_modeling from corpus_builder)""",
)
def knowledge_base(spark, d):
    """Three tables as one list with the collection each row comes from."""
    row = lambda df, name, key, text, n: df.select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id"), F.left(T.clean_value(text), F.lit(n)).alias("sample"))
    a = row(_latest(spark, d), "record", "record_id", "abstract", 500)
    b = row(table(spark, d, "documents").where("doc_kind = 'fulltext'"), "document", "doc_id", "text", 3000)
    c = row(table(spark, d, "corpus_builder").select("document_id", "text_for_modeling").distinct(), "corpus", "document_id", "text_for_modeling", 3000)
    return a.unionByName(b).unionByName(c)
