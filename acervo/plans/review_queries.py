"""Queries over reviews, labels, samples and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions import identifiers as I
from acervo.functions import text as T
from acervo.operators import dedup, joins, review, stability
from acervo.operators.classify import cascade
from acervo.operators.sampling import order_of
from acervo.plans.record_queries import _LAST, _latest
from acervo.plans.registry import query, sql_ascii, sql_clean
from acervo.runtime import cut, table

_MODES = {
    "all": "true",
    "candidates": "doi is not null",
    "pending": "is_oa is null",
    "without": "keywords is null and abstract is null",
    "recent": "publication_year >= 2015 and doi is null",
}


@query("review_modes", f"with r as ({_LAST}) " + " union all ".join(f"select record_id, '{m}' as mode from r where {p}" for m, p in _MODES.items()))
def review_modes(spark, d):
    """Records under every filter mode that shows them."""
    return review.modes(_latest(spark, d).select("record_id", "doi", "is_oa", "keywords", "abstract", "publication_year"), {m: F.expr(p) for m, p in _MODES.items()}).select("record_id", "mode")


@query(
    "keyword_provenance",
    f"""select record_id, case when {sql_clean('keywords')} = '' then 'missing' when source like '%|%' then 'combined'
      when source = 'ÍndiceAbierto' then 'inferred' else 'unknown' end as status from ({_LAST})""",
)
def keyword_provenance(spark, d):
    """Where the keywords of a record come from, as far as the record tells."""
    status = cascade([(T.clean_value("keywords") == "", "missing"), (F.col("source").like("%|%"), "combined"), (F.col("source") == "ÍndiceAbierto", "inferred")], "unknown")
    return _latest(spark, d).select("record_id", status.alias("status"))


_PRINT = "sum(('0x' || left(md5(document_id), 8))::bigint)::bigint"
_TOPICS = f"select language_detected as topic, lower(language_detected) as descriptor, count(*) as n, {_PRINT} as fingerprint from (select distinct document_id, language_detected from corpus_builder where language_detected is not null) group by 1"


@query(
    "label_binding",
    f"""with t as ({_TOPICS}), p as (select topic, case when n % 3 = 0 then 'other' else descriptor end as d, n, fingerprint + n % 2 as f, upper(topic) as label from t)
    select t.topic, t.n, case when f = fingerprint then 'fingerprint' when d = descriptor then 'descriptor' else 'unbound' end as bound,
      case when f = fingerprint or d = descriptor then label end as label from t join p using (topic)""",
)
def label_binding(spark, d):
    """Labels proposed for an older state of the groups by language (some changed), bound to the present groups."""
    rows = table(spark, d, "corpus_builder").where("language_detected is not null").select("document_id", F.col("language_detected").alias("topic")).distinct()
    t = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), review.set_fingerprint("document_id").alias("fingerprint")).withColumn("descriptor", F.lower("topic"))
    p = t.select("topic", F.expr("case when n % 3 = 0 then 'other' else descriptor end").alias("descriptor"), "n", F.expr("fingerprint + n % 2").alias("fingerprint"), F.upper("topic").alias("label"))
    return review.bind_labels(p, t).select("topic", "n", "bound", "label")


@query(
    "reconciled_moves",
    """with c as (select distinct duplicate_group_id as g, document_id, pdf_path_or_id as pdf from corpus_builder where duplicate_group_id is not null),
      k as (select g, min(document_id) as document_id from c group by g),
      m as (select c.g, min(c.pdf) as pdf, count(*) as n from c join k on k.g = c.g and c.document_id <> k.document_id group by c.g)
    select k.g, k.document_id, coalesce((select min(c.pdf) from c where c.g = k.g and c.document_id = k.document_id), m.pdf) as pdf, coalesce(m.n, 0) as n_moved
    from k left join m on m.g = k.g""",
)
def reconciled_moves(spark, d):
    """The kept row of every duplicate group with the file of its own or of a row moved away."""
    c = table(spark, d, "corpus_builder").where("duplicate_group_id is not null")
    c = c.select(F.col("duplicate_group_id").alias("g"), "document_id", F.col("pdf_path_or_id").alias("pdf")).distinct()
    first = c.groupBy("g").agg(F.min("document_id").alias("kept"))
    told = c.join(first, "g")
    kept = told.where("document_id = kept").groupBy("g", "document_id").agg(F.min("pdf").alias("pdf"))
    return review.reconciled(kept, told.where("document_id <> kept").select("g", "pdf"), "g", ["pdf"])


@query(
    "accounting_issues",
    """select publication_year as year, expected, counted from (select publication_year, count(*) as expected, count(lang) as counted
      from documents where publication_year is not null group by 1) where expected <> counted""",
)
def accounting_issues(spark, d):
    """Years whose documents the languages do not add up to."""
    docs = table(spark, d, "documents").where("publication_year is not null").withColumnRenamed("publication_year", "year")
    expected = docs.groupBy("year").agg(F.count(F.lit(1)).alias("expected"))
    counted = docs.where("lang is not null").groupBy("year", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.sum("n").alias("counted"))
    return review.accounting_issues(expected, counted, "year")


@query(
    "mixture_aggregates",
    """with e as (select vec_id, list_transform(embedding[1:8], lambda x: abs(x)::double) as v from embeddings),
      t as (select vec_id, unnest(generate_series(0, 7))::int as topic, unnest(v) / list_sum(v) as share from e),
      d as (select topic, count(*) as dominant from (select vec_id, arg_max(topic, (share, -topic)) as topic from t group by 1) group by 1)
    select topic, round(avg(share), 6) as mean, round(median(share), 6) as median, round(sum(share), 4) as mass, count(*) filter (where share >= 0.1) as present, coalesce(any_value(dominant), 0) as dominant
    from t left join d using (topic) group by topic""",
)
def mixture_aggregates(spark, d):
    """Aggregates of topic mixtures; the first eight components of a vector stand for the mixture."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x).cast("double")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    theta = e.select("vec_id", total.alias("total"), F.posexplode("v").alias("topic", "x")).select("vec_id", "topic", (F.col("x") / F.col("total")).alias("share"))
    got = review.mixture_aggregates(theta, "vec_id")
    return got.select("topic", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("mass", 4).alias("mass"), "present", "dominant")


@query(
    "review_priorities",
    """with s as (select journal, count(*) as n, avg(case when language_detected is null then 1.0 else 0.0 end) as a, avg(case when abstract is null then 1.0 else 0.0 end) as b,
      avg(case when coalesce(has_pdf, false) then 0.0 else 1.0 end) as c from corpus_builder where journal is not null group by journal),
      r as (select journal, n, round(100 * (0.3 * a + 0.45 * b + 0.25 * c), 3) as score, concat_ws(' | ', case when a > 0.03 then 'unlabelled' end, case when b > 0.2 then 'bare' end, case when c > 0.5 then 'unread' end) as reasons from s)
    select journal, score, reasons, row_number() over (order by score desc, journal) as priority from r""",
)
def review_priorities(spark, d):
    """Journals by how much of them wants a review, with the reasons."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = table(spark, d, "corpus_builder").where("journal is not null").groupBy("journal").agg(
        share(F.col("language_detected").isNull()).alias("a"), share(F.col("abstract").isNull()).alias("b"), share(~F.coalesce("has_pdf", F.lit(False))).alias("c")
    )
    reasons = F.array_join(review.alerts({"unlabelled": F.col("a") > 0.03, "bare": F.col("b") > 0.2, "unread": F.col("c") > 0.5}), " | ")
    r = s.select("journal", F.round(100 * (0.3 * F.col("a") + 0.45 * F.col("b") + 0.25 * F.col("c")), 3).alias("score"), reasons.alias("reasons"))
    return stability.ranked_by(cut(r), "score", "journal").select("journal", "score", "reasons", F.col("rank").cast("bigint").alias("priority"))


@query(
    "position_statuses",
    """select lang, source, n, position, case when position = 1 then 'preferred' when position <= 3 then 'competitive' else 'rejected' end as status from (
      select lang, source, count(*) as n, row_number() over (partition by lang order by count(*) desc, source) as position from documents where lang is not null and source is not null group by 1, 2)""",
)
def position_statuses(spark, d):
    """Sources of every language by their number of documents: the preferred one, competitors, the rest."""
    n = table(spark, d, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return review.positions(n, ["lang"], "n", "source")


_ORDERS = {"longest": "n_chars desc", "shortest": "n_chars", "newest": "coalesce(publication_year, 0) desc", "random": "sha256('7:' || doc_id)"}


def _orders():
    year = F.coalesce("publication_year", F.lit(0)).desc()
    return {"longest": [F.col("n_chars").desc()], "shortest": [F.col("n_chars")], "newest": [year], "random": [order_of("doc_id", 7)]}


@query(
    "review_strata",
    " union all ".join(
        f"select source, '{s}' as stratum, pick, doc_id from (select source, doc_id, row_number() over (partition by source order by {o}, doc_id) as pick from documents where source is not null and n_chars is not null) where pick <= 5"
        for s, o in _ORDERS.items()
    ),
)
def review_strata(spark, d):
    """Four samples of five documents from every source: longest, shortest, newest, random."""
    docs = table(spark, d, "documents").where("source is not null and n_chars is not null")
    return review.strata_samples(docs, ["source"], "doc_id", _orders(), 5).select("source", "stratum", "pick", "doc_id")


@query(
    "multi_label_sample",
    "with s as ("
    + " union all ".join(f"select doc_id, '{s}' as stratum from (select doc_id from documents where n_chars is not null order by {o}, doc_id limit 40)" for s, o in _ORDERS.items())
    + ") select doc_id, array_to_string(list_sort(list(distinct stratum)), '|') as strata from s group by doc_id",
)
def multi_label_sample(spark, d):
    """Documents among the first forty by any of four orders, with the orders that chose them."""
    docs = table(spark, d, "documents").where("n_chars is not null")
    return review.multi_label_sample(docs, "doc_id", _orders(), 40).select("doc_id", F.array_join("strata", "|").alias("strata"))


@query("texts_first", "select document_id, coalesce(has_pdf, false) as has_pdf, year from (select distinct document_id, has_pdf, year from corpus_builder where document_id is not null) order by coalesce(has_pdf, false) desc, document_id, year nulls first limit 50")
def texts_first(spark, d):
    """The first page of documents: those with a full text first."""
    c = table(spark, d, "corpus_builder").where("document_id is not null").select("document_id", F.coalesce("has_pdf", F.lit(False)).alias("has_pdf"), "year").distinct()
    return c.orderBy(F.col("has_pdf").desc(), "document_id", F.col("year").asc_nulls_first()).limit(50)


@query(
    "short_citations",
    f"""with a as (select record_id, publication_year, list_filter(list_transform(string_split({sql_clean('authors')}, ';'), lambda x: trim(string_split(x, ',')[1], ' ')), lambda x: x <> '') as f from ({_LAST}))
    select record_id, (case when len(f) = 0 then 'Sin autor' when len(f) > 2 then f[1] || ' et al.' else array_to_string(f, ' & ') end)
      || ', ' || coalesce(publication_year::varchar, 's. f.') as citation from a""",
)
def short_citations(spark, d):
    """Family names (of lists split at semicolons) and year."""
    parts = F.transform(F.split(T.clean_value("authors"), ";"), lambda x: F.btrim(F.split(x, ",")[0]))
    f = F.filter(parts, lambda x: x != "")
    names = F.when(F.size(f) == 0, "Sin autor").when(F.size(f) > 2, F.concat(F.try_element_at(f, F.lit(1)), F.lit(" et al."))).otherwise(F.array_join(f, " & "))
    return _latest(spark, d).select("record_id", F.concat(names, F.lit(", "), F.coalesce(F.col("publication_year").cast("string"), F.lit("s. f."))).alias("citation"))


_T, _K, _A = (sql_clean(c) for c in ("title", "keywords", "abstract"))


@query(
    "weighted_texts",
    f"""select record_id, md5(concat_ws(' ', nullif({_T}, ''), nullif({_T}, ''), nullif({_K}, ''), nullif({_A}, ''))) as text_md5,
      case when {_A} <> '' or {_K} <> '' then 'title_keywords_abstract' when {_T} <> '' then 'title_only' else 'missing' end as strategy,
      coalesce(nullif(concat_ws('+', case when {_T} <> '' then 'title' end, case when {_A} <> '' then 'abstract' end, case when {_K} <> '' then 'keywords' end), ''), 'missing') as fields
    from ({_LAST})""",
)
def weighted_texts(spark, d):
    """Metadata text with the title counted twice, and what it is made of."""
    t, k, a = (T.clean_value(c) for c in ("title", "keywords", "abstract"))
    known = lambda c: F.when(c != "", c)
    text = F.concat_ws(" ", known(t), known(t), known(k), known(a))
    strategy = cascade([((a != "") | (k != ""), "title_keywords_abstract"), (t != "", "title_only")], "missing")
    held = F.array_join(review.alerts({"title": t != "", "abstract": a != "", "keywords": k != ""}), "+")
    return _latest(spark, d).select("record_id", F.md5(text).alias("text_md5"), strategy.alias("strategy"), F.coalesce(F.nullif(held, F.lit("")), F.lit("missing")).alias("fields"))


@query("normal_topic_ids", r"select regexp_replace(regexp_replace(trim(label::double::varchar), '\.0$', ''), '^$', 'none') as topic, count(*) as n from embeddings where label is not null group by 1")
def normal_topic_ids(spark, d):
    """Topic ids read as numbers, written as whole ones."""
    bare = F.regexp_replace(F.trim(F.col("label").cast("double").cast("string")), r"\.0$", "")
    return table(spark, d, "embeddings").where("label is not null").groupBy(F.regexp_replace(bare, "^$", "none").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("without_places", r"select doc_id, md5(trim(regexp_replace(regexp_replace(text, '(?i)(villa|puerto|laguna|paso) [a-z]+', ' ', 'g'), ' +', ' ', 'g'), ' ')) as text_md5 from documents where text is not null")
def without_places(spark, d):
    """Texts without names of places, for a vectoriser."""
    gone = F.regexp_replace("text", r"(?i)(villa|puerto|laguna|paso) [a-z]+", " ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.btrim(F.regexp_replace(gone, " +", " "), F.lit(" "))).alias("text_md5"))


@query(
    "assignment_states",
    f"""with a as (select record_id, max(coalesce(lang, '-1')) as topic, count(*) as degree from documents where record_id is not null group by 1)
    select r.record_id, case when topic = '-1' then 'outlier' when topic is not null then 'assigned' else 'not_modeled' end as state, coalesce(degree, 0) as degree
    from ({_LAST}) r left join a on a.record_id = r.record_id""",
)
def assignment_states(spark, d):
    """Whether a record's documents are assigned a group, are outliers of it, or were never modelled; and how many there are."""
    a = table(spark, d, "documents").where("record_id is not null").groupBy("record_id").agg(F.max(F.coalesce("lang", F.lit("-1"))).alias("topic"), F.count(F.lit(1)).alias("degree"))
    state = cascade([(F.coalesce(F.col("topic") == "-1", F.lit(False)), "outlier"), (F.col("topic").isNotNull(), "assigned")], "not_modeled")
    return _latest(spark, d).select("record_id").join(a, "record_id", "left").select("record_id", state.alias("state"), F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


#: Words that tell no title apart.
STOP = ("school", "escuela", "escolar", "education", "educación", "educacion", "para", "with", "from", "sobre", "entre", "desde", "como", "pour", "dans", "yang", "dengan")


@query(
    "telling_tokens",
    f"""select record_id, array_to_string(list_filter(string_split({sql_ascii('title')}, ' '), lambda x: length(x) >= 4 and not regexp_full_match(x, '[0-9]+') and x not in {STOP})[1:8], ' ') as tokens from ({_LAST})""",
)
def telling_tokens(spark, d):
    """The first eight title words that tell a title apart."""
    told = F.filter(F.split(T.ascii_key("title"), " "), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$") & ~x.isin(*STOP))
    return _latest(spark, d).select("record_id", F.array_join(F.slice(told, 1, 8), " ").alias("tokens"))


_TABLES = ("master_records", "corpus_builder", "metadata_enrichment", "extraction_log", "keyword_thesaurus", "documents", "eval_items")


@query("table_counts", " union all ".join(f"select '{t}' as name, count(*) as n, count(*) = 0 as blank from {t}" for t in _TABLES))
def table_counts(spark, d):
    """How many rows every table has, and whether it is blank."""
    one = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n", (F.col("n") == 0).alias("blank")) for t in _TABLES]
    return reduce(DataFrame.unionByName, one)


@query(
    "journal_alerts",
    """with s as (select journal, count(*) as n, avg(case when abstract is null then 1.0 else 0.0 end) as b, max(text_characters) as longest, count(distinct language_detected) as langs
      from corpus_builder where journal is not null group by journal)
    select journal, concat_ws('|', case when n < 5 then 'small' end, case when b > 0.25 then 'bare' end, case when longest > 5000 then 'long_texts' end, case when langs > 4 then 'many_languages' end) as alerts from s""",
)
def journal_alerts(spark, d):
    """All alerts that a journal gives."""
    s = table(spark, d, "corpus_builder").where("journal is not null").groupBy("journal").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("abstract").isNull(), 1.0).otherwise(0.0)).alias("b"), F.max("text_characters").alias("longest"), F.countDistinct("language_detected").alias("langs")
    )
    found = review.alerts({"small": F.col("n") < 5, "bare": F.col("b") > 0.25, "long_texts": F.col("longest") > 5000, "many_languages": F.col("langs") > 4})
    return s.select("journal", F.array_join(found, "|").alias("alerts"))


@query(
    "concentration_classes",
    """select source, share, case when share >= 0.9 then 'single' when share >= 0.5 then 'dominant' else 'mixed' end as concentration from (
      select source, round(max(n) / sum(n), 6) as share from (select source, lang, count(*) as n from documents where source is not null and lang is not null group by 1, 2) group by source)""",
)
def concentration_classes(spark, d):
    """How far one language rules a source."""
    n = table(spark, d, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("source").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))
    return s.select("source", "share", cascade([(F.col("share") >= 0.9, "single"), (F.col("share") >= 0.5, "dominant")], "mixed").alias("concentration"))


@query(
    "best_with_margin",
    """select found_year, round(best, 6) as best, round(best - coalesce(second, 0), 6) as margin,
      case when best < 0.84 then 'none' when best - coalesce(second, 0) < 0.07 then 'ambiguous' else 'matched' end as status
    from (select found_year, max(title_similarity) as best, max(case when r = 2 then title_similarity end) as second from (
      select found_year, title_similarity, row_number() over (partition by found_year order by title_similarity desc) as r from metadata_enrichment where title_similarity is not null and found_year is not null)
      where r <= 2 group by found_year)""",
)
def best_with_margin(spark, d):
    """Of the candidates of every year, the one most similar, and whether it stands out."""
    got = review.best_with_margin(table(spark, d, "metadata_enrichment").where("found_year is not null"), "found_year", "title_similarity")
    return got.select("found_year", F.round("best", 6).alias("best"), F.round("margin", 6).alias("margin"), "status")


_RANKS = {"ok": 3, "vacio": 2}


@query("superseded_runs", "select filename, arg_max(status, (case status when 'ok' then 3 when 'vacio' then 2 else 0 end, status)) as status, count(*) - 1 as hidden from extraction_log where filename is not null and status is not null group by filename")
def superseded_runs(spark, d):
    """The extraction of each file that stands, and how many others it hides."""
    return review.superseded(table(spark, d, "extraction_log").where("filename is not null and status is not null"), "filename", _RANKS, "status")


@query(
    "cache_states",
    """with l as (select filename, max(status) as status from extraction_log group by 1), a as (select distinct pdf_path_or_id as filename from corpus_builder where pdf_path_or_id is not null)
    select a.filename, case when l.filename is null then 'missing' when regexp_matches(coalesce(status, ''), '^error') then 'retry' else 'done' end as state from a left join l on l.filename = a.filename""",
)
def cache_states(spark, d):
    """Files whose extraction is done, has failed (to be retried), or was never tried."""
    asked = table(spark, d, "corpus_builder").where("pdf_path_or_id is not null").select(F.col("pdf_path_or_id").alias("filename"))
    return review.cache_states(table(spark, d, "extraction_log"), asked, "filename", "status", "^error")


@query(
    "titles_in_texts",
    f"""with n as (select distinct {sql_ascii('title')} as n from ({_LAST})), t as (select doc_id, {sql_ascii('text')} as t from documents where text is not null)
    select distinct doc_id from t, n where length(n) > 25 and contains(t, n)""",
)
def titles_in_texts(spark, d):
    """Documents whose text holds the title of a record."""
    needles = _latest(spark, d).select(T.ascii_key("title").alias("n")).distinct()
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return joins.contained(docs, T.ascii_key("text"), needles, "n", 25).select("doc_id").distinct()


@query("item_links")
def item_links(spark, d):
    """Records whose link names an item or, with its authors, a page; home pages identify nothing."""
    k = dedup.with_keys(_latest(spark, d)).where("k_url is not null")
    return k.select("record_id", I.canonical_url("url").rlike(dedup.ITEM).alias("by_item"))


def _sql_form(form: str) -> str:
    resolver, label, tail, tokens = I.DOI_FORMS[form]
    x = f"lower({sql_clean('doi') if tokens else "trim(coalesce(doi, ''), ' ')"})"
    x = f"regexp_replace({x}, '{resolver}', '', 'g')"
    x = f"regexp_replace({x}, '{label}', '')" if label else x
    x = f"trim({x}, ' ')" if tokens or form == "harvest" else x
    return f"rtrim({x}, '{tail}')" if tail else x


@query("doi_forms", f"select record_id, {', '.join(f'{_sql_form(f)} as {f}' for f in I.DOI_FORMS)} from ({_LAST})")
def doi_forms(spark, d):
    """The DOI of every record in each of the forms that its users write."""
    return _latest(spark, d).select("record_id", *[I.doi_in_form("doi", f).alias(f) for f in I.DOI_FORMS])


@query("dois_in_links", rf"select record_id, regexp_extract(lower(coalesce(url, '')), '(10\.[0-9]{{4,9}}/[-._;()/:a-z0-9]*[a-z0-9])', 1) as doi from ({_LAST})")
def dois_in_links(spark, d):
    """The DOI that a record's link holds."""
    return _latest(spark, d).select("record_id", I.doi_found("url").alias("doi"))
