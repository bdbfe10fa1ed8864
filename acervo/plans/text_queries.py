"""Queries over text and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import identifiers as I
from acervo.functions import text as T
from acervo.plans.registry import (
    query,
    sql_ascii,
    sql_clean,
    sql_doi,
    sql_first_author,
    sql_norm,
    sql_squeeze,
)
from acervo.runtime import table

LEAD = ["school leadership", "senior team", "equipo directivo", "liderazgo compartido"]
LEFT = ["equipo", "team", "equipe", "conselho", "consejo"]
RIGHT = ["escuela", "escola", "school", "schools", "escuelas"]
SQL_BARE_TITLE = (
    "regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), "
    r"'(?i)\s*\((investigaciones|art[íi]culos|articles|research)\)\s*$', '')"
)


def _array(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("norm_text", f"select doc_id, {sql_norm('text')} as norm_text from documents where text is not null")
def norm_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.norm("text").alias("norm_text"))


@query(
    "text_forms",
    f"""select record_id, min(ascii_form) as ascii_form, min(label_form) as label_form, min(accent_form) as accent_form
    from (select record_id, {sql_ascii('title')} as ascii_form,
      {sql_squeeze("lower(translate(title, '–—', '--'))")} as label_form,
      regexp_replace({sql_squeeze('lower(title)')}, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g') as accent_form
      from master_records where title is not null) group by record_id""",
)
def text_forms(spark, d):
    r = table(spark, d, "master_records").where("title is not null")
    return (
        r.select("record_id", T.ascii_key("title").alias("a"), T.label_key("title").alias("l"), T.keep_accents("title").alias("k"))
        .groupBy("record_id")
        .agg(F.min("a").alias("ascii_form"), F.min("l").alias("label_form"), F.min("k").alias("accent_form"))
    )


@query(
    "title_keys",
    rf"""select distinct record_id, substring(replace({sql_ascii(
        SQL_BARE_TITLE
    )}, ' ', ''), 1, 90) as title_key from master_records where title is not null""",
)
def title_keys(spark, d):
    r = table(spark, d, "master_records").where("title is not null")
    return r.select("record_id", T.title_key("title").alias("title_key")).distinct()


@query(
    "scrubbed_text",
    r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      text, '(?i)https?://\S+|www\.\S+', ' ', 'g'), '(?i)\b(?:doi:\s*)?10\.\d{4,9}/\S+', ' ', 'g'),
      '(?i)\b(?:e-?)?issn:?\s*\d{4}-?\d{3}[0-9x]', ' ', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', ' ', 'g'),
      '(?i)\bhdl:\S+|\bhandle/\S+', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' ') as scrubbed
    from documents where text is not null""",
)
def scrubbed_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.scrub("text").alias("scrubbed"))


@query(
    "artifact_counts",
    r"""select doc_id, len(regexp_extract_all(text, '(?i)https?://\S+|www\.\S+')) as n_url,
      len(regexp_extract_all(text, '(?i)\b(?:doi:\s*)?10\.\d{4,9}/\S+')) as n_doi,
      len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) as n_email
    from documents where text is not null""",
)
def artifact_counts(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    counted = docs.select("doc_id", T.artifact_counts("text").alias("m"))
    pick = lambda k: F.col("m")[k].cast("bigint")
    return counted.select("doc_id", pick("url").alias("n_url"), pick("doi").alias("n_doi"), pick("email").alias("n_email"))


@query(
    "phrase_hits",
    f"""with n as (select doc_id, ' ' || {sql_norm('text')} || ' ' as t from documents where text is not null)
    select doc_id, array_to_string(list_filter({_array(LEAD)}, lambda p: contains(t, ' ' || p || ' ')), '|') as hits
    from n where len(list_filter({_array(LEAD)}, lambda p: contains(t, ' ' || p || ' '))) > 0""",
)
def phrase_hits(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.norm("text").alias("t"))
    return (
        docs.select("doc_id", T.phrase_hits(F.col("t"), LEAD).alias("h"))
        .where("size(h) > 0")
        .select("doc_id", F.array_join("h", "|").alias("hits"))
    )


@query(
    "near_hits",
    f"""with w as (select doc_id, unnest(string_split({sql_norm('text')}, ' ')) as word,
        generate_subscripts(string_split({sql_norm('text')}, ' '), 1) as pos from documents where text is not null)
    select distinct a.doc_id from w a join w b on a.doc_id = b.doc_id and abs(a.pos - b.pos) <= 6
    where a.word in ({', '.join(repr(x) for x in LEFT)}) and b.word in ({', '.join(repr(x) for x in RIGHT)})""",
)
def near_hits(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.norm("text").alias("t"))
    return docs.where(T.near_hit(F.col("t"), LEFT, RIGHT, 6)).select("doc_id").distinct()


@query(
    "marker_language",
    f"""with t as (select doc_id, list_distinct(string_split({sql_norm('text')}, ' ')) as w from documents where text is not null),
    s as (select doc_id, {', '.join(f"len(list_filter(w, lambda x: list_contains({_array(v)}, x))) as n_{k}" for k, v in T.MARKERS.items())} from t)
    select doc_id, case when greatest(n_es, n_en, n_pt, n_fr, n_id) = 0 then ''
      when n_es = greatest(n_es, n_en, n_pt, n_fr, n_id) then 'es' when n_en = greatest(n_es, n_en, n_pt, n_fr, n_id) then 'en'
      when n_pt = greatest(n_es, n_en, n_pt, n_fr, n_id) then 'pt' when n_fr = greatest(n_es, n_en, n_pt, n_fr, n_id) then 'fr'
      else 'id' end as lang_code from s""",
)
def marker_language(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.norm("text").alias("t"))
    return docs.select("doc_id", T.marker_language(F.col("t")).alias("lang_code"))


@query(
    "sentence_counts",
    r"""with s as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))) as s
      from documents where text is not null)
    select doc_id, count(*) as n_sentences, max(length(trim(s))) as longest from s
    where length(trim(s)) between 20 and 400 group by doc_id""",
)
def sentence_counts(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return (
        docs.select("doc_id", F.explode(T.sentences("text", 20, 400)).alias("s"))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).cast("bigint").alias("longest"))
    )


@query(
    "record_dois",
    rf"""with r as (select distinct record_id, {sql_doi('doi')} as doi_key from master_records)
    select record_id, doi_key, regexp_replace(doi_key, '(?:[./]v\d+)$', '') as doi_family,
      regexp_matches(doi_key, '^10\.\d{{4,9}}/\S+$') as valid from r""",
)
def record_dois(spark, d):
    r = table(spark, d, "master_records").select("record_id", "doi").distinct()
    return r.select(
        "record_id", I.doi("doi").alias("doi_key"), I.doi_family("doi").alias("doi_family"), I.doi_is_valid("doi").alias("valid")
    ).distinct()


@query(
    "canonical_urls",
    rf"""with r as (select distinct record_id, {sql_clean('url')} as u from master_records)
    select record_id, case when regexp_matches(u, '(?i)^https?://[^/]+') then
      regexp_replace(lower(regexp_extract(u, '(?i)^https?://(?:www\.)?([^/?#:]+)', 1)), '^www\.', '')
      || regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', '') else '' end as url_key from r""",
)
def canonical_urls(spark, d):
    r = table(spark, d, "master_records").select("record_id", "url").distinct()
    return r.select("record_id", I.canonical_url("url").alias("url_key")).distinct()


@query(
    "shared_urls",
    rf"""with r as (select distinct record_id, case when regexp_matches({sql_clean('url')}, '(?i)^https?://[^/]+') then
      regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '')
      || regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', '') else '' end as url_key from master_records)
    select url_key, count(*) as n_records, min(record_id) as first_record from r where url_key <> ''
    group by url_key having count(*) > 1""",
)
def shared_urls(spark, d):
    r = canonical_urls(spark, d).where("url_key <> ''")
    return (
        r.groupBy("url_key")
        .agg(F.count(F.lit(1)).alias("n_records"), F.min("record_id").alias("first_record"))
        .where("n_records > 1")
    )


@query(
    "signatures",
    rf"""select distinct record_id, substring(replace({sql_ascii(
        SQL_BARE_TITLE
    )}, ' ', ''), 1, 90) || '::' || coalesce(publication_year::varchar, '') as signature,
      {sql_first_author('authors')} as first_author from master_records where title is not null""",
)
def signatures(spark, d):
    r = table(spark, d, "master_records").where("title is not null")
    return r.select(
        "record_id", I.signature("title", "publication_year").alias("signature"), I.first_author("authors").alias("first_author")
    ).distinct()


@query(
    "stable_ids",
    rf"""select distinct record_id, case when {sql_doi('doi')} <> '' then 'doi:' || {sql_doi('doi')}
      when lower({sql_clean('record_id')}) <> '' then 'record:' || left(sha256(lower({sql_clean('record_id')})), 24)
      else 'hash:' || left(sha256(concat_ws('|', {sql_ascii('title')}, {sql_clean('publication_year::varchar')}, {sql_first_author('authors')})), 24)
      end as stable_id from master_records""",
)
def stable_ids(spark, d):
    r = table(spark, d, "master_records")
    c = F.col
    return r.select(
        "record_id", I.stable_id(c("doi"), c("record_id"), c("title"), c("publication_year"), c("authors")).alias("stable_id")
    ).distinct()


@query(
    "file_names",
    r"""select distinct record_id, coalesce(nullif(substring(regexp_replace(regexp_replace(strip_accents(title),
      '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), ''), 'unnamed') as file_name
    from master_records where title is not null""",
)
def file_names(spark, d):
    r = table(spark, d, "master_records").where("title is not null")
    return r.select("record_id", T.file_part("title").alias("file_name")).distinct()


@query(
    "merged_sources",
    """with p as (select record_id, trim(unnest(string_split(coalesce(source, '') || '|' || coalesce(search_term, ''), '|'))) as v
      from (select distinct record_id, source, search_term from master_records))
    select record_id, count(distinct lower(v)) as n_values from p where v <> '' group by record_id""",
)
def merged_sources(spark, d):
    r = table(spark, d, "master_records").select("record_id", "source", "search_term").distinct()
    merged = r.select("record_id", T.merge_lists(F.col("source"), F.col("search_term")).alias("m")).where("m <> ''")
    return (
        merged.select("record_id", F.explode(F.split("m", r"\|")).alias("v"))
        .groupBy("record_id")
        .agg(F.countDistinct(F.lower("v")).alias("n_values"))
    )


@query(
    "file_dois",
    r"""select distinct filename, regexp_replace(regexp_replace(filename, '\.[A-Za-z0-9]+$', ''), '^([^_]*)_', '\1/') as doi_guess
    from extraction_log""",
)
def file_dois(spark, d):
    log = table(spark, d, "extraction_log")
    return log.select("filename", I.doi_of_file("filename").alias("doi_guess")).distinct()


@query(
    "document_fingerprint",
    """select sum(('0x' || left(sha256(doc_id::varchar || ':' || sha256(coalesce(text, ''))), 13))::bigint)::varchar as fingerprint,
      count(*) as n from documents""",
)
def document_fingerprint(spark, d):
    """One number for all texts under their ids: hashes added up, so no task gathers them."""
    docs = table(spark, d, "documents")
    mark = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    number = F.conv(F.left(mark, F.lit(13)), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.sum(number).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))
