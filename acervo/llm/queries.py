"""Named queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acervo.llm.encode_corpus import p8_ids
from acervo.llm.entity_match import p4_found, p4_matches
from acervo.llm.eval_leaks import p9_found
from acervo.llm.languages import p6_found, p6_languages
from acervo.llm.name_variants import p1_clusters, p1_found
from acervo.llm.near_records import p7_found, p7_groups
from acervo.llm.scan_noise import p3_found, p3_repaired
from acervo.llm.shared_spans import p10_coverage, p10_found
from acervo.llm.survivors import p2_found

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_coverage": p10_coverage,
}

_WORDS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"
_RUNS = "distinct {0}, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k + 11], ' '))) as run"
_DOI = r"regexp_replace(lower(trim(doi_normalized)), '^(?:doi:?\s*|https?://[^/\s]+/)+', '')"
_TEXT = r"regexp_replace(trim(abstract), '\s*(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\])$', '')"

ORACLES: dict[str, str] = {
    "p2_found": rf"""with c as (select distinct duplicate_group_id as g, document_id, updated_at as upd, {_DOI} as doi,
        case when lower(trim(abstract)) not in ('', 'nan', 'none', 'null', 'na', 'n/a') then {_TEXT} end as t from corpus_builder where duplicate_group_id is not null),
      h as (select *, case when left(t, length(t) // 2) || left(t, length(t) // 2) = t then left(t, length(t) // 2) else t end as core from c),
      k as (select *, left(regexp_replace(lower(core), '[^\p{{L}}\p{{N}}]+', '', 'g'), 60) as head from h),
      n as (select head, count(distinct g) as groups from k group by head),
      a as (select g, arg_max(document_id, (length(core), upd, document_id)) as document_id from k join n using (head)
        where length(core) >= 40 and groups <= 2 group by g),
      d as (select g, arg_max(doi, (upd, doi)) as doi from k where regexp_matches(doi, '^10\.\d{{4,9}}/[-._;()/:a-z0-9]*[a-z0-9]$') group by g)
      select g as duplicate_group_id, coalesce(d.doi, '') as doi_normalized, coalesce(a.document_id, '') as document_id
      from (select distinct g from c) left join d using (g) left join a using (g)""",
    "p9_found": f"""with i as (select item_id, {_WORDS} as w from eval_items), d as (select doc_id, {_WORDS} as w from documents where text is not null),
      x as (select {_RUNS.format('item_id')} from i where len(w) >= 12), y as (select {_RUNS.format('doc_id')} from d where len(w) >= 12)
      select distinct doc_id, item_id from x join y using (run)""",
}
