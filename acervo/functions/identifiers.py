"""Identifiers and identity tests: DOIs, links, signatures, authors, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import as_column, ascii_key, clean_value, title_key

#: Small words of names that tell nobody apart.
PARTICLES = ["de", "del", "da", "do", "dos", "das", "la", "las", "los", "van", "von", "et", "al"]
#: Query parameters that only track.
TRACKING = ["fbclid", "gclid"]


def doi(c: Column | str) -> Column:
    """A DOI in lower case without resolver, label or closing punctuation; '' for none."""
    text = F.lower(clean_value(c))
    text = F.regexp_replace(text, r"^https?://(?:dx\.)?[^/\s]+/(?=10\.)", "")
    text = F.regexp_replace(text, r"^doi:\s*", "")
    return F.regexp_replace(F.trim(text), r"[.,;)]+$", "")


#: Resolver and label before a DOI; per form what is taken off it: the resolver's place (at the front,
#: anywhere, or not), the label's pattern, closing signs, and whether null tokens count as none.
RESOLVER = r"https?://(?:dx\.)?doi\.org/"
DOI_FORMS = {
    "corpus": (r"^" + RESOLVER, r"^doi:\s*", ".,;)", True),
    "harvest": (r"^.*doi\.org/", "", "", False),
    "enrichment": (r"^" + RESOLVER, r"^doi:", "", False),
    "matrix": (r"^" + RESOLVER, r"^doi:\s*", ".", False),
    "files": (r"https?://doi\.org/", "", "", False),
}


def doi_in_form(c: Column | str, form: str) -> Column:
    """The DOI as one of ``DOI_FORMS`` writes it; '' for null."""
    resolver, label, tail, tokens = DOI_FORMS[form]
    text = F.lower(clean_value(c) if tokens else F.btrim(F.coalesce(as_column(c), F.lit(""))))
    text = F.regexp_replace(text, resolver, "")
    if label:
        text = F.regexp_replace(text, label, "")
    text = F.btrim(text) if tokens or form == "harvest" else text
    return F.rtrim(text, F.lit(tail)) if tail else text


def doi_found(c: Column | str) -> Column:
    """The first DOI in a text by its grammar (10., digits, slash, suffix), in lower case; '' for none."""
    return F.regexp_extract(F.lower(F.coalesce(as_column(c), F.lit(""))), r"(10\.[0-9]{4,9}/[-._;()/:a-z0-9]*[a-z0-9])", 1)


def doi_is_valid(c: Column | str) -> Column:
    return doi(c).rlike(r"^10\.\d{4,9}/\S+$")


def doi_family(c: Column | str) -> Column:
    """A DOI without a version at its end."""
    return F.regexp_replace(doi(c), r"(?:[./]v\d+)$", "")


def dois_conflict(a: Column, b: Column) -> Column:
    """Whether both are known and of different families."""
    x, y = doi_family(a), doi_family(b)
    return (x != "") & (y != "") & (x != y)


def canonical_url(c: Column | str) -> Column:
    """Host without www, decoded path without closing slash, and the telling query, sorted; '' for other schemes."""
    text = clean_value(c)
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(text, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    host = F.when(host == "dx.doi.org", F.lit("doi.org")).otherwise(host)
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.try_parse_url(text, F.lit("PATH"))), F.lit("")), r"/+$", "")
    query = F.split(F.coalesce(F.try_parse_url(text, F.lit("QUERY")), F.lit("")), "&")
    key = lambda q: F.lower(F.substring_index(q, "=", 1))
    kept = F.array_sort(
        F.filter(query, lambda q: (q != "") & ~F.startswith(key(q), F.lit("utm_")) & ~key(q).isin(*TRACKING))
    )
    port = F.regexp_extract(text, r"(?i)^https?://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    told = F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise(F.lit(""))
    joined = F.concat(host, told, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(text.rlike(r"(?i)^https?://") & (host != ""), joined).otherwise(F.lit(""))


def handle(c: Column | str) -> Column:
    """The number of a repository handle in a link; '' for none."""
    return F.regexp_extract(as_column(c), r"handle/(\S+?)/?$", 1)


def signature(title: Column | str, year: Column | str) -> Column:
    """Title key and year in one."""
    return F.concat(title_key(title), F.lit("::"), F.coalesce(as_column(year).cast("string"), F.lit("")))


def first_author(c: Column | str) -> Column:
    """The first of a delimited list of authors in its normal form."""
    return ascii_key(F.element_at(F.split(clean_value(c), r"[;|]"), 1))


def name_tokens(c: Column | str) -> Column:
    """Words of the first author that tell people apart."""
    return F.array_distinct(
        F.filter(F.split(first_author(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(*PARTICLES))
    )


def authors_compatible(a: Column | str, b: Column | str) -> Column:
    """Whether first authors can be one: two telling words each, and one set in the other or two shared."""
    x, y = name_tokens(a), name_tokens(b)
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) >= 2) & (F.size(y) >= 2) & (within | (F.size(F.array_intersect(x, y)) >= 2))


def surnames(c: Column | str) -> Column:
    """Family names of a semicolon list: before the comma, else the last word."""
    people = F.filter(F.transform(F.split(clean_value(c), ";"), F.trim), lambda p: p != "")
    return F.transform(
        people,
        lambda p: ascii_key(
            F.when(F.contains(p, F.lit(",")), F.substring_index(p, ",", 1)).otherwise(F.element_at(F.split(p, r"\s+"), -1))
        ),
    )


def stable_id(doi_: Column, record: Column, title: Column, year: Column, author: Column) -> Column:
    """doi:, else record: with a hash of the id, else hash: of title, year and first author."""
    d = doi(doi_)
    r = F.lower(clean_value(record))
    basis = F.concat_ws("|", ascii_key(title), clean_value(year), first_author(author))
    return (
        F.when(d != "", F.concat(F.lit("doi:"), d))
        .when(r != "", F.concat(F.lit("record:"), F.left(F.sha2(r, 256), F.lit(24))))
        .when(basis.rlike(r"[^|]"), F.concat(F.lit("hash:"), F.left(F.sha2(basis, 256), F.lit(24))))
    )


def doi_of_file(c: Column | str) -> Column:
    """The DOI that a file name was made of: extension off, the first underscore a slash."""
    bare = F.regexp_replace(as_column(c), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(bare, r"^([^_]*)_", "$1/")
