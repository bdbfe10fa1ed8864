"""Text functions, Column to Column: nulls, accents, normal forms, cleaning, tokens.

All are Catalyst expressions; the few that need Unicode tables or the position of a last
match are Arrow functions in ``acervo.functions.arrow``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.runtime import NULL_TOKENS


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and those letters: built by rule."""
    pairs = []
    for code in range(0xC0, 0x3100):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def clean_value(c: Column | str) -> Column:
    """The trimmed text, or '' where it is missing or a null token."""
    text = F.trim(F.coalesce(as_column(c).cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*NULL_TOKENS), F.lit("")).otherwise(text)


def strip_accents(c: Column | str) -> Column:
    """Without accents, composed or combining."""
    return F.regexp_replace(F.translate(as_column(c), *_accent_map()), r"\p{Mn}", "")


def squeeze(c: Column | str) -> Column:
    """Blanks in runs become one; none at the ends."""
    return F.trim(F.regexp_replace(as_column(c), r"[ \t\n\r\f]+", " "))


def norm(c: Column | str) -> Column:
    """Lower case without accents; what is neither letter, digit nor underscore becomes one blank."""
    low = F.replace(F.lower(as_column(c)), F.lit("ß"), F.lit("ss"))
    return squeeze(F.regexp_replace(strip_accents(low), r"[^\p{L}\p{N}_ \t\n\r\f]", " "))


def keep_accents(c: Column | str) -> Column:
    """Lower case, blanks squeezed, punctuation dropped afterwards; accents stay."""
    return F.regexp_replace(squeeze(F.lower(as_column(c))), r"[^\p{L}\p{N}_ ]", "")


def ascii_key(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, anything else between them one blank."""
    low = F.lower(F.regexp_replace(strip_accents(clean_value(c)), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def label_key(c: Column | str) -> Column:
    """Labels compared: lower case, one kind of dash, blanks squeezed."""
    return squeeze(F.lower(F.translate(as_column(c), "–—", "--")))


def title_key(c: Column | str, chars: int = 90) -> Column:
    """A title without markup, bracketed section label or blanks, cut to ``chars``."""
    bare = F.regexp_replace(as_column(c), r"<[^>]+>", "")
    bare = F.regexp_replace(bare, r"(?i)\s*\((?:investigaciones|art[íi]culos|articles|research)\)\s*$", "")
    return F.substring(F.replace(ascii_key(bare), F.lit(" "), F.lit("")), 1, chars)


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Phrases that stand in a normalised text as whole words, in the order given."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))))


def substring_hits(text: Column, terms: list[str]) -> Column:
    """Terms found anywhere in a text, word borders aside."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def drop_phrases(text: Column, phrases: list[str]) -> Column:
    """The text with whole-word phrases taken out; of two that touch, the first goes."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for p in phrases:
        out = F.replace(out, F.lit(f" {p} "), F.lit(" "))
    return F.trim(out)


def word_places(text: Column, words: list[str]) -> Column:
    """Places (from 0) at which one of ``words`` stands in a text of single blanks."""
    tokens = F.split(text, " ")
    listed = F.array(*map(F.lit, words))
    at = F.transform(tokens, lambda t, i: F.when(F.array_contains(listed, t), i))
    return F.filter(at, lambda i: i.isNotNull())


def near_hit(text: Column, left: list[str], right: list[str], window: int) -> Column:
    """Whether a word of ``left`` stands within ``window`` words of one of ``right``."""
    a, b = word_places(text, left), word_places(text, right)
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= window))


def search_tokens(c: Column | str) -> Column:
    """Distinct tokens of 2 to 40 letters or digits with a letter among them, in order."""
    low = F.regexp_replace(F.lower(strip_accents(as_column(c))), r"[^\x00-\x7F]", " ")
    found = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t).between(2, 40) & t.rlike("[a-z]")))


def sentences(c: Column | str, least: int = 0, most: int = 1 << 30) -> Column:
    """Sentences split after . ! or ?, of ``least`` to ``most`` characters."""
    cut = F.split(as_column(c), r"(?<=[.!?])[ \t\n\r\f]+")
    return F.filter(F.transform(cut, F.trim), lambda s: F.length(s).between(max(least, 1), most))


#: What scrubbing removes, in this order.
SCRUB_PATTERNS = {
    "url": r"(?i)https?://\S+|www\.\S+",
    "doi": r"(?i)\b(?:doi:\s*)?10\.\d{4,9}/\S+",
    "issn": r"(?i)\b(?:e-?)?issn:?\s*\d{4}-?\d{3}[0-9x]",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "identifier": r"(?i)\bhdl:\S+|\bhandle/\S+",
}


def scrub(c: Column | str) -> Column:
    """The text without links, identifiers and addresses, blanks squeezed."""
    out = as_column(c)
    for pattern in SCRUB_PATTERNS.values():
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def artifact_counts(c: Column | str) -> Column:
    """How often each scrubbing pattern occurs, as a map."""
    text = as_column(c)
    return F.create_map(
        *[x for name, p in SCRUB_PATTERNS.items() for x in (F.lit(name), F.regexp_count(text, F.lit(p)))]
    )


def without_header(abstract: Column, title: Column, least: int = 25) -> Column:
    """An abstract without a first line that repeats the title."""
    lines = F.split(abstract, "\n")
    first = ascii_key(F.element_at(lines, 1))
    known = F.left(ascii_key(title), F.lit(least))
    repeats = (F.size(lines) > 1) & (F.length(known) >= least) & F.startswith(first, known)
    return F.when(repeats, F.trim(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))).otherwise(abstract)


def merge_lists(*columns: Column, sep: str = "|") -> Column:
    """Delimited lists joined, each value once (compared by its normal form, first form kept)."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), rf"\{sep}") for c in columns]))
    parts = F.filter(F.transform(parts, F.trim), lambda p: p != "")
    return F.array_join(
        F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda kept, p: F.when(
                F.exists(kept, lambda k: F.lower(k) == F.lower(p)), kept
            ).otherwise(F.array_append(kept, p)),
        ),
        sep,
    )


def file_part(c: Column | str, chars: int = 60) -> Column:
    """A text as part of a file name."""
    safe = F.regexp_replace(strip_accents(as_column(c)), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(safe, r"^_+|_+$", ""), 1, chars), F.lit("")), F.lit("unnamed"))


def thousands(c: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(c, 0), ",", ".")


def first_year(c: Column | str) -> Column:
    """The first year 1900-2099 in a text."""
    found = F.regexp_extract(as_column(c), r"(?:^|\D)((?:19|20)\d{2})(?=\D|$)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def iso_date(c: Column | str) -> Column:
    """The date at the start of a text, NULL where there is none."""
    return F.try_to_timestamp(F.left(as_column(c), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")


def pages(first: Column, last: Column) -> Column:
    """A page range: one page where both agree, what is known where one is missing."""
    a, b = clean_value(first), clean_value(last)
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit("-"), b)).otherwise(F.coalesce(F.nullif(a, F.lit("")), b))


def from_inverted(c: Column) -> Column:
    """Text from a map of word to places."""
    spread = F.flatten(
        F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    return F.array_join(F.transform(F.array_sort(spread), lambda s: s["w"]), " ")


def highlight(c: Column | str, word: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """A word marked wherever it stands, accents aside (single letters vary)."""
    source, target = _accent_map()
    variants: dict[str, str] = {}
    for a, b in zip(source, target):
        if b.isascii():
            variants[b.lower()] = variants.get(b.lower(), "") + a
    pattern = "".join(f"[{x}{variants.get(x, '')}]" if x.isalnum() else rf"\{x}" for x in word.lower())
    return F.regexp_replace(as_column(c), f"(?iu)({pattern})", f"{before}$1{after}")


#: Words that mark a language.
MARKERS = {
    "es": ["el", "la", "los", "las", "del", "una", "con", "para", "que", "por"],
    "en": ["the", "of", "and", "in", "with", "for", "that", "from"],
    "pt": ["o", "os", "da", "do", "das", "dos", "uma", "com", "para", "em"],
    "fr": ["le", "les", "des", "du", "une", "dans", "avec", "pour"],
    "id": ["di", "yang", "dan", "dengan", "pada", "untuk", "dari", "dalam"],
}


def marker_language(text: Column) -> Column:
    """The language whose marker words a normalised text holds most of; '' without any."""
    tokens = F.split(text, " ")
    scores = [
        F.struct(F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))).alias("n"), (-F.lit(k)).alias("k"), F.lit(code).alias("c"))
        for k, (code, words) in enumerate(MARKERS.items())
    ]
    best = F.greatest(*scores)
    return F.when(best["n"] > 0, best["c"]).otherwise(F.lit(""))
