"""Functions that no Catalyst expression can give: Unicode tables, parsers, last matches.

Each is a pandas UDF over Arrow batches, made when called so that modules import without
a session.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.names import PARTICLES

#: Signs written in one way.
_SIGNS = str.maketrans(
    {**dict.fromkeys("   ", " "), **dict.fromkeys("‘’‚‛", "'"),
     **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("‐‑‒–—−", "-")}
)
#: Headings under which a text lists its sources.
_SOURCES = re.compile(
    r"(?im)^[ \t]*(?:referencias|bibliograf[ií]a|references|bibliography|refer[eê]ncias|daftar[ \t]+pustaka)[ \t]*[:.]?[ \t]*$"
)
#: Headings of the sections of an article, by section.
_SECTIONS = {
    "introduction": "introducci[oó]n|introduction|introdu[cç][aã]o|pendahuluan",
    "methods": "metodolog[ií]a|m[eé]todos?|methods?|methodology|metode|m[eé]thodes?",
    "results": "resultados?|results|findings|hallazgos|hasil|r[eé]sultats",
    "discussion": "discusi[oó]n|discussion|discuss[aã]o|pembahasan",
    "conclusion": "conclusi[oó]n(?:es)?|conclusions?|conclus[aãoõ]+(?:es)?|kesimpulan",
}
_HEADING = re.compile(r"(?im)^[ \t]*(?:\d+[.)]?[ \t]+)?(" + "|".join(f"(?P<{k}>{v})" for k, v in _SECTIONS.items()) + r")[ \t]*[:.]?[ \t]*$")


def unicode_form(text: str | None) -> str | None:
    """Entities decoded, composed form, plain quotes and dashes, no control signs, blanks squeezed."""
    if text is None:
        return None
    t = unicodedata.normalize("NFC", html.unescape(text)).translate(_SIGNS)
    t = "".join(c for c in t.replace("\r", "\n") if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf", "Cs"))
    t = re.sub(r"[ \t]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", t)).strip()


def without_sources(text: str | None, least: float = 0.35) -> str | None:
    """A text up to the last heading of its list of sources, if that stands late enough."""
    if text is None:
        return None
    late = [m.start() for m in _SOURCES.finditer(text) if m.start() >= least * len(text)]
    return text[: late[-1]].rstrip() if late else text


def sections(text: str | None) -> dict[str, str]:
    """The sections of an article by name; what stands before the first heading is 'front'."""
    if not text:
        return {}
    out: dict[str, str] = {}
    name, start = "front", 0
    for m in [*_HEADING.finditer(text), None]:
        part = text[start : m.start() if m else len(text)].strip()
        if part:
            out[name] = f"{out[name]}\n{part}" if name in out else part
        if m:
            name = next(k for k in _SECTIONS if m.group(k))
            start = m.end()
    return out


def invert_name(name: str) -> str:
    """A name as 'Family, G. G.'; particles stay with the family name."""
    if "," in name:
        family, given = (p.strip() for p in name.split(",", 1))
    else:
        words = name.split()
        if len(words) < 2:
            return name.strip()
        k = len(words) - 1
        while k > 1 and words[k - 1].lower() in PARTICLES:
            k -= 1
        given, family = " ".join(words[:k]), " ".join(words[k:])
    initials = " ".join("-".join(f"{p[0].upper()}." for p in w.split("-") if p) for w in given.replace(".", ". ").split())
    return f"{family}, {initials}".rstrip(", ")


def cite_people(text: str | None, ampersand: str = "&") -> str:
    """An author list for a citation: one, up to twenty, or nineteen and the last of more."""
    people = [invert_name(p.strip()) for p in re.split(r"[;|]", text or "") if p.strip()]
    if len(people) > 20:
        return ", ".join(people[:19]) + ", … " + people[-1]
    if len(people) > 1:
        return ", ".join(people[:-1]) + f", {ampersand} " + people[-1]
    return people[0] if people else ""


def sentence_case(text: str) -> str:
    """A title in sentence case: words in capitals throughout are lowered, others keep theirs."""
    words = text.split(" ")
    if sum(w.isupper() for w in words if w.isalpha()) > 0.6 * max(1, sum(w.isalpha() for w in words)):
        text = text.lower()
    return text[:1].upper() + text[1:]


def citation(authors: str | None, year: int | None, title: str | None, journal: str | None, doi: str | None) -> str:
    """A reference; what is missing is left out, a missing year is 's. f.'."""
    parts = [f"{p}" for p in (cite_people(authors),) if p]
    parts.append(f"({int(year)})." if year is not None and year == year else "(s. f.).")
    if title:
        parts.append(sentence_case(title.strip()).rstrip(".") + ".")
    if journal:
        parts.append(f"{journal.strip()}.")
    if doi:
        parts.append(f"https://doi.org/{doi}")
    return " ".join(parts)


def parse_reference(raw: str | None) -> dict[str, str | None]:
    """Authors, year, title, link and DOI of a Markdown reference."""
    text = (raw or "").strip().lstrip("-*0123456789. ")
    year = re.search(r"\((\d{4})[a-z]?\)", text)
    link = re.search(r"\]\((https?://[^)\s]+)\)", text) or re.search(r"(https?://\S+)", text)
    found = re.search(r"10\.\d{4,9}/[^\s)\]]+", text)
    before, after = (text[: year.start()], text[year.end() :]) if year else ("", text)
    title = re.match(r"\*{1,2}([^*]+)\*{1,2}|\[([^\]]+)\]|([^.]+)", after.lstrip(" .,)"))
    return {
        "authors": before.strip(" .,*") or None,
        "year": year[1] if year else None,
        "title": next((g.strip() for g in title.groups() if g), None) if title else None,
        "url": link[1] if link else None,
        "doi": found[0].rstrip(".") if found else None,
    }


def _mapped(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in s], index=s.index, dtype=object)

    return run


def unicode_text(c: Column) -> Column:
    return _mapped(unicode_form, "string")(c)


def cut_sources(c: Column) -> Column:
    return _mapped(without_sources, "string")(c)


def section_map(c: Column) -> Column:
    return _mapped(lambda t: list(sections(t).items()), "array<struct<name:string,text:string>>")(c)


def references(c: Column) -> Column:
    return _mapped(parse_reference, "struct<authors:string,year:string,title:string,url:string,doi:string>")(c)


def citations(authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, y: pd.Series, t: pd.Series, j: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([citation(*row) for row in zip(a, y, t, j, d)], dtype=object)

    return run(authors, year, title, journal, doi)
