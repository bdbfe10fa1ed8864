"""Page furniture in text from scanned pages: running headers, page numbers, cut words."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

from acervo.functions.names import ORGANISATION_HEADS, looks_given, plain

#: Signs that end a line inside a word.
CUT_SIGNS = "-‐‑¬\xad"
_NUMBER = r"(?:[0-9OolI]{1,4}|[ivxlc]{1,8})"
_PAGE = re.compile(
    rf"(?:[\[(]\s*{_NUMBER}\s*[\])]|[-–—]\s*{_NUMBER}\s*[-–—]|(?:p[áa]gina|p[áa]g\.?|page|halaman|hal\.|p\.)\s*{_NUMBER}|{_NUMBER})",
    re.IGNORECASE,
)
_ROMAN = re.compile(r"c?(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_VOLUME = re.compile(r"\bvol\.?\s*\S{1,5}\W+\s*(?:n[úu]m|n[ºo°]|no|issue)", re.IGNORECASE)
_NOT_LETTER = re.compile(r"[^a-z]+")
_GLYPHS = str.maketrans({"0": "o", "1": "i", "5": "s", "@": "a", "8": "b", "6": "b", "9": "g"})


class Line(NamedTuple):
    text: str
    kind: str  # 'body', 'header', 'page_number' or 'blank'


def _is_page_number(s: str) -> bool:
    if not _PAGE.fullmatch(s):
        return False
    inner = re.sub(r"[^0-9A-Za-z]", "", re.sub(r"(?i)p[áa]gina|p[áa]g|page|halaman|hal|^p\.", "", s))
    if not inner:
        return False
    if any(c.isdigit() for c in inner):
        return True
    return inner.islower() and _ROMAN.fullmatch(inner) is not None


@lru_cache(maxsize=10_000)
def _key(text: str) -> str:
    """Letters of a line, misread signs excused, page and volume numbers left out."""
    s = re.sub(r"^\s*\d+\s{2,}|\s{2,}[\dOol]+\s*$", "", text)
    s = re.sub(r"(?i)\bvol\.?\s*\d+.*$", "", s)
    return _NOT_LETTER.sub("", plain(s).translate(_GLYPHS))


def _headerish(s: str) -> bool:
    return bool(s) and not s.endswith((".", ",", ";", ":", *CUT_SIGNS)) and (s[0].isupper() or s[0].isdigit() or "," in s)


def _caps(s: str) -> bool:
    letters = [c for c in s if c.isalpha()]
    return len(letters) >= 8 and sum(c.isupper() for c in letters) >= 0.9 * len(letters)


def _person_line(s: str) -> bool:
    family, comma, given = s.partition(",")
    return bool(comma) and 1 <= len(family.split()) <= 5 and "," not in given and looks_given(given)


def _group_line(s: str) -> bool:
    words = s.split()
    return 2 < len(words) <= 9 and s[0].isupper() and words[0].lower() in ORGANISATION_HEADS and s[-1].isalpha()


def layout(text: str, title: str | None = None, journal: str | None = None) -> list[Line]:
    """The lines of a text with what they are.

    A line is a header when it names the journal, a volume, or the title in capitals, or
    stands in capitals; or when it repeats or opens a page and reads like one.
    """
    raw = [l.strip() for l in re.split(r"\r\n|\r|\n", text)]
    journal_key = _key(journal) if journal else ""
    title_key = _key(title) if title else ""
    counts = Counter(_key(s) for s in raw if s and len(s) <= 120)
    out: list[Line] = []
    top = True
    for s in raw:
        if not s:
            out.append(Line(s, "blank"))
            continue
        if _is_page_number(s):
            out.append(Line(s, "page_number"))
            top = True
            continue
        key = _key(s)
        header = False
        if len(s) <= 120 and key:
            if _VOLUME.search(s) and s[0].isupper() and len(key) >= 5:
                header = True
            elif _caps(s):
                header = True
            elif _headerish(s):
                named = journal_key and key == journal_key
                titled = title_key and len(key) >= 15 and title_key.startswith(key) and top and counts[key] > 1
                again = counts[key] > 1 and (len(s.split()) > 1) and (_person_line(s) or s == s.title() or top)
                header = bool(named or titled or again or _person_line(s) or _group_line(s))
        out.append(Line(s, "header" if header else "body"))
        top = False
    return out


def join_lines(lines: list[Line], whole) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Paragraphs of the running text, and the cut words as (left, right, whole).

    ``whole(left, right)`` says how the two parts of a cut word are written together.
    Furniture inside a paragraph, with the blank lines around it, does not end it, nor does a
    blank line before a small letter where no sentence has ended.
    """
    paragraphs: list[str] = []
    cuts: list[tuple[str, str, str]] = []
    now, blank, furniture = "", False, False
    for line in lines:
        if line.kind == "blank":
            blank = True
            continue
        if line.kind != "body":
            furniture = True
            continue
        s = line.text
        if now and now[-1] in CUT_SIGNS and len(now) > 1 and now[-2].isalpha() and s[:1].isalpha() and (not blank or furniture or s[0].islower()):
            m = re.search(r"[^\s]*$", now[:-1])
            left = m[0]
            right = re.match(r"[^\s]*", s)[0]
            word = whole(left, right)
            cuts.append((left, right, word))
            now = now[: len(now) - 1 - len(left)] + word + s[len(right) :]
        elif now and (not blank or now[-1] not in ".!?" and (furniture or s[0].islower())):
            now = f"{now} {s}"
        else:
            if now:
                paragraphs.append(now)
            now = s
        blank = furniture = False
    if now:
        paragraphs.append(now)
    return paragraphs, cuts
