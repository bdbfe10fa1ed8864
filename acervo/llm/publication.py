"""What a publication is recognised by: its title's words, its people, its year and DOI."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

from acervo.functions.names import (
    NICKNAMES,
    PARTICLES,
    is_organisation,
    looks_given,
    plain,
)
from acervo.operators.packed_values import parse
from acervo.runtime import NULL_TOKENS

#: Words that stand before a title or beside it without belonging to it.
FRONT_WORDS = frozenset("sobre on about sur acerca tentang mengenai".split())
LABELS = frozenset(
    "articulo articulos article articles artigo artigos artikel tesis thesis tese these version versao linea line "
    "ligne linha online daring versi preprint pdf revista reimpresion ponencia comunicacion comunicacao communication "
    "paper makalah resumen abstract".split()
)
PART_WORDS = frozenset("parte part partie bagian volumen volume tomo entrega".split())
ROMAN = re.compile(r"(?:x{0,3})(?:ix|iv|v?i{0,3})$")
_TAG = re.compile(r"<[^>]{1,20}>")
_BRACKET = re.compile(r"[(\[（]([^()\[\]（）]*)[)\]）]")
_WORD = re.compile(r"[a-z0-9]+")
_DOI = re.compile(r"(10\.\d{4,9}/[-._;()/:a-z0-9]*[a-z0-9])$")
_PREFIX = re.compile(r"^(?:doi:?\s*|https?://[^/]+/)+")
_GARBLED = re.compile("[ÂÃâ][\x80-\xbf‐-‿Œ-ƒ€™ -¿]")


#: What is left of garbled vowels once their accents were dropped as well.
_STRIPPED = ((re.compile("(?<=[a-z])A(?:3|³)(?=[a-z])"), "o"), (re.compile("(?<=[a-z])A[oº](?=[a-z])"), "u"),
             (re.compile("(?<=[a-z])A¡"), "a"), (re.compile("(?<=[a-z])A©"), "e"), (re.compile("(?<=[a-z])A\xad"), "i"),
             (re.compile("(?<=[a-z])A±"), "n"))


def unmoji(text: str) -> str:
    """Undo UTF-8 read as a one-byte code, as far as it goes."""
    for pattern, letter in _STRIPPED:
        text = pattern.sub(letter, text)
    if not _GARBLED.search(text):
        return text
    for code in ("cp1252", "latin-1"):
        try:
            return text.encode(code).decode("utf-8")
        except UnicodeError:
            continue

    def one(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m[0].encode(code).decode("utf-8")
            except UnicodeError:
                continue
        return m[0]

    return _GARBLED.sub(one, text)


def doi_key(doi: str | None) -> str | None:
    """A well-formed DOI without prefix in lower case, or None."""
    if doi is None:
        return None
    m = _DOI.match(_PREFIX.sub("", doi.strip().lower()).strip())
    return m[1] if m else None


class Person(NamedTuple):
    family: tuple[str, ...]
    given: str
    group: bool


@lru_cache(maxsize=30_000)
def person(name: str) -> Person:
    """Family words without particles, the first given name in its full form (or an initial)."""
    if is_organisation(name):
        core = tuple(w for w in _WORD.findall(plain(name)) if w not in PARTICLES)
        return Person(core, "", True)
    if "," in name:
        family, given = name.split(",", 1)
    else:
        words = name.split()
        k = 0
        while k < len(words) - 1 and looks_given(words[k]):
            k += 1
        k = max(k, 1)
        given, family = " ".join(words[:k]), " ".join(words[k:])
    family_words = tuple(w for w in _WORD.findall(plain(family)) if w not in PARTICLES)
    given_words = _WORD.findall(plain(given))
    first = given_words[0] if given_words else ""
    return Person(family_words, NICKNAMES.get(first, (first,))[0], False)


@lru_cache(maxsize=60_000)
def near(a: str, b: str) -> bool:
    """Words that differ by no more slips than their length excuses."""
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 0 if short < 4 or a.isdigit() or b.isdigit() else 1 if short < 9 else 2
    return most > 0 and abs(len(a) - len(b)) <= most and slips(a, b, most) <= most


def slips(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (neighbour swaps count one), or ``most + 1`` beyond it."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


class Title(NamedTuple):
    words: tuple[str, ...]
    pieces: tuple[tuple[str, ...], ...]
    qualifiers: tuple[str, ...]
    part: str


@lru_cache(maxsize=10_000)
def title(text: str | None) -> Title | None:
    """Words of a title, its pieces between colons, what its brackets say, its instalment."""
    if text is None or text.strip().lower() in NULL_TOKENS:
        return None
    clean = plain(_TAG.sub("", unmoji(text)).replace("…", " "))
    part, qualifiers = "", []

    def bracket(m: re.Match) -> str:
        nonlocal part
        inner = _WORD.findall(m[1])
        if not inner or any(w in LABELS for w in inner):
            return " "
        if len(inner) <= 2 and ROMAN.fullmatch(inner[-1]) and inner[-1]:
            part = inner[-1]
            return " "
        qualifiers.append(" ".join(inner))
        return " "

    clean = _BRACKET.sub(bracket, clean)
    clean = re.sub(r"\s/\s*(\w+)\W*$", lambda m: " " if m[1] in LABELS else m[0], clean)
    cut_up = re.split(r"\s*(?::|\.(?=\s)|\s[-—–]\s|—|–)\s*", clean)
    pieces: list[list[str]] = []
    for piece in cut_up:
        words = _WORD.findall(piece)
        while words and words[0] in FRONT_WORDS:
            del words[0]
        for k in range(len(words) - 1):
            if words[k] in PART_WORDS and (ROMAN.fullmatch(words[k + 1]) or words[k + 1].isdigit()):
                part = words[k + 1]
                del words[k : k + 2]
                break
        if len(words) == 1 and ROMAN.fullmatch(words[0]) and pieces:
            part = words[0]
        elif words:
            pieces.append(words)
    return Title(tuple(w for p in pieces for w in p), tuple(map(tuple, pieces)), tuple(sorted(qualifiers)), part)


@lru_cache(maxsize=10_000)
def people(text: str | None) -> tuple[Person, ...]:
    return tuple(dict.fromkeys(person(v.text) for v in parse(text, True)))


def same_person(a: Person, b: Person) -> bool:
    if a.group != b.group or not a.family or not b.family:
        return False
    if a.group:
        hits = sum(any(near(x, y) or x[:4] == y[:4] for y in b.family) for x in a.family)
        return hits >= 0.7 * min(len(a.family), len(b.family))
    if a.given and b.given and a.given[0] != b.given[0]:
        return False
    return near(a.family[0], b.family[0]) or len(a.family) > 1 and near("".join(a.family), "".join(b.family))


def people_shared(a: tuple[Person, ...], b: tuple[Person, ...]) -> float | None:
    """Share of the shorter list found in the longer one; None where a list is missing."""
    if not a or not b:
        return None
    if len(a) > len(b):
        a, b = b, a
    left = list(b)
    hits = 0
    for p in a:
        for k, q in enumerate(left):
            if same_person(p, q):
                hits += 1
                del left[k]
                break
    return hits / len(a)


def words_left(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Words of each title without a counterpart in the other, slips excused."""
    rest_b = list(b)
    rest_a = []
    for w in a:
        if w in rest_b:
            rest_b.remove(w)
        else:
            rest_a.append(w)
    still_a = []
    for w in rest_a:
        hit = next((x for x in rest_b if near(w, x)), None)
        if hit is None:
            still_a.append(w)
        else:
            rest_b.remove(hit)
    return still_a, rest_b


def jaccard(a: Title, b: Title) -> float:
    """Exact Jaccard similarity of the titles' words, slips excused."""
    left, right = words_left(a.words, b.words)
    shared = len(a.words) - len(left)
    return shared / max(shared + len(left) + len(right), 1)


def titles_agree(a: Title, b: Title) -> bool:
    """Whether two titles name one work: no word replaced, nothing missing but a subtitle."""
    if not a.words or not b.words or a.part != b.part:
        return False
    if len(a.qualifiers) != len(b.qualifiers) or any(
        not (x == y or near(x, y)) for x, y in zip(a.qualifiers, b.qualifiers)
    ):
        return False
    left, right = words_left(a.words, b.words)
    left = [w for w in left if w not in LABELS and w not in FRONT_WORDS]
    right = [w for w in right if w not in LABELS and w not in FRONT_WORDS]
    if not left and not right:
        return True
    if left and right:
        # a word cut in two or two run together; one word with one slip more
        x, y = "".join(left), "".join(right)
        return x == y or len(left) == len(right) == 1 and min(len(x), len(y)) >= 5 and slips(x, y, 2) <= 2
    longer, missing = (a, left) if left else (b, right)
    telling = [w for w in missing if len(w) > 2]
    if not telling:
        return len(missing) == 1
    if len(longer.pieces) < 2:
        return False
    for piece in longer.pieces:
        over, short = words_left(tuple(missing), piece)
        if not [w for w in over if len(w) > 2] and len(short) <= 1:
            return True
    return False


#: Words that a title needs to tell a work where no person does.
TELLING_WORDS = 5
YEARS_APART = 3


class Record(NamedTuple):
    title: Title | None
    people: tuple[Person, ...]
    year: int | None
    doi: str | None


def record(title_text: str | None, people_text: str | None, year: int | None, doi: str | None = None) -> Record:
    return Record(title(title_text), people(people_text), None if year is None else int(year), doi_key(doi))


def same_publication(a: Record, b: Record) -> bool:
    """Whether two records describe one publication.

    Titles must agree and at least half the people of the shorter list be shared. Without
    people on either side the title must tell enough words; without a title on either side
    the DOIs must be equal. Years, where both are known, lie no further apart than
    ``YEARS_APART``; unequal DOIs separate records that nothing but a title holds together.
    """
    if a.year is not None and b.year is not None and abs(a.year - b.year) > YEARS_APART:
        return False
    one_doi = a.doi is not None and a.doi == b.doi
    shared = people_shared(a.people, b.people)
    if a.title is None or b.title is None:
        return one_doi and (shared is None or shared >= 0.5)
    if not titles_agree(a.title, b.title):
        return False
    if shared is None:
        if a.doi is not None and b.doi is not None and not one_doi:
            return False
        return one_doi or min(len(a.title.words), len(b.title.words)) >= TELLING_WORDS
    return shared >= 0.5


def pack(r: Record) -> str:
    """One text that holds all a record is compared by; records of equal text are compared alike."""
    t = r.title
    told = None if t is None else [t.pieces, t.qualifiers, t.part]
    return json.dumps([told, sorted(r.people), r.year, r.doi], ensure_ascii=False, separators=(",", ":"))


@lru_cache(maxsize=10_000)
def unpack(text: str) -> Record:
    told, persons, year, doi_ = json.loads(text)
    if told is not None:
        pieces = tuple(map(tuple, told[0]))
        told = Title(tuple(w for p in pieces for w in p), pieces, tuple(told[1]), told[2])
    return Record(told, tuple(Person(tuple(f), g, o) for f, g, o in persons), year, doi_)


def tokens(r: Record) -> list[str]:
    """Distinct tokens of a record: title words, family names, the DOI."""
    out = [f"t {w}" for w in dict.fromkeys(r.title.words)] if r.title else []
    out += [f"a {n}" for n in dict.fromkeys(p.family[0] for p in r.people if p.family)]
    if r.doi:
        out.append(f"d {r.doi}")
    return out


#: Bits of a gate that stand for initials of people, a group, and nobody that another can be; its lowest bits are free.
EVERYBODY = (1 << 29) - 1
GATE_FREE = 20


def gate(r: Record) -> int:
    """A number that keeps apart what ``same_publication`` would: year, instalment and brackets, initials.

    From the top: 10 bits for the year (0: unknown; far years count as the nearest told), 4 for
    instalment and number of brackets (0: no title), and those of ``EVERYBODY``.
    """
    year = 0 if r.year is None else min(max(r.year, 1500), 2500) - 1499
    kind = 0 if r.title is None else 1 + zlib.crc32(f"{r.title.part} {len(r.title.qualifiers)}".encode()) % 15
    who = 0 if r.people else EVERYBODY
    for p in r.people:
        if p.family:
            letter = ord(p.given[0]) - ord("a") if p.given else 0
            who |= 1 << 27 if p.group else (1 << (letter if 0 <= letter < 26 else 26)) if p.given else (1 << 27) - 1
    value = year << 54 | kind << 50 | (who or 1 << 28) << GATE_FREE
    return value - (1 << 64) if value >> 63 else value
