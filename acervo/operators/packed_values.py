"""Several values packed in one field: one row per value with its position.

A parsing expression grammar with ordered alternatives reads the whole field::

    field      <- bracketed / listing
    bracketed  <- '[' quoted (sep quoted)* ']'
    listing    <- piece (hard piece)*      if a hard separator stands outside quotes
                / names                    for lists of people without one
                / piece (',' piece)*       otherwise, for terms
    piece      <- quoted / bare
    quoted     <- '"' ('""' / '\\' any / !'"' any)* '"' &(blank* (sep / end))
    names      <- person (' and ' person)+  where each person is "Family, Given"
                / name (', ' name)* conj name
                / name (', ' name)+
                / name

A quoted alternative that does not close, or closes before anything but a separator,
fails; the parser backtracks and reads the quote as an ordinary character, and the
value carries an error flag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.names import looks_given, organisation_span
from acervo.runtime import NULL_TOKENS


class Value(NamedTuple):
    text: str
    quoted: bool
    flag: str | None


#: Separators that always end a value outside quotes, longest first.
HARD = ("//", " / ", ";", "；", "|", "\n", "\r", "\t", "·", "•")
CONJUNCTION = re.compile(r"\s+(?:and|y|e|et|&)\s+")
_SPACES = re.compile(r"\s+")


def _quoted(text: str, at: int, ends: tuple[str, ...]) -> tuple[str, int] | None:
    """quoted: the value and the place after it, or None where the alternative fails."""
    out, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in '"\\/':
            out.append(text[i + 1])
            i += 2
        elif c == '"' and text[i + 1 : i + 2] == '"':
            out.append('"')
            i += 2
        elif c == '"':
            j = i + 1
            while j < n and text[j] in "  ":
                j += 1
            if j >= n or any(text.startswith(e, j) for e in ends):
                return "".join(out), j
            return None
        else:
            out.append(c)
            i += 1
    return None


def _pieces(text: str, seps: tuple[str, ...]) -> list[Value]:
    """piece (sep piece)*, quotes honoured; empty pieces are left out."""
    out: list[Value] = []
    i, n, start, flag = 0, len(text), 0, None
    fresh = True
    while i <= n:
        sep = next((s for s in seps if text.startswith(s, i)), None) if i < n else ""
        if sep is not None:
            if fresh is not None:
                out.append(Value(text[start:i].strip(), False, flag))
            i += len(sep) if sep else 1
            start, flag, fresh = i, None, True
            continue
        if fresh and text[i] == '"':
            got = _quoted(text, i, seps)
            if got is not None:
                out.append(Value(got[0].strip(), True, None))
                i, fresh = got[1], None
                if i >= n:
                    break
                continue
            flag = "malformed_quote"
        if fresh and not text[i].isspace():
            fresh = False
        i += 1
    return [v for v in out if v.text]


def _outside_quotes(text: str, seps: tuple[str, ...]) -> bool:
    """Whether a separator of ``seps`` stands outside well-formed quoted values."""
    if '"' not in text:
        return any(s in text for s in seps)
    i, n, fresh = 0, len(text), True
    ends = (*seps, ",")
    while i < n:
        if fresh and text[i] == '"' and (got := _quoted(text, i, ends)) is not None:
            i, fresh = got[1], False
            continue
        if any(text.startswith(s, i) for s in seps):
            return True
        fresh = text[i] == "," or fresh and text[i].isspace()
        i += 1
    return False


def _people(text: str) -> list[Value]:
    """names: a list of people without a hard separator."""
    kept: list[str] = []

    def hide(m: str) -> str:
        kept.append(m)
        return f"\x00{len(kept) - 1}\x00"

    masked, at = "", 0
    for start, end in organisation_span(text):
        masked += text[at:start] + hide(text[start:end])
        at = end
    masked += text[at:]
    show = lambda s: re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], s)

    def values(parts: list[str]) -> list[Value]:
        return [Value(x, False, None) for p in parts if (x := show(p).strip())]

    joined = CONJUNCTION.split(masked)
    if len(joined) > 1:
        if len(joined) > 2 or "," in joined[-1]:
            return values(joined)
        left = [p for p in joined[0].split(",") if p.strip()]
        if len(left) == 2 and looks_given(left[1]) and not looks_given(left[0].split()[0]):
            return values(joined)
        return values([*left, joined[1]])
    parts = [p for p in masked.split(",") if p.strip()]
    if len(parts) > 2:
        return values(parts)
    if len(parts) == 2 and not looks_given(parts[1]):
        first = parts[0].split()
        if "\x00" in masked or len(parts[1].split()) > 1 and looks_given(first[0]) and len(first) > 1:
            return values(parts)
    return values([masked])


def parse(text: str | None, people: bool) -> list[Value]:
    """The values of one field, in order, without empty pieces."""
    if text is None or text.strip().lower() in NULL_TOKENS:
        return []
    body = text.strip()
    if body.startswith("[") and body.endswith("]") and '"' in body:
        inside = _pieces(body[1:-1], (";", ","))
        if inside and all(v.quoted for v in inside):
            return inside
    if _outside_quotes(body, HARD):
        return _pieces(body, HARD)
    if '"' in body:
        listed = _pieces(body, (",",))
        if not people or any(v.quoted for v in listed):
            return listed
    return _people(body) if people else _pieces(body, (",",))


def split_packed(
    df: DataFrame, key: str, fields: dict[str, bool], *, with_flags: bool = False
) -> DataFrame:
    """One row per value of each packed field of ``df``.

    ``fields`` maps a column to whether it lists people (in which "Family, Given" is one
    value). Returns ``key, field_name, pos, item_value`` and, on request, ``error_flag``.
    Null, blank and null-token fields give no row; an empty table gives an empty result;
    repeated input rows give repeated output rows; other columns, whatever their names,
    are neither read nor returned; a field of any length is parsed whole.
    """
    kind = "array<struct<pos:int,item_value:string,error_flag:string>>"

    def parser(people: bool):
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(
                    [
                        [
                            {"pos": i, "item_value": v.text, "error_flag": v.flag}
                            for i, v in enumerate(parse(x, people), 1)
                        ]
                        for x in s
                    ],
                    index=s.index,
                    dtype=object,
                )

        return run

    packed = [
        F.struct(F.lit(name).alias("field_name"), parser(people)(F.col(name)).alias("list"))
        for name, people in fields.items()
    ]
    rows = (
        df.select(F.col(key).alias("key"), F.explode(F.array(*packed)).alias("f"))
        .select("key", "f.field_name", F.explode("f.list").alias("v"))
        .select(F.col("key").alias(key), "field_name", "v.pos", "v.item_value", "v.error_flag")
    )
    return rows if with_flags else rows.drop("error_flag")
