"""Encoding of a corpus with a public byte-level BPE tokenizer, by monoid tree reduction.

``encode(x + y)`` is computed from ``encode(x)`` and ``encode(y)``. The pre-tokenizer
scans left to right without look-behind and none of its alternatives continues from a
non-blank character into white space, so a place between a non-blank character and white
space is a token boundary of *every* scan that covers it. Joining two neighbours therefore
re-encodes only a window from such a place in ``x`` to such a place in ``y``; the window
grows until it reaches one on each side, and everything outside it provably stays. Texts
are halved down to leaves, and the token lists concatenate up the tree.

Leaves are cut at the same places into units, whose ids are kept in a bounded memory.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from acervo.runtime import table

TOKENIZER_DIR = os.environ.get("ACERVO_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the published pre-tokenizer pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LEAF_CHARS = 256
UNITS_KEPT = 400_000
_UNIT = re.compile(r"\s*\S+|\s+")
#: White space to Python but not to the pre-tokenizer; texts with any go through whole.
_OTHER_BLANKS = re.compile("[\x1c-\x1f]")
_EDGE = re.compile(r"[!-~](?=[ \n])")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts with one vocabulary; the monoid's elements are (text, ids)."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        self.whole = tokenizer(path).encode_ordinary
        self.leaf_chars = leaf_chars
        self.units: dict[str, tuple[int, ...]] = {}

    def leaf(self, text: str) -> list[int]:
        """Ids of a short text, unit by unit."""
        if _OTHER_BLANKS.search(text):
            return self.whole(text)
        cut = _UNIT.findall(text)
        known = self.units
        try:
            return list(chain.from_iterable([known[u] for u in cut]))
        except KeyError:
            if len(known) > UNITS_KEPT:
                known.clear()
            for u in cut:
                if u not in known:
                    known[u] = tuple(self.whole(u))
        return list(chain.from_iterable([known[u] for u in cut]))

    def join(self, x: str, ids_x: list[int], y: str, ids_y: list[int]) -> list[int]:
        """Ids of ``x + y``; re-encodes the window around the border alone."""
        size = 64
        while True:
            left = [m.end() for m in _EDGE.finditer(x, max(0, len(x) - size))]
            right = next((m.end() for m in _EDGE.finditer(y, 0, size)), None)
            wide = size >= max(len(x), len(y))
            if (left and right is not None) or wide:
                break
            size *= 4
        b = left[-1] if left else 0
        c = right if right is not None else len(y)
        kept_x = ids_x[: len(ids_x) - len(self.leaf(x[b:]))] if b else []
        kept_y = ids_y[len(self.leaf(y[:c])) :] if c < len(y) else []
        return kept_x + self.leaf(x[b:] + y[:c]) + kept_y

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        x, y = text[:half], text[half:]
        return self.join(x, self.encode(x), y, self.encode(y))


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None
) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, without special tokens.

    A null or empty text gives an empty list and blank text its own ids; a text of any
    length is encoded whole; repeated rows give repeated rows; an empty table gives an
    empty result; all other columns are ignored. Rows are never shuffled.
    """
    path = path or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            rows = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            places = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=places[1:])
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(places[-1]))
            ids = pa.ListArray.from_arrays(pa.array(places), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))
