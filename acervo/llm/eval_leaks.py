"""Evaluation passages inside training text: BM25 over test items with block-max WAND.

The test items are indexed: postings ordered by item, cut into blocks that keep the
largest BM25 contribution in them. The training text is queried passage by passage; a
passage is a longest run of words known to the index, since an unknown word scores
nothing and no leaked run can span it. Every item has a score that any passage holding
``run`` consecutive words of it must reach: the smallest sum of contributions over its
own windows. WAND skips whatever can't reach the smallest such score, so all items above
threshold are retrieved, and their consecutive words are then compared exactly.

Items come in blocks of bounded size, and one pass over the corpus serves a block; the
block's index is what is broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.runtime import table

RUN = 12
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 16
#: Characters of item text that one index, and so one broadcast, may hold.
INDEX_CHARS = 16_000_000
UNITS_KEPT = 400_000
_UNIT = re.compile(r"\S+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKD, without combining marks, in lower case."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    return _WORD.findall(text.lower())


class Index:
    """Block-max BM25 postings of test items."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        self.run = run
        kept = [(i, w) for i, t in items if t and len(w := words(t)) >= run]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        n = len(kept)
        mean = sum(map(len, self.words)) / n if n else 1.0
        df = Counter(t for w in self.words for t in set(w))
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.least: list[float] = []
        for d, w in enumerate(self.words):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            score = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm)
                for t, f in tf.items()
            }
            for t, s in score.items():
                self.postings[self.terms[t]].append((d, s))
            self.least.append(
                min(sum(score[t] for t in set(w[i : i + run])) for i in range(len(w) - run + 1)) - 1e-9
            )
        self.lowest = min(self.least, default=math.inf)
        self.top = [max(s for _, s in p) for p in self.postings]
        self.blocks = [
            [(p[i : i + POSTINGS_BLOCK][-1][0], max(s for _, s in p[i : i + POSTINGS_BLOCK]))
             for i in range(0, len(p), POSTINGS_BLOCK)]
            for p in self.postings
        ]
        self.grams: list[set[tuple[int, ...]]] = [
            {tuple(self.terms[t] for t in w[i : i + run]) for i in range(len(w) - run + 1)} for w in self.words
        ]

    def retrieve(self, passage: list[int]) -> list[int]:
        """Every item whose score for the passage reaches its own threshold."""
        terms = sorted(set(passage))
        at = {t: 0 for t in terms}
        found = []
        post, blocks, top = self.postings, self.blocks, self.top
        live = [t for t in terms if post[t]]
        while live:
            live.sort(key=lambda t: post[t][at[t]][0])
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += top[t]
                if bound >= self.lowest:
                    pivot = k
                    break
            if pivot is None:
                break
            d = post[live[pivot]][at[live[pivot]]][0]
            upto = [t for t in live if post[t][at[t]][0] <= d]
            local, skip = 0.0, math.inf
            for t in upto:
                b = at[t] // POSTINGS_BLOCK
                while b < len(blocks[t]) and blocks[t][b][0] < d:
                    b += 1
                if b < len(blocks[t]):
                    local += blocks[t][b][1]
                    skip = min(skip, blocks[t][b][0] + 1)
            ahead = min((post[t][at[t]][0] for t in live if post[t][at[t]][0] > d), default=math.inf)
            if local >= self.lowest:
                score = 0.0
                for t in upto:
                    p, i = post[t], at[t]
                    while i < len(p) and p[i][0] < d:
                        i += 1
                    if i < len(p) and p[i][0] == d:
                        score += p[i][1]
                if score >= self.least[d]:
                    found.append(d)
                target = d + 1
            else:
                target = max(d + 1, min(skip, ahead))
            for t in upto:
                p, i = post[t], at[t]
                while i < len(p) and p[i][0] < target:
                    i += 1
                at[t] = i
            live = [t for t in live if at[t] < len(post[t])]
        return found

    def verify(self, passage: list[int], d: int) -> bool:
        grams = self.grams[d]
        return any(tuple(passage[i : i + self.run]) in grams for i in range(len(passage) - self.run + 1))


class Reader:
    """Reads passages of known words from texts; remembers what units are made of."""

    def __init__(self, index: Index):
        self.index = index
        self.units: dict[str, tuple[int, ...]] = {}

    def _unit(self, u: str) -> tuple[int, ...]:
        if len(self.units) > UNITS_KEPT:
            self.units.clear()
        get = self.index.terms.get
        self.units[u] = got = tuple(get(w, -1) for w in words(u))
        return got

    def items(self, text: str | None) -> list[int]:
        """Places in the index of the items that the text holds a run of."""
        if not text:
            return []
        known, run = self.units, self.index.run
        ids: list[int] = []
        for u in _UNIT.findall(text):
            got = known.get(u)
            ids += self._unit(u) if got is None else got
        if len(ids) < run:
            return []
        gaps = np.flatnonzero(np.array(ids, dtype=np.int32) < 0)
        edges = np.concatenate(([-1], gaps, [len(ids)]))
        hits: set[int] = set()
        for k in np.flatnonzero(np.diff(edges) > run):
            passage = ids[edges[k] + 1 : edges[k + 1]]
            hits.update(d for d in self.index.retrieve(passage) if d not in hits and self.index.verify(passage, d))
        return sorted(hits)


def _blocks(items: list[tuple[int, str | None]]) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for item in items:
        if block and size + len(item[1] or "") > INDEX_CHARS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1] or "")
    if block:
        yield block


def eval_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    run: int = RUN,
) -> DataFrame:
    """Distinct (``doc_key``, ``item_key``) where the document holds ``run`` consecutive words.

    Null, empty and blank texts on either side, and items of fewer than ``run`` words, give
    no row; repeated rows of either table give one row; empty tables give an empty result;
    other columns are ignored. Texts are read whole. The stated set of test items is
    streamed to the driver block by block to be indexed; documents never are.
    """
    spark = docs.sparkSession
    doc_kind = docs.schema[doc_key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {doc_kind}, `{item_key}` {item_kind}"
    asked = ((r[0], r[1]) for r in items.select(item_key, text).distinct().orderBy(item_key, text).toLocalIterator())
    out = None
    for block in _blocks(asked):
        shared = spark.sparkContext.broadcast(Index(block, run))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                pairs = [(k, reader.index.ids[d]) for k, t in zip(keys, texts) for d in reader.items(t)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pairs], type=batch.schema.field(0).type),
                        pa.array([p[1] for p in pairs], type=item_type),
                    ],
                    names=[doc_key, item_key],
                )

        item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
        part = docs.select(doc_key, text).mapInArrow(scan, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items they reveal."""
    return eval_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
