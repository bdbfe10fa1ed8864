"""Skip-gram vectors with negative sampling, trained over counts of (word, context).

The objective is that of skip-gram: ``n(w, c) log s(w.c)`` over the pairs seen, plus
``NEGATIVES`` times ``n(w) log s(-w.c')`` over contexts drawn by their frequency to the
power 3/4. With the context vectors fixed it falls apart into one concave problem per word, and
the other way round, so Spark trains in turns: pairs partitioned by word with all context
vectors at hand, then by context with all word vectors. A turn takes ``STEPS`` steps of
Adagrad. Start and drawn contexts are fixed, so a lost task is repeated alike.

Vectors are those of the ``MOST_VECTORS`` most frequent words with ``VECTOR_LEAST``
occurrences: a bounded model, at most 2 x 50,000 x 32 floats (13 MB) on the driver and every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 32
NEGATIVES = 5
MOST_VECTORS, VECTOR_LEAST = 50_000, 5
TURNS, STEPS, RATE = 4, 12, 0.5
#: Contexts drawn for the negative part of a turn.
DRAWN = 256


class Vectors:
    """Word and context vectors; ``agreement`` is their product plus ln NEGATIVES: about the mutual information."""

    def __init__(self, words: list[str], of_words: np.ndarray, of_contexts: np.ndarray):
        self.at = {w: k for k, w in enumerate(words)}
        self.of_words, self.of_contexts = of_words, of_contexts

    def agreement(self, word: str, contexts: list[str]) -> float | None:
        """Mean agreement of a word with the contexts that have vectors; None where nothing is known."""
        k = self.at.get(word)
        around = [self.at[c] for c in contexts if c in self.at]
        if k is None or not around:
            return None
        return float((self.of_contexts[around] @ self.of_words[k]).mean() + np.log(NEGATIVES))


def _start(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.3, (n, DIM)).astype(np.float32)


def _turn(own: np.ndarray, other: np.ndarray, mine: np.ndarray, theirs: np.ndarray, n: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """New vectors of the items ``mine`` (sorted), with the vectors ``other`` fixed."""
    items, begins = np.unique(mine, return_index=True)
    x = own[items].copy()
    row = np.repeat(np.arange(len(items)), np.diff(np.append(begins, len(mine))))
    total = np.add.reduceat(n, begins).astype(np.float32)
    negative, share = other[drawn], NEGATIVES * total / len(drawn)
    seen = np.full_like(x, 1e-6)
    fixed = other[theirs]
    for _ in range(STEPS):
        miss = n / (1 + np.exp(np.clip((x[row] * fixed).sum(axis=1), -20, 20)))
        up = np.add.reduceat(miss[:, None] * fixed, begins, axis=0)
        down = (1 / (1 + np.exp(-np.clip(x @ negative.T, -20, 20)))) @ negative * share[:, None]
        slope = (up - down - 0.05 * x) / total[:, None]
        seen += slope * slope
        x += RATE * slope / np.sqrt(seen)
    return x


def train(counted: DataFrame, words: DataFrame) -> Vectors:
    """Vectors from ``word, context, n`` of all pairs and ``word, n`` of all words."""
    spark = words.sparkSession
    top = words.where(F.col("n") >= VECTOR_LEAST).orderBy(F.col("n").desc(), "word").limit(MOST_VECTORS).collect()
    names = [r.word for r in top]
    of_words, of_contexts = _start(len(names), 1), _start(len(names), 2)
    if not names:
        return Vectors(names, of_words, of_contexts)
    chance = np.array([r.n for r in top], dtype=np.float64) ** 0.75
    ids = spark.createDataFrame([(w, k) for k, w in enumerate(names)], "word string, id int")
    ids = F.broadcast(ids)  # MOST_VECTORS rows at most
    pairs = (
        counted.where("context <> ''")
        .join(ids.withColumnRenamed("id", "w"), "word")
        .join(ids.select(F.col("word").alias("context"), F.col("id").alias("c")), "context")
        .select("w", "c", F.col("n").cast("float").alias("n"))
        .persist()
    )
    parts = max(4, spark.sparkContext.defaultParallelism)
    sides = {a: pairs.repartition(parts, a).sortWithinPartitions(a, b).select(a, b, "n").persist() for a, b in (("w", "c"), ("c", "w"))}
    for turn in range(TURNS):
        side = "w" if turn % 2 == 0 else "c"
        drawn = np.random.default_rng(turn).choice(len(names), DRAWN, p=chance / chance.sum())
        held = spark.sparkContext.broadcast((of_words, of_contexts) if side == "w" else (of_contexts, of_words))

        def run(batches: Iterator[pa.RecordBatch], held=held, drawn=drawn) -> Iterator[pa.RecordBatch]:
            got = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)) for b in batches if b.num_rows]
            if not got:
                return
            mine, theirs, n = (np.concatenate(c) for c in zip(*got))
            own, other = held.value
            x = _turn(own, other, mine, theirs, n, drawn)
            items = np.unique(mine)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), DIM).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), flat], names=["id", "vector"])

        made = sides[side].mapInArrow(run, "id int, vector array<float>").toArrow()
        at, new = made.column("id").to_numpy(), np.array(made.column("vector").to_pylist(), dtype=np.float32)
        target = of_words if side == "w" else of_contexts
        if len(at):
            target[at] = new
        held.unpersist()
    for kept in (pairs, *sides.values()):
        kept.unpersist()
    return Vectors(names, of_words, of_contexts)
