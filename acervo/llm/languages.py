"""Language of texts and of their segments: nearest of several centroids per language.

Segments are sentences of the running text (page furniture aside). A segment is the
normalised TF-IDF vector of its letter trigrams, hashed to ``BUCKETS``. The centroids come
from sentences of at most ``FIT_ROWS`` rows per language whose labels agree; sentences
nearer to another language's centroid than to their own are put aside before each
language is clustered into ``CLUSTERS`` centroids. A segment takes the language of the
nearest centroid by cosine; beyond the distance that all but ``REJECT`` of the fitted
sentences keep, it is rejected. The confidence is the margin to the next language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.llm import pages
from acervo.runtime import known, table

LANGUAGES = ("en", "es", "fr", "id", "pt")
BUCKETS = 1 << 15
CLUSTERS = 3
#: Most labelled rows per language that the centroids are fitted to.
FIT_ROWS = 300
REJECT = 0.002
#: A full sentence has this many words or more.
SENTENCE_WORDS = 7
#: Least margin by which a sentence shows a second language in a text.
LEAST_MARGIN = 0.04
SEGMENT_CHARS = 3_000_000

#: How labels write the languages.
LABELS = {
    "es": "es", "spa": "es", "español": "es", "espanol": "es", "castellano": "es", "spanish": "es",
    "en": "en", "eng": "en", "english": "en", "inglés": "en",
    "pt": "pt", "por": "pt", "português": "pt", "portugues": "pt", "portuguese": "pt",
    "id": "id", "ind": "id", "indonesian": "id", "indonesia": "id", "bahasa indonesia": "id",
    "fr": "fr", "fra": "fr", "fre": "fr", "français": "fr", "francais": "fr", "french": "fr",
}
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»)\]]*\s+(?=[\"“«(\[¿¡]*[^\W\d_a-z]|[\"“«(\[¿¡]*\d)")
_WORD = re.compile(r"[^\W\d_]+")


def label_of(text: str | None) -> str | None:
    """The language code that a label stands for."""
    if text is None:
        return None
    t = text.strip().lower().replace("_", "-")
    return LABELS.get(t) or LABELS.get(t.split("-")[0])


def segments(text: str, title: str | None = None, journal: str | None = None) -> list[tuple[str, bool]]:
    """Sentences of the running text in order, and whether each is a full one."""
    lines = pages.layout(text, title, journal)
    blocks, _ = pages.join_lines(lines, lambda a, b: a + b)
    out = []
    for block in blocks:
        for s in _SENTENCE.split(block):
            s = s.strip()
            if s:
                words = _WORD.findall(s)
                full = len(words) >= SENTENCE_WORDS and s.rstrip("\"”»)]").endswith((".", "!", "?", "…"))
                out.append((s, full))
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all texts (within and at the edges of words), and their owners."""
    joined = "\n".join(f" {' '.join(_WORD.findall(t.lower()))} " for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line = np.cumsum(code == 10) - (code == 10)
    a, b, c = code[:-2].astype(np.uint64), code[1:-1].astype(np.uint64), code[2:].astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77) + c * np.uint64(0xC2B2AE3D)) * np.uint64(
            0x27D4EB2F165667C5
        )
    bucket = (h >> np.uint64(64 - 15)).astype(np.int64)
    good = (code[:-2] != 10) & (code[1:-1] != 10) & (code[2:] != 10) & (code[1:-1] != 32)
    return bucket[good], line[:-2][good]


class Vectors:
    """Sparse normalised TF-IDF rows: bucket, weight, and where each row starts."""

    def __init__(self, texts: list[str], idf: np.ndarray | None = None):
        bucket, owner = grams(texts)
        key, tf = np.unique(owner * BUCKETS + bucket, return_counts=True)
        self.owner, self.bucket = key // BUCKETS, key % BUCKETS
        self.n = len(texts)
        if idf is None:
            df = np.bincount(self.bucket, minlength=BUCKETS)
            idf = np.log((1 + self.n) / (1 + df)) + 1
        self.idf = idf
        w = np.sqrt(tf) * idf[self.bucket]
        norm = np.sqrt(np.bincount(self.owner, w * w, self.n))
        self.weight = w / norm[self.owner]

    def cosines(self, centroids: np.ndarray) -> np.ndarray:
        """Row by centroid (centroids of unit length)."""
        out = np.empty((self.n, len(centroids)))
        for k, c in enumerate(centroids):
            out[:, k] = np.bincount(self.owner, self.weight * c[self.bucket], self.n)
        return out

    def mean(self, rows: np.ndarray) -> np.ndarray:
        """Unit centroid of a choice of rows (by mask)."""
        at = rows[self.owner]
        c = np.bincount(self.bucket[at], self.weight[at], BUCKETS)
        return c / max(np.sqrt((c * c).sum()), 1e-12)


class Model:
    """Centroids with their languages, idf weights, and the cosine below which to reject."""

    def __init__(self, texts: list[str], labels: list[str], clusters: int = CLUSTERS):
        v = Vectors(texts)
        label = np.array(labels)
        names = sorted(set(labels))
        for _ in range(3):
            one = np.array([v.mean(label == n) for n in names])
            label = np.array(names)[v.cosines(one).argmax(axis=1)]
        kept = label == np.array(labels)
        centroids, owners = [], []
        for n in names:
            mine = np.flatnonzero(kept & (label == n))
            if not len(mine):
                continue
            k = min(clusters, len(mine))
            group = np.zeros(v.n, dtype=int) - 1
            group[mine] = np.arange(len(mine)) % k
            for _ in range(8):
                found = np.array([v.mean(group == g) for g in range(k)])
                near = v.cosines(found).argmax(axis=1)
                if (group[mine] == near[mine]).all():
                    break
                group[mine] = near[mine]
            centroids += list(found)
            owners += [n] * k
        self.centroids = np.array(centroids).astype(np.float64)
        self.owners = np.array(owners)
        self.idf = v.idf
        own = v.cosines(self.centroids).max(axis=1)[kept]
        self.least = float(np.quantile(own, REJECT)) * 0.6 if len(own) else 0.0

    def classify(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """Language (None where rejected) and margin to the next language for each text."""
        if not texts or not len(self.owners):
            return [(None, 0.0)] * len(texts)
        v = Vectors(texts, self.idf)
        cos = v.cosines(self.centroids)
        names = sorted(set(self.owners))
        per = np.stack([cos[:, self.owners == n].max(axis=1) for n in names], axis=1)
        best = per.argmax(axis=1)
        top = per[np.arange(len(texts)), best]
        other = per.copy()
        other[np.arange(len(texts)), best] = -1
        margin = top - other.max(axis=1) if len(names) > 1 else top
        return [
            (names[b] if t >= self.least and t > 0 else None, float(m)) for b, t, m in zip(best, top, margin)
        ]


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit to at most ``fit_rows`` rows per language whose two labels do not disagree.

    ``rows`` has ``text, title, journal, detected, metadata``; the rows are taken in hash
    order. The labelled rows are the one sample that reaches the driver.
    """
    written = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    code = lambda c: written[F.element_at(F.split(F.regexp_replace(F.lower(F.trim(c)), "_", "-"), "-"), 1)]
    labelled = rows.where(F.length("text") >= 200).select(
        "text", "title", "journal", F.col("detected").alias("lang"), code(F.col("metadata")).alias("said")
    )
    order = Window.partitionBy("lang").orderBy(F.col("said").isNull(), F.xxhash64("text"))
    chosen = (
        labelled.where(F.col("lang").isin(*LANGUAGES) & (F.col("said").isNull() | (F.col("said") == F.col("lang"))))
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= fit_rows)
    )
    texts, labels = [], []
    for r in chosen.select("text", "title", "journal", "lang").collect():
        for s, full in segments(r.text, r.title, r.journal):
            if full:
                texts.append(s)
                labels.append(r.lang)
    return Model(texts, labels) if texts else Model(["a"], ["en"])


def _labelled(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "document_id",
        known("text_for_modeling").alias("text"),
        known("title").alias("title"),
        known("journal").alias("journal"),
        F.lower(F.trim(known("language_detected"))).alias("detected"),
        known("language_metadata").alias("metadata"),
    ).where("document_id is not null and text is not null")


def label_segments(corpus: DataFrame) -> DataFrame:
    """Language of every text and segment: one row per segment.

    ``document_id, pos, lang_code, confidence, full, chars, detected``: segments by position,
    ``lang_code`` NULL where rejected. Null, blank and null-token texts give no row;
    repeated rows repeat; a text of any length is segmented whole; ties go to the code that
    sorts first; an empty table gives an empty result; other columns are ignored.
    """
    rows = _labelled(corpus)
    shared = corpus.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.string())
        names = ["document_id", "pos", "lang_code", "confidence", "full", "chars", "detected"]

        def emit(held: list[tuple]) -> pa.RecordBatch:
            said = model.classify([h[2] for h in held])
            cols = list(zip(*((h[0], h[1], lang, m, h[3], len(h[2]), h[4]) for h, (lang, m) in zip(held, said))))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text, title, journal, detected in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for pos, (s, full) in enumerate(segments(text, title, journal), 1):
                    held.append((doc, pos, s, full, detected))
                    size += len(s)
                if size > SEGMENT_CHARS:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return rows.select("document_id", "text", "title", "journal", "detected").mapInArrow(
        run,
        "document_id string, pos int, lang_code string, confidence double, full boolean, chars int, detected string",
    )


def _by_text(labelled: DataFrame) -> DataFrame:
    """Languages of every row's text: the main one by characters, and all with a full sentence."""
    sure = F.col("lang_code").isNotNull()
    shown = labelled.where(sure).groupBy("document_id", "detected", "lang_code").agg(
        F.sum(F.when(F.col("full"), F.col("chars")).otherwise(0)).alias("full_chars"),
        F.sum("chars").alias("chars"),
        F.max(F.when(F.col("full"), F.col("confidence"))).alias("margin"),
        (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"),
    )
    of_doc = Window.partitionBy("document_id", "detected")
    return (
        shown.withColumn("any_full", F.sum("full_chars").over(of_doc))
        .withColumn(
            "main",
            F.row_number().over(of_doc.orderBy(F.col("full_chars").desc(), F.col("chars").desc(), "lang_code")) == 1,
        )
        .withColumn("held", F.col("main") | (F.col("full_chars") > 0) & (F.col("margin") >= LEAST_MARGIN))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every row whose label is missing, unknown or wrong, or whose text mixes languages."""
    by_text = _by_text(label_segments(table(spark, sf_dir, "corpus_builder"))).where("held")
    of_doc = Window.partitionBy("document_id", "detected")
    return (
        by_text.withColumn("n", F.count(F.lit(1)).over(of_doc))
        .withColumn("main_code", F.max(F.when(F.col("main"), F.col("lang_code"))).over(of_doc))
        .where(
            F.col("detected").isNull()
            | (F.col("detected") == "und")
            | (F.col("detected") != F.col("main_code"))
            | (F.col("n") > 1)
        )
        .select("document_id", "lang_code")
        .distinct()
    )


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every row's text with its confidence."""
    by_text = _by_text(label_segments(table(spark, sf_dir, "corpus_builder"))).where("main")
    return by_text.select("document_id", "lang_code", F.round("confidence", 6).alias("confidence")).distinct()
