"""Noise in text from scanned pages: cut words, misread signs, running headers, page numbers.

Lines are told apart by ``pages``; every text is laid out once. The words of all texts are
counted with their neighbours, and skip-gram vectors are trained over the counts
(``skipgram``). A rare word is linked to the frequent words that plausible glyph edits turn
it into. Every occurrence takes the reading whose vector agrees best with the words
around it, weighed with its frequency; a word that could be a word of its own keeps its
spelling where the vectors of its context speak against all readings. Corrected words are
put back, furniture is removed and paragraphs are run on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm import pages, skipgram
from acervo.runtime import broadcast_if_small, cut, known, table

#: A word is linked to one that occurs this many times oftener: one seen at most twice, or more; words with
#: foreign signs are linked to any known one.
OFTENER, MUCH_OFTENER = 4, 25
KNOWN_LEAST = 2
#: Context words on each side.
REACH = 2
#: Least mean agreement of a reading's vector with its context, where the word has no foreign sign.
LEAST_AGREEMENT = -4.0
#: Weight of the agreement beside the logarithm of the reading's frequency.
CONTEXT_WEIGHT = 2.0
#: Longest word of which two edits at once are read.
TWO_EDITS = 30
#: Words of one text of which pairs are counted at once.
COUNT_WORDS = 400_000

#: Signs as recognised, with what the page had.
GLYPHS = (
    ("0", ("o", "ó", "ô", "ã", "õ")), ("1", ("i", "l", "í")), ("5", ("s",)), ("@", ("a", "á")), ("6", ("b", "ó", "é")), ("9", ("g", "q")),
    ("8", ("b",)), ("4", ("a", "á")), ("3", ("e",)), ("2", ("z",)), ("|", ("l", "i")), ("$", ("s",)), ("€", ("e",)),
    ("rn", ("m",)), ("m", ("rn", "nn", "in")), ("ri", ("n",)), ("cl", ("d",)), ("ii", ("u", "ü")), ("c", ("e", "é")),
    ("f", ("t",)), ("vv", ("w",)), ("w", ("vv", "vi")), ("h", ("li", "b")), ("ni", ("m",)),
)
_MOST_EDITS = 3
_WORD = re.compile(r"[^\s.,;:()\[\]«»“”\"!?¿¡/…]+")
_YEAR = re.compile(r"[0-9OoQlISZB|]{4}")
_YEAR_SIGNS = str.maketrans({"O": "0", "o": "0", "Q": "0", "l": "1", "I": "1", "|": "1", "S": "5", "Z": "2", "B": "8"})
_FOREIGN = re.compile(r"[0-9@|$€]")
_LETTER = re.compile(r"[^\W\d_]")


def year_of(word: str) -> str | None:
    """The year that a misread four-sign word stands for."""
    if not _YEAR.fullmatch(word) or word.isdigit() or sum(c.isdigit() for c in word) < 2:
        return None
    year = word.translate(_YEAR_SIGNS)
    return year if year[:2] in ("18", "19", "20") else None


def readings(word: str) -> list[str]:
    """Words that plausible glyph edits make of ``word``, the fewest edits first.

    Up to ``_MOST_EDITS`` foreign signs, none of them most of the word, are read as letters, with one
    more edit; words of 6 to ``TWO_EDITS`` letters take two edits, others one, or all of one kind.
    """
    foreign = [k for k, c in enumerate(word) if _FOREIGN.match(c)]
    if len(foreign) > _MOST_EDITS or foreign and (len(word) < 3 or 2 * len(foreign) >= len(word)):
        return []
    if len(word) < 3:
        return []
    bases = [word]
    if foreign:
        table_ = dict(GLYPHS)
        choices = [table_.get(word[k], ()) for k in foreign]
        bases = []
        for made in product(*choices):
            letters = list(word)
            for k, c in zip(foreign, made):
                letters[k] = c
            bases.append("".join(letters))
    out = dict.fromkeys(bases) if foreign else {}
    edge = bases
    seen = set(bases)
    # a word of foreign signs may have one more misread letter, another up to three of one kind
    for _ in range(1 if foreign or not 6 <= len(word) <= TWO_EDITS else 2):
        new = []
        for b in edge:
            for seen_as, meant in GLYPHS:
                if _FOREIGN.match(seen_as):
                    continue
                at = b.find(seen_as)
                while at >= 0:
                    for m in meant:
                        w = b[:at] + m + b[at + len(seen_as) :]
                        if w not in seen:
                            seen.add(w)
                            new.append(w)
                    at = b.find(seen_as, at + 1)
        out |= dict.fromkeys(new)
        edge = new
    if not foreign:
        for seen_as, meant in GLYPHS:
            if b_count := word.count(seen_as):
                if b_count > 1:
                    out |= dict.fromkeys(word.replace(seen_as, m) for m in meant)
    out.pop(word, None)
    return list(out)


def _plain_join(left: str, right: str) -> str:
    return left + right


def body_words(paragraphs: list[str]) -> Iterator[list[tuple[str, bool]]]:
    """Words of each sentence in lower case, and whether one begins with a capital inside it."""
    for p in paragraphs:
        for sentence in re.split(r"(?<=[.!?])\s+", p):
            found = _WORD.findall(sentence)
            yield [
                (w.strip("'’-–—_*").lower(), k > 0 and w[:1].isupper())
                for k, w in enumerate(found)
                if w.strip("'’-–—_*")
            ]


_EDGES = "'’_*\"“”«»()[].,;:!?¿¡"
_LAID = (
    "document_id string, scanned boolean, body array<string>, "
    "cuts array<struct<left:string,right:string,joined:string,kept:string>>, "
    "furniture array<struct<defect:string,item_value:string>>"
)


def laid_out(rows: DataFrame) -> DataFrame:
    """Every text's paragraphs (``body``), cut words and furniture (see ``_LAID``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("left", pa.string()), ("right", pa.string()), ("joined", pa.string()), ("kept", pa.string())])
        item = pa.struct([("defect", pa.string()), ("item_value", pa.string())])
        for batch in batches:
            bodies, cut_words, found = [], [], []
            for text, scanned, title, journal in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if not scanned:
                    bodies.append([q for q in (" ".join(x.split()) for x in re.split(r"\n\s*\n", text)) if q])
                    cut_words.append([])
                    found.append([])
                    continue
                lines = pages.layout(text, title, journal)
                body, cuts = pages.join_lines(lines, _plain_join)
                bodies.append(body)
                cut_words.append(
                    [
                        {"left": l, "right": r, "joined": (l + r).strip(_EDGES).lower(), "kept": f"{l}-{r}".strip(_EDGES).lower()}
                        for l, r, _ in dict.fromkeys(cuts)
                    ]
                )
                items = dict.fromkeys((l.kind, l.text) for l in lines if l.kind in ("header", "page_number"))
                cores = (w.strip("'’-–—_*") for p in body for w in _WORD.findall(p))
                items |= dict.fromkeys(("misread", y) for y in map(year_of, cores) if y)
                found.append([{"defect": d, "item_value": v} for d, v in items])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(bodies, pa.list_(pa.string())), pa.array(cut_words, pa.list_(pair)), pa.array(found, pa.list_(item))],
                names=["document_id", "scanned", "body", "cuts", "furniture"],
            )

    return rows.select("document_id", "text", "scanned", "title", "journal").mapInArrow(run, _LAID)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body) -> (word, context or '', n), summed over a stretch of rows."""

    def emit(ids: dict[str, int], stream: list[int]) -> pa.RecordBatch:
        names = np.array(list(ids), dtype=object)
        s = np.array(stream, dtype=np.int64)
        ones = np.bincount(s[s >= 0], minlength=len(ids))
        codes = []
        for step in range(1, REACH + 1):
            a, b = s[:-step], s[step:]
            good = (a >= 0) & (b >= 0)
            for j in range(1, step):
                good &= s[j : len(s) - step + j] >= 0
            codes += [a[good] * len(ids) + b[good], b[good] * len(ids) + a[good]]
        pair, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
        at = np.flatnonzero(ones)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((names[at], names[pair // max(len(ids), 1)])).tolist(), pa.string()),
                pa.array([""] * len(at) + names[pair % max(len(ids), 1)].tolist(), pa.string()),
                pa.array(np.concatenate((ones[at], n)).astype(np.int64)),
            ],
            names=["word", "context", "n"],
        )

    ids: dict[str, int] = {}
    stream: list[int] = []
    for batch in batches:
        for body in batch.column(0).to_pylist():
            for sentence in body_words(body):
                for w, name in sentence:
                    stream.append(-1 if name or not _LETTER.search(w) else ids.setdefault(w, len(ids)))
                stream.append(-1)
            if len(stream) > COUNT_WORDS:
                yield emit(ids, stream)
                ids, stream = {}, []
    if stream:
        yield emit(ids, stream)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanned rows -> every word of the running text once a row, with the words around it."""
    for batch in batches:
        cols: list[list] = [[], [], []]
        for doc, body, cuts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held: dict[str, Counter] = {}
            for sentence in body_words(body):
                words = [w for w, _ in sentence]
                for k, (w, name) in enumerate(sentence):
                    if name or len(w) < 2 or not _LETTER.search(w):
                        continue
                    around = held.setdefault(w, Counter())
                    around.update(words[max(0, k - REACH) : k] + words[k + 1 : k + 1 + REACH])
            kept = {w: list(c) for w, c in held.items()}
            for c in cuts:
                kept.setdefault(c["kept"], [])
            for w, c in kept.items():
                for col, v in zip(cols, (doc, w, c)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))],
            names=["document_id", "word", "around"],
        )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (word, n, reading, edits order)."""
    for batch in batches:
        rows: list[tuple[str, int, str, int]] = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [(word, n, r, k) for k, r in enumerate(readings(word))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[k] for r in rows], t)
                for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32()))
            ],
            names=["word", "n", "reading", "place"],
        )


def _chosen(vectors):
    """mapInArrow function: (document_id, word, around, choices) -> the reading that an occurrence takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vectors.value
        for batch in batches:
            out = []
            for doc, word, around, choices in zip(*(batch.column(k).to_pylist() for k in range(4))):
                best = None
                for c in choices:
                    agrees = model.agreement(c["reading"], around)
                    if agrees is not None and agrees < LEAST_AGREEMENT and not _FOREIGN.search(word):
                        continue
                    score = CONTEXT_WEIGHT * (agrees or 0.0) + float(np.log(c["m"]))
                    rank = (-score, c["place"], c["reading"])
                    if best is None or rank < best:
                        best = rank
                if best is not None:
                    out.append((doc, word, best[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["document_id", "word", "reading"])

    return run


def corrections(laid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected words of scanned rows (``document_id, word, reading``), and counts of all words."""
    counted = laid.select("body").mapInArrow(_counts, "word string, context string, n bigint")
    counted = cut(counted.groupBy("word", "context").agg(F.sum("n").alias("n")))
    words = cut(counted.where("context = ''").select("word", "n"))
    held = cut(laid.where("scanned").select("document_id", "body", "cuts").mapInArrow(_suspects, "document_id string, word string, around array<string>"))
    asked = held.select("word").distinct().join(words, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    frequent = words.select(F.col("word").alias("reading"), F.col("n").alias("m")).where(
        (F.col("m") >= KNOWN_LEAST) & ~F.col("reading").rlike(r"[0-9@|$€]")
    )
    foreign = F.col("word").rlike(r"[0-9@|$€]")
    links = (
        asked.repartition("word")
        .mapInArrow(_linked, "word string, n bigint, reading string, place int")
        .join(frequent, "reading")
        .where(foreign | (F.col("m") >= F.when(F.col("n") <= 2, OFTENER).otherwise(MUCH_OFTENER) * F.col("n")))
        .groupBy("word")
        .agg(F.collect_list(F.struct("reading", "m", "place")).alias("choices"))
    )
    # frequent words are in no link: a small list of links meets them without a shuffle
    linked = broadcast_if_small(cut(links))
    vectors = laid.sparkSession.sparkContext.broadcast(skipgram.train(counted, words))
    open_ = held.join(linked, "word").select("document_id", "word", "around", "choices")
    return open_.mapInArrow(_chosen(vectors), "document_id string, word string, reading string"), words


def _rows(corpus: DataFrame) -> DataFrame:
    return (
        corpus.select(
            "document_id",
            known("text_for_modeling").alias("text"),
            known("pdf_path_or_id").isNotNull().alias("scanned"),
            known("title").alias("title"),
            known("journal").alias("journal"),
        )
        .where("document_id is not null and text is not null")
        .distinct()
    )


def _whole_words(laid: DataFrame, fixed: DataFrame, words: DataFrame) -> DataFrame:
    """Cut words with how they are written whole: ``document_id, left, right, whole``."""
    pieces = laid.select("document_id", F.explode("cuts").alias("c")).select("document_id", "c.*")
    n = words.select(F.col("word"), F.col("n"))
    known_pieces = (
        pieces.join(n.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left")
        .join(n.select(F.col("word").alias("kept"), F.col("n").alias("nk")), "kept", "left")
        .join(
            fixed.select("document_id", F.col("word").alias("joined"), F.col("reading").alias("fix_joined")),
            ["document_id", "joined"],
            "left",
        )
        .join(
            fixed.select("document_id", F.col("word").alias("kept"), F.col("reading").alias("fix_kept")),
            ["document_id", "kept"],
            "left",
        )
    )
    # the joined form was itself counted where it was cut; one sighting proves nothing
    hyphened = F.coalesce("nk", F.lit(0)) > F.greatest(F.coalesce("nj", F.lit(0)) - 1, F.lit(0))
    return known_pieces.select(
        "document_id",
        "left",
        "right",
        F.when(hyphened, F.coalesce("fix_kept", "kept")).otherwise(F.coalesce("fix_joined", "joined")).alias("whole"),
    ).distinct()


def scan_defects(corpus: DataFrame) -> DataFrame:
    """Defects of the texts of scanned rows: ``document_id, defect, item_value``.

    Rows without document_id, with a null, blank or null-token text, or without a scanned
    page give nothing; repeated rows count once; texts of any length are read whole; ties
    between readings go to fewer edits and then to the lesser word; an empty table gives an
    empty result; other columns are ignored.
    """
    laid = cut(laid_out(_rows(corpus)))
    fixed, words = corrections(laid)
    fixed = cut(fixed)
    whole = cut(_whole_words(laid, fixed, words))
    hyphens = whole.select("document_id", F.lit("hyphen").alias("defect"), F.col("whole").alias("item_value"))
    kept_forms = whole.where("whole like '%-%'").select(
        "document_id", F.regexp_replace("whole", "-", "").alias("reading")
    )
    misread = fixed.join(kept_forms, ["document_id", "reading"], "left_anti").select(
        "document_id", F.lit("misread").alias("defect"), F.col("reading").alias("item_value")
    )
    furniture = laid.select("document_id", F.explode("furniture").alias("f")).select("document_id", "f.*")
    return hyphens.unionByName(misread).unionByName(furniture).distinct()


def repaired_texts(corpus: DataFrame) -> DataFrame:
    """``document_id, repaired``: scanned texts as continuous paragraphs in their true spelling."""
    rows = cut(_rows(corpus))
    laid = cut(laid_out(rows))
    fixed, words = corrections(laid)
    fixed = cut(fixed)
    whole = _whole_words(laid, fixed, words)
    marks = (
        fixed.select("document_id", F.struct(F.col("word").alias("a"), F.lit("").alias("b"), F.col("reading").alias("w")).alias("m"))
        .unionByName(whole.select("document_id", F.struct(F.col("left").alias("a"), F.col("right").alias("b"), F.col("whole").alias("w")).alias("m")))
        .groupBy("document_id")
        .agg(F.collect_set("m").alias("marks"))
    )
    joined = rows.where("scanned").join(marks, "document_id", "left").select("document_id", "text", "title", "journal", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, title, journal, given in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                cuts = {(m["a"], m["b"]): m["w"] for m in given or () if m["b"]}
                single = {m["a"]: m["w"] for m in given or () if not m["b"]}

                def join(left: str, right: str) -> str:
                    w = cuts.get((left, right), left + right)
                    at = (left + right).lower().find(w.replace("-", ""))
                    return left + ("-" if "-" in w and at >= 0 else "") + right

                def fix(m: re.Match) -> str:
                    w = m[0]
                    core = w.strip("'’-–—_*")
                    new = single.get(core.lower()) or year_of(core)
                    if not new:
                        return w
                    return w.replace(core, new.capitalize() if core[:1].isupper() and core[1:].islower() else new)

                body, _ = pages.join_lines(pages.layout(text, title, journal), join)
                out.append("\n\n".join(_WORD.sub(fix, p) for p in body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["document_id", "repaired"])

    return joined.mapInArrow(run, "document_id string, repaired string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects that page layout and recognition left in the texts of scanned rows."""
    return scan_defects(table(spark, sf_dir, "corpus_builder"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts of scanned rows."""
    return repaired_texts(table(spark, sf_dir, "corpus_builder")).distinct()
