"""Long exact spans shared between records, found through recompression symbols.

Rounds of run and pair compression (``recompression``) name the text of every record
alike wherever it is alike. A last round names runs of final symbols that span
``WINDOW`` characters; of these the least in any stretch of ``SPREAD`` characters are
kept. ``2 * EDGE + WINDOW + LONGEST + SPREAD`` characters at most are needed for two equal
spans to keep the same name at the same place, which is no more than ``least``, so every
shared span of that length meets in a name. An equal span of ``least`` characters around
two places covers at least half of what ``WINDOW`` leaves of it before or behind them, so
places meet by their name with the fingerprint of that many characters on one side or on
the other; most boilerplate parts there, before any text is asked for. Places that meet are
extended in the texts to the longest equal span, which both reveals its ends and verifies it.

Exact copies meet as one class. A name and side shared by more than ``HOT`` classes is told
apart by the fingerprints of all stretches of ``least`` characters around it before pairs are
made, so boilerplate shorter than ``least`` yields no pairs however common it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.llm import recompression as R
from acervo.runtime import cut, table

LEAST = 250
WINDOW = 72
HOT = 64
#: Bits, as a power of two, of the map of classes whose texts are asked for.
MAP_BITS = 26
#: Classes whose copies one task recognises.
SEEN_KEPT = 1_000_000
#: Characters parsed at once by one task.
PARSE_CHARS = 2_000_000


def _spread(least: int, window: int) -> int:
    spread = least - 2 * R.EDGE - R.LONGEST - window
    if spread < 8:
        raise ValueError(f"spans must have {2 * R.EDGE + R.LONGEST + window + 8} characters or more, not {least}")
    return spread


def _half(least: int, window: int) -> int:
    """Characters that an equal span of ``least`` covers before or behind a window in it, at least."""
    return (least - window + 1) // 2


def _sides(texts: list[str], start: np.ndarray, owner: np.ndarray, window: int, half: int) -> np.ndarray:
    """16 bits of the ``half`` characters before each place and 16 of those behind its window; 0: too few characters."""
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    base = (np.cumsum(size) - size)[owner]
    odd = np.uint64(0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        h = R.mix(code.astype(np.uint64) + np.uint64(1))
        power = np.full(len(h) + 1, odd)
        power[0] = 1
        power = np.cumprod(power)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1])))
        inverse = np.full(len(h) + 1, np.uint64(pow(int(odd), -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        sides = []
        for first in (start - half, start + window):
            there = (first >= 0) & (first + half <= size[owner])
            at = np.where(there, base + first, 0)
            value = R.mix((prefix[np.where(there, at + half, 0)] - prefix[at]) * inverse[at]) >> np.uint64(48)
            sides.append(np.where(there, np.maximum(value, np.uint64(1)), np.uint64(0)).astype(np.uint32))
    return (sides[0] << np.uint32(16) | sides[1]).view(np.int32)


def _name_places(window: int, spread: int, least: int):
    """mapInArrow function: (class, text) -> (name, class, start, sides)."""
    half = _half(least, window)

    def emit(classes: list[int], texts: list[str]) -> pa.RecordBatch:
        name, start, _, owner = R.anchors(texts, window, spread)
        own = np.array(classes, dtype=np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        sides = _sides(texts, start, owner, window, half) if len(owner) else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(name.view(np.int64)), pa.array(own), pa.array(start.astype(np.int32)), pa.array(sides)],
            names=["name", "class", "start", "sides"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: list[int] = []
        texts: list[str] = []
        held = 0
        seen: set[int] = set()
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None or len(t) < least or c in seen:
                    continue
                # a copy of a text of this task would give the same places again
                if len(seen) == SEEN_KEPT:
                    seen.clear()
                seen.add(c)
                classes.append(c)
                texts.append(t)
                held += len(t)
                if held >= PARSE_CHARS:
                    yield emit(classes, texts)
                    classes, texts, held = [], [], 0
        if texts:
            yield emit(classes, texts)

    return run


def _extend(a: str, b: str, i: int, j: int) -> tuple[int, int, int]:
    """The longest equal span of ``a`` and ``b`` through places ``i`` and ``j``: starts and length."""
    if a[i] != b[j]:
        return i, j, 0

    def reach(most: int, equal) -> int:
        low, step = 0, 64
        while low < most and equal(low, min(low + step, most)):
            low, step = min(low + step, most), step * 2
        high = min(low + step, most)
        while low < high:
            mid = (low + high + 1) // 2
            if equal(low, mid):
                low = mid
            else:
                high = mid - 1
        return low

    right = reach(min(len(a) - i, len(b) - j), lambda p, q: a[i + p : i + q] == b[j + p : j + q])
    left = reach(min(i, j), lambda p, q: a[i - q : i - p] == b[j - q : j - p])
    return i - left, j - left, left + right


def _verify(least: int):
    """mapInArrow function over pairs with their texts and meeting places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for ca, cb, places, a, b in zip(*cols):
                done: dict[int, int] = {}
                for p in sorted(places, key=lambda p: p["i"]):
                    i, j = p["i"], p["j"]
                    if i < done.get(i - j, -1):
                        continue
                    s, t, n = _extend(a, b, i, j)
                    done[i - j] = max(s + n, i + 1)
                    if n >= least:
                        out.append((ca, cb, s, t, n))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], type=kind) for k, kind in enumerate(kinds)],
                names=["class_a", "class_b", "start_a", "start_b", "length"],
            )

    return run


def _stretches(least: int, window: int):
    """mapInArrow function: (class, text, starts) -> fingerprints of stretches around hot places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.uint64(0x9E3779B97F4A7C15 | 1)
        for batch in batches:
            names, owners, starts = [], [], []
            for c, text, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                h = R.mix(code.astype(np.uint64) + np.uint64(1))
                n = len(h) - least + 1
                if n <= 0:
                    continue
                wanted = np.zeros(n, dtype=bool)
                for p in places:
                    wanted[max(0, p + window - least) : p + 1] = True
                value = np.zeros(n, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(least):
                        value = value * odd + h[k : k + n]
                at = np.flatnonzero(wanted)
                names.append(R.mix(value[at]).view(np.int64))
                owners.append(np.full(len(at), c, dtype=np.int64))
                starts.append(at.astype(np.int32))
            e = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([e, *names])),
                    pa.array(np.concatenate([e, *owners])),
                    pa.array(np.concatenate([e.astype(np.int32), *starts])),
                ],
                names=["name", "class", "start"],
            )

    return run


def _shared_names(places: DataFrame) -> DataFrame:
    """Places whose name occurs in more than one class, with the number of places of the name.

    Names are counted by aggregation and met again over the same shuffle, so the places of one
    name stream by and are never gathered.
    """
    places = places.repartition("name")
    told = [F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")]
    # asking for what is never null keeps both sides alike, so the shuffle is made once
    rest = [c for c in places.columns if c not in ("name", "class")]
    counts = places.groupBy("name").agg(*told, *(F.min(c).alias(c) for c in rest)).where("low < high")
    for c in rest:
        counts = counts.where(F.col(c).isNotNull())
    return places.join(counts.select("name", "n"), "name")


def _by_side(places: DataFrame) -> DataFrame:
    """``name, class, start`` by the name and the characters before the place, and by it and those behind."""
    before, behind = F.shiftrightunsigned("sides", 16), F.col("sides").bitwiseAND(0xFFFF)
    side = lambda k, value: F.when(value != 0, F.xxhash64("name", F.lit(k), value))
    sided = places.select("class", "start", F.explode(F.array(side(0, before), side(1, behind))).alias("name"))
    return sided.where("name is not null").select("name", "class", "start")


def with_classes(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, text``) with ``class``, the same number for equal texts and no others.

    Texts are numbered by a 64-bit hash; the few that another text shares one with, told by
    a second fingerprint and the length, are numbered by a longer one.
    """
    first = rows.withColumn("class", F.xxhash64("text"))
    told = first.groupBy("class").agg(*(f(F.struct(F.length("text").alias("n"), F.md5("text").alias("m"))).alias(a) for f, a in ((F.min, "lo"), (F.max, "hi"))))
    bad = [r[0] for r in told.where("lo <> hi").select("class").collect()]
    return first.withColumn("class", F.when(F.col("class").isin(bad), F.xxhash64(F.md5("text"), "text")).otherwise(F.col("class"))) if bad else first


def of_asked(rows: DataFrame, asked: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The ``rows`` whose ``class`` is in ``asked``.

    A bitmap of the asked classes' hashes goes before the join, so texts that nobody asks for
    are mostly not shuffled. It has ``2 ** bits`` bits (8 MB) whatever the number of classes.
    """
    place = F.pmod(F.xxhash64(F.lit(1), F.col("class")), F.lit(1 << bits)) + 1
    maps = asked.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.bit_get(byte, (at % 8).cast("int"))
    likely = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket").where(bit == 1)
    # no semi join: that would be pushed below the bitmap, before which all texts are shuffled
    return likely.select(*rows.columns).join(asked.select("class").distinct(), "class")


def shared_spans(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """Spans shared by classes of equal texts, and the members of the classes.

    The first table has ``class_a, class_b, start_a, start_b, length`` for every longest
    equal span of ``least`` or more code points of two different texts; the second has
    ``class, key, n`` (code points) for every row with a text of that length. Null, empty
    and shorter texts appear in neither; repeated rows of one key count once; an empty
    table gives empty results; other columns are ignored.
    """
    spread = _spread(least, window)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= least)
    rows = with_classes(rows)
    members = cut(rows.select("class", F.col("key").alias(key), F.length("text").alias("n")))
    named = rows.select("class", "text").mapInArrow(
        _name_places(window, spread, least), "name bigint, class bigint, start int, sides int"
    )
    met = cut(_shared_names(_by_side(_shared_names(named))))
    hot = met.where(F.col("n") > HOT)
    cool = met.where(F.col("n") <= HOT).select("name", "class", "start")
    if not hot.isEmpty():
        spots = hot.groupBy("class").agg(F.collect_set("start").alias("starts"))
        texts = of_asked(rows.select("class", "text"), spots.select("class")).dropDuplicates(["class"])
        around = texts.join(spots, "class").select("class", "text", "starts")
        far = around.mapInArrow(_stretches(least, window), "name bigint, class bigint, start int")
        cool = cool.unionByName(_shared_names(far).select("name", "class", "start"))
    a = cool.select("name", F.col("class").alias("class_a"), F.col("start").alias("i"))
    b = cool.select("name", F.col("class").alias("class_b"), F.col("start").alias("j"))
    meet = (
        a.join(b, "name")
        .where("class_a < class_b")
        .groupBy("class_a", "class_b", F.expr("i - j").alias("lag"))
        .agg(F.collect_set(F.struct("i", "j")).alias("p"))
        .groupBy("class_a", "class_b")
        .agg(F.flatten(F.collect_list("p")).alias("places"))
    )
    meet = cut(meet)
    asked = meet.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    texts = cut(of_asked(rows.select("class", "text"), asked).dropDuplicates(["class"]))
    spans = (
        meet.join(texts.select(F.col("class").alias("class_a"), F.col("text").alias("text_a")), "class_a")
        .join(texts.select(F.col("class").alias("class_b"), F.col("text").alias("text_b")), "class_b")
        .select("class_a", "class_b", "places", "text_a", "text_b")
        .mapInArrow(_verify(least), "class_a bigint, class_b bigint, start_a int, start_b int, length int")
    )
    return spans, members


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share at least 250 code points in a row."""
    spans, members = shared_spans(table(spark, sf_dir, "documents"))
    pairs = spans.select("class_a", "class_b").distinct()
    m = members.select("class", "doc_id")
    across = (
        pairs.join(m.select(F.col("class").alias("class_a"), F.col("doc_id").alias("x")), "class_a")
        .join(m.select(F.col("class").alias("class_b"), F.col("doc_id").alias("y")), "class_b")
        .select("x", "y")
    )
    copied = m.groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    same = m.join(copied.select("class"), "class", "left_semi")
    within = (
        same.select("class", F.col("doc_id").alias("x"))
        .join(same.select("class", F.col("doc_id").alias("y")), "class")
        .where("x < y")
        .select("x", "y")
    )
    return (
        across.unionAll(within)
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .where("doc_id_a < doc_id_b")
        .distinct()
    )


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with shared spans: its code points, how many are shared, and the share."""
    spans, members = shared_spans(table(spark, sf_dir, "documents"))
    parts = spans.select("class_a", "start_a", "length").unionAll(spans.select("class_b", "start_b", "length"))
    parts = parts.toDF("class", "start", "length").distinct()
    whole = (
        members.groupBy("class")
        .agg(F.countDistinct("doc_id").alias("copies"), F.max("n").alias("length"))
        .where("copies > 1")
        .select("class", F.lit(0).alias("start"), "length")
    )
    before = Window.partitionBy("class").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        parts.unionByName(whole)
        .withColumn("stop", F.expr("start + length"))
        .withColumn("upto", F.coalesce(F.max("stop").over(before), F.lit(0)))
        .groupBy("class")
        .agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "upto"))).alias("shared_chars"))
    )
    return (
        members.join(covered, "class")
        .select(
            "doc_id",
            F.col("n").cast("bigint").alias("n_chars"),
            F.col("shared_chars").cast("bigint").alias("shared_chars"),
            F.round(F.col("shared_chars") / F.col("n"), 6).alias("shared_share"),
        )
        .distinct()
    )
