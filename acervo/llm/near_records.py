"""Near-duplicate records with small edits, through bottom-k sketches of one hash function.

A record is the set of its feature pairs: any two title words, a title word with a family
name. One hash function orders the features of all records alike: a feature's rank is
``-ln(u) / weight`` with ``u`` drawn from its hash and a weight that falls with the
frequencies of its two tokens over all records, so the ``k`` least ranks sample by telling
power and two records that share features keep the same ones. A retained value is the rank
itself (positive floats order like their bits), so sketches are merged by value.

Inverted lists of retained values give the overlaps. Each entry carries its place in the
sketch and a ``gate`` of the year, the initials of the people and the instalment, so records
that no comparison could confirm do not meet. For every pair that meets, the ``k`` least
values of the union of both sketches are taken (the places of the shared values tell them,
where no list is long); the share of them that both hold estimates the similarity and
filters. Only what is left is brought together with the records. The exact Jaccard similarity of the titles' words
(slips excused) and the comparison of people, years and instalments verify.

Records that read alike are one class before anything is listed. Two shared values are
asked for (one, where a sketch has no more), so a list of more than ``HOT`` classes is
listed again by pairs of long lists: what shares a long and a short list meets in the short
one. A pair list of more than ``HOT_PAIRS`` is not paired at once: first all its members meet one
hub, then, as long as that links any, the hub of what is left; the members of different
components of the list are then all paired. A pair that is never compared is one that the
components hold together already, so nothing is lost, and a long list of one publication
costs its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.llm import publication as pub
from acervo.operators.components import connected_components
from acervo.runtime import cut, known, table

K = 24
HOT = 64
#: Longest list of a pair of values that is paired at once.
HOT_PAIRS = 512
#: Rounds of hubs before the rest of a long list is paired; they save pairs and change no result.
HUB_ROUNDS = 2
#: Members of a long list that one task meets at once.
SPLIT = 4_096
#: Least similarity, estimated from the union of two sketches, of a candidate pair.
LEAST_ESTIMATE = 0.06
#: Least exact Jaccard similarity of two titles that are linked.
LEAST_JACCARD = 0.3
_TOKEN = np.uint64(0x9E3779B97F4A7C15)
_END = np.iinfo(np.int64).max
#: Feature ranks that one step holds at once.
_CELLS = 2_000_000


def sketches_of(token_lists: list[list[str]], counts: list[list[int]], k: int = K) -> list[list[int]]:
    """The ``k`` least feature ranks of every record, as integers that order like them."""
    out: list[list[int]] = [[] for _ in token_lists]
    by_size: dict[int, list[int]] = {}
    held = []
    for at, (toks, df) in enumerate(zip(token_lists, counts)):
        # a token of this record alone is in no feature that another record has
        pairs = [(t, d) for t, d in zip(toks, df) if d > 1]
        held.append(pairs)
        if pairs:
            by_size.setdefault(len(pairs), []).append(at)
    for size, rows in by_size.items():
        i, j = np.triu_indices(size, 1)
        step = max(1, _CELLS // (len(i) + size))
        for begin in range(0, len(rows), step):
            part = rows[begin : begin + step]
            h = np.array([[xxhash.xxh64_intdigest(t) for t, _ in held[r]] for r in part], dtype=np.uint64)
            n = np.maximum(np.array([[d for _, d in held[r]] for r in part], dtype=np.float64), 4)
            kind = np.array([["tad".index(t[0]) for t, _ in held[r]] for r in part], dtype=np.int8)
            with np.errstate(over="ignore", divide="ignore"):
                lo, hi = np.minimum(h[:, i], h[:, j]), np.maximum(h[:, i], h[:, j])
                f = lo * _TOKEN ^ (hi + (lo >> np.uint64(29)))
                f ^= f >> np.uint64(32)
                f *= np.uint64(0xD6E8FEB86659FD93)
                f ^= f >> np.uint64(32)
                f = np.concatenate((f, h), axis=1)
                weight = np.concatenate((1 / (n[:, i] * n[:, j]), np.full(h.shape, 1 / 16.0)), axis=1)
                u = ((f * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54
                rank = -np.log(u) / weight
            a, d = kind == 1, kind == 2
            rank[:, : len(i)][a[:, i] & a[:, j] | d[:, i] | d[:, j]] = np.inf
            # a DOI stands alone, and so does the one token of a record
            single = ~np.isfinite(rank[:, : len(i)]).any(axis=1) & ~d.any(axis=1)
            alone = d.copy()
            alone[single, 0] = True
            rank[:, len(i) :][~alone] = np.inf
            least = np.sort(np.partition(rank, min(k, rank.shape[1]) - 1, axis=1)[:, :k], axis=1)
            for r, ranks in zip(part, least):
                out[r] = np.unique(ranks[np.isfinite(ranks)].view(np.int64)).tolist()
    return out


def union_estimates(left: pa.ListArray, right: pa.ListArray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sketches: how many of the ``k`` least of their union both hold, and the share of it."""
    both = np.full((len(left), 2 * k), _END, dtype=np.int64)
    for half, lists in ((both[:, :k], left), (both[:, k:], right)):
        half[np.arange(k) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    both.sort(axis=1)
    again = both[:, 1:] == both[:, :-1]
    new = np.concatenate((np.ones((len(both), 1), dtype=bool), ~again), axis=1) & (both != _END)
    place = np.cumsum(new, axis=1) - 1
    shared = (again & (both[:, 1:] != _END) & (place[:, 1:] < k)).sum(axis=1)
    return shared, shared / np.maximum(np.minimum(new.sum(axis=1), k), 1)


def likely_pairs(left: pa.ListArray, right: pa.ListArray, least: float = LEAST_ESTIMATE) -> np.ndarray:
    """Which pairs of sketches are let through: enough shared values for the estimate, and two where both have two."""
    shared, estimate = union_estimates(left, right)
    sizes = np.minimum(left.value_lengths().to_numpy(zero_copy_only=False), right.value_lengths().to_numpy(zero_copy_only=False))
    return (estimate >= least) & (shared >= np.minimum(2, sizes))


def passes(a: Column, b: Column) -> Column:
    """Whether two gates (``publication.gate``) let a pair through; those of one publication always do."""
    year, kind = (lambda g: F.shiftrightunsigned(g, 54)), (lambda g: F.shiftrightunsigned(g, 50).bitwiseAND(15))
    near = (year(a) == 0) | (year(b) == 0) | (F.abs(year(a) - year(b)) <= pub.YEARS_APART)
    alike = (kind(a) == 0) | (kind(b) == 0) | (kind(a) == kind(b))
    return near & alike & (a.bitwiseAND(b).bitwiseAND(F.lit(pub.EVERYBODY << pub.GATE_FREE)) != 0)


def sketches(classes: DataFrame, k: int = K) -> DataFrame:
    """``class, gate, values`` of every class that has a token others have; ``classes`` has ``class, work, gate``."""
    listed = with_tokens(classes.select("class", "work")).select("class", F.explode("tokens").alias("token"))
    counts = listed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    weighed = (
        listed.join(counts, "token")
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(F.struct("token", "df"))).alias("toks"))
        .join(classes.select("class", "gate"), "class")
        .select("class", "gate", "toks.token", "toks.df")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = sketches_of(batch.column(2).to_pylist(), batch.column(3).to_pylist(), k)
            columns = [batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "gate", "values"])

    return weighed.mapInArrow(run, "class bigint, gate bigint, values array<bigint>")


def within_union(bits: Column, k: int = K) -> Column:
    """How many shared values are among the ``k`` least of the union of two sketches.

    ``bits`` has a bit for the sum of the two places of every shared value. The ``t``-th of them
    has the place ``sum - t`` in the union. Sums of one pair lie two apart at least, so the rounds suffice.
    """
    found = F.lit(0)
    for _ in range(8):
        found = F.bit_count(bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(k) + found) - 1))
    return found


def short_pairs(sized: DataFrame, hot: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """``a, b, sure``: pairs of classes that meet in lists of up to ``HOT`` and can reach the least estimate.

    ``sized`` has ``class, gate, size, value, place, n``: the value's place in the sketch and the
    list's length ``n``; ``hot`` has ``class, hot``: how many of its ``size`` values are in longer
    lists. Those count as shared here, so that no pair is dropped which the union of the sketches
    would let through. Where one class has none, the estimate is exact and the pair ``sure`` to reach it.
    """
    meta = F.col("gate").bitwiseOR((F.col("place") * 32 + F.col("size")).cast("bigint"))
    short = sized.where(F.col("n") <= HOT).select("value", "class", meta.alias("meta"))
    one, two = (short.select("value", F.col("class").alias(c), F.col("meta").alias(f"m{c}")) for c in "ab")
    place, size = (lambda m, s=s: F.shiftrightunsigned(m, s).bitwiseAND(31).cast("int") for s in (5, 0))
    met = one.join(two, "value").where("a < b").where(passes(F.col("ma"), F.col("mb")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place(F.col("ma")) + place(F.col("mb")))
    # both sizes go above the bits of the places
    sizes = (size(F.col("ma")) * 32 + size(F.col("mb"))).cast("bigint")
    met = met.select("a", "b", F.shiftleft(sizes, 48).bitwiseOR(bit).alias("bits")).groupBy("a", "b").agg(F.bit_or("bits").alias("bits"))
    of = lambda c: hot.select(F.col("class").alias(c), F.col("hot").alias(f"h{c}"))
    met = met.join(of("a"), "a", "left").join(of("b"), "b", "left").fillna(0, ["ha", "hb"])
    bits = F.col("bits").bitwiseAND(F.lit((1 << 48) - 1))
    na, nb = (F.shiftrightunsigned("bits", s).bitwiseAND(31).cast("int") for s in (53, 48))
    overlap, unseen, shared = F.bit_count(bits), F.least("ha", "hb"), within_union(bits)
    may = overlap + unseen >= F.lit(least) * F.greatest(na, nb)
    reaches = (shared >= F.lit(least) * F.least(na + nb - overlap, F.lit(K))) & (shared >= F.least(F.lit(2), na, nb))
    return met.where(may & ((unseen > 0) | reaches)).select("a", "b", (unseen == 0).alias("sure"))


def likely_of(pairs: DataFrame, drawn: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """The ``a, b`` that the union of both sketches lets through; ``drawn`` has ``class, values``."""
    one = drawn.select(F.col("class").alias("a"), F.col("values").alias("x"))
    two = drawn.select(F.col("class").alias("b"), F.col("values").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = likely_pairs(batch.column(2), batch.column(3), least)
            yield batch.select(["a", "b"]).filter(pa.array(likely, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def verify_pairs(pairs: DataFrame, classes: DataFrame, same: Callable) -> DataFrame:
    """``a, b, similarity`` of the pairs that exact comparison confirms; ``classes`` has ``class, work``."""
    one = classes.select(F.col("class").alias("a"), F.col("work").alias("x"))
    two = classes.select(F.col("class").alias("b"), F.col("work").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for a, b, x, y in zip(*(batch.column(n).to_pylist() for n in range(4))):
                p, q = pub.unpack(x), pub.unpack(y)
                if same(p, q):
                    jaccard = pub.jaccard(p.title, q.title) if p.title and q.title else 1.0
                    if jaccard >= LEAST_JACCARD:
                        out.append((a, b, jaccard))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in out], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["a", "b", "similarity"],
            )

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a bigint, b bigint, similarity double")


def pair_lists(sized: DataFrame) -> DataFrame:
    """``value, class, gate``: classes listed by every pair of long lists that hold them."""
    held = sized.where(F.col("n") > HOT).groupBy("class", "gate").agg(F.sort_array(F.collect_list("value")).alias("values"))
    pairs = F.flatten(
        F.transform(
            F.col("values"),
            lambda v, i: F.transform(F.slice("values", i + 2, F.size("values")), lambda w: F.struct(v.alias("v"), w.alias("w"))),
        )
    )
    return held.select(F.explode(pairs).alias("value"), "class", "gate")


def bare_pairs(sized: DataFrame) -> DataFrame:
    """``a, b``: classes whose sketch is one value of a long list, with all classes of the list."""
    long = sized.where(F.col("n") > HOT)
    bare = long.where(F.col("size") == 1).select("value", F.col("class").alias("c"), F.col("gate").alias("g"))
    met = bare.join(long.select("value", "class", "gate"), "value").where("c <> class").where(passes(F.col("g"), F.col("gate")))
    return met.select(F.least("c", "class").alias("a"), F.greatest("c", "class").alias("b"))


def _of_components(long: DataFrame, links: DataFrame) -> DataFrame:
    """Members of long lists with their components, without the lists that lie in one component."""
    parts = connected_components(links).select(F.col("node").alias("class"), "component")
    told = long.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = told.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
    return cut(told.join(open_.where("lo < hi").select("value", "m"), "value"))


def _largest(told: DataFrame) -> DataFrame:
    """The largest component of every list and its least member: ``value, big, hub``."""
    sizes = told.groupBy("value", "component").agg(F.count(F.lit(1)).alias("held"), F.min("class").alias("hub"))
    return sizes.groupBy("value").agg(F.max(F.struct("held", F.col("component").alias("big"), "hub")).alias("top")).select(
        "value", "top.big", "top.hub"
    )


def hot_links(long: DataFrame, links: DataFrame, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``links`` and all links that members of long lists (``value, class``) add to their components."""
    found = links
    for _ in range(HUB_ROUNDS):
        told = _of_components(long, found)
        if told.isEmpty():
            return found
        asked = told.join(_largest(told), "value").where("component <> big")
        more = cut(confirm(asked.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()))
        if more.isEmpty():
            break
        found = cut(found.unionByName(more))
    told = _of_components(long, found)
    if told.isEmpty():
        return found
    # whoever is outside the largest component meets all of the list, in slices of the list
    slices = F.greatest(F.lit(1), F.ceil(F.col("m") / SPLIT)).cast("int")
    outside = told.join(_largest(told), "value").where("component <> big").select(
        "value", F.col("class").alias("c"), F.col("component").alias("p"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    )
    whole = told.select("value", "class", "component", F.pmod(F.xxhash64("class"), slices).cast("int").alias("slice"))
    rest = (
        outside.join(whole, ["value", "slice"])
        .where("p <> component")
        .select(F.least("c", "class").alias("a"), F.greatest("c", "class").alias("b"))
        .distinct()
    )
    return found.unionByName(confirm(rest))


def record_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of records that read alike (``class, work, gate``) and their members (``class, record_id``).

    Of the rows that repeat a record_id, the one ingested last stands (ties: the greatest).
    Each record is parsed once; ``work`` is what it is compared by. Classes are numbered, so
    that no two works share a number, and written before the numbers are used.
    """
    latest = (
        records.where("record_id is not null")
        .groupBy("record_id")
        .agg(
            F.max(
                F.struct(
                    F.coalesce("ingested_at", F.lit("1000-01-01").cast("timestamp_ntz")).alias("at"),
                    known("title").alias("title"),
                    known("authors").alias("authors"),
                    F.col("publication_year").cast("int").alias("year"),
                    known("doi").alias("doi"),
                )
            ).alias("r")
        )
        .select("record_id", "r.title", "r.authors", "r.year", "r.doi")
    )
    # one shuffle brings records of a class together; the number of its first row is the class
    read = with_works(latest).select("record_id", "work", "gate").repartition("work").withColumn("at", F.monotonically_increasing_id())
    numbered = cut(read.withColumn("class", F.min("at").over(Window.partitionBy("work"))))
    return numbered.where("at = class").select("class", "work", "gate"), numbered.select("class", "record_id")


def _with(df: DataFrame, drop: tuple[str, ...], given: tuple[str, ...], make: Callable, added: str) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``added`` that ``make`` gives for the lists of the columns ``given``."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    names = [*(f.name for f in kept), *(c.split()[0] for c in added.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*(batch.column(c).to_pylist() for c in given))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{kinds}, {added}")


def with_works(df: DataFrame) -> DataFrame:
    """``df`` with what its ``title, authors, year, doi`` are compared by: ``work`` and its ``gate``."""

    def make(*fields: list) -> list[pa.Array]:
        read = [pub.record(*row) for row in zip(*fields)]
        return [pa.array(map(pub.pack, read), pa.string()), pa.array(map(pub.gate, read), pa.int64())]

    parts = ("title", "authors", "year", "doi")
    return _with(df, parts, parts, make, "work string, gate bigint")


def with_tokens(df: DataFrame) -> DataFrame:
    """``df`` with the ``tokens`` of its ``work``."""
    make = lambda works: [pa.array([pub.tokens(pub.unpack(w)) for w in works], pa.list_(pa.string()))]
    return _with(df, (), ("work",), make, "tokens array<string>")


def class_groups(classes: DataFrame) -> DataFrame:
    """``class, group`` of every class that some other class is a near-duplicate of."""
    drawn = cut(sketches(classes))
    flat = drawn.select("class", "gate", F.size("values").alias("size"), F.posexplode("values").alias("place", "value"))
    flat = flat.select("value", "class", F.col("gate").bitwiseOR((F.col("place") * 32 + F.col("size")).cast("bigint")).alias("meta")).repartition("value")
    # asking for what is never null keeps both sides alike, so the shuffle is made once
    counts = flat.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("c"), F.min("meta").alias("m"))
    sized = cut(flat.join(counts.where("n > 1 and c is not null and m is not null").select("value", "n"), "value"))
    told = lambda shift: F.shiftrightunsigned("meta", shift).bitwiseAND(31).cast("int")
    gate = F.col("meta").bitwiseAND(F.lit(-1 << pub.GATE_FREE))
    sized = sized.select("value", "class", "n", gate.alias("gate"), told(5).alias("place"), told(0).alias("size"))
    long = sized.where(F.col("n") > HOT).select("value", "class")
    confirm = lambda pairs: verify_pairs(cut(likely_of(pairs, drawn)), classes, pub.same_publication)
    if long.isEmpty():
        pairs = cut(short_pairs(sized, long.selectExpr("class", "0 as hot")).select("a", "b"))
        links = cut(verify_pairs(pairs, classes, pub.same_publication))
    else:
        hot = cut(long.groupBy("class").agg(F.count(F.lit(1)).cast("int").alias("hot")))
        finer = pair_lists(sized)
        n = finer.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        finer = cut(finer.join(n, "value"))
        again = finer.where(F.col("n") <= HOT_PAIRS)
        one, two = (again.select("value", F.col("class").alias(c), F.col("gate").alias(f"g{c}")) for c in "ab")
        met = one.join(two, "value").where("a < b").where(passes(F.col("ga"), F.col("gb"))).select("a", "b")
        short = cut(short_pairs(sized, hot))
        unsure = short.where("not sure").select("a", "b").unionByName(met).unionByName(bare_pairs(sized)).distinct()
        longest = cut(finer.where(F.col("n") > HOT_PAIRS).select("value", "class"))
        pairs = cut(short.where("sure").select("a", "b").unionByName(likely_of(unsure, drawn)))
        # what is not needed any more leaves the disk before records are brought together
        del flat, counts, sized, long, hot, finer, n, again, one, two, met, short, unsure
        if longest.isEmpty():
            del drawn, confirm
        links = cut(verify_pairs(pairs, classes, pub.same_publication))
        if not longest.isEmpty():
            links = cut(hot_links(longest, links, confirm))
    return connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("group"))


def near_records(records: DataFrame) -> DataFrame:
    """``record_id, group`` for every record that some other record is a near-duplicate of.

    Rows without record_id are left out; records with neither title nor DOI resemble
    nothing but their exact copies' class mates; empty titles count as missing; titles of
    any length are compared whole; ties of ranks are one value; repeated rows
    count once; an empty table gives an empty result; unknown columns are ignored.
    """
    classes, members = record_classes(records)
    telling = classes.where(~(F.col("work").startswith("[null,") & F.col("work").endswith(",null]"))).select("class")
    grouped = (
        members.join(telling, "class", "left_semi")
        .join(class_groups(classes), "class", "left")
        .select("record_id", F.coalesce("group", "class").alias("group"))
    )
    grouped = cut(grouped)
    shared = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return grouped.join(shared.select("group"), "group", "left_semi").select("record_id", "group")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of the same publication."""
    grouped = cut(near_records(table(spark, sf_dir, "master_records")))
    a = grouped.select("group", F.col("record_id").alias("record_id_a"))
    b = grouped.select("group", F.col("record_id").alias("record_id_b"))
    return a.join(b, "group").where("record_id_a < record_id_b").select("record_id_a", "record_id_b")


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a group of near-duplicates, with the least record_id of the group."""
    grouped = near_records(table(spark, sf_dir, "master_records"))
    return grouped.withColumn("group_id", F.min("record_id").over(Window.partitionBy("group"))).select("record_id", "group_id")
