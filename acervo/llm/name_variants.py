"""Variant spellings of names: blocks by letters, Jaro-Winkler with nicknames, components.

A name is read into family words (particles and hyphens aside), given names in full form,
and for organisations a head and its own words. Names that read alike are one node. A
comma tells the family words; without one a name is read in either order. Nodes are
blocked by the first letter of the given name with the letters of the first family word, and of
all family words, over all readings of the tokens in order, and by these with any one letter left
out, so one slip still meets; two names that are both turned do not. Pairs of a block are compared by Jaro-Winkler word by word with
the nickname table; of names in opposite orders all words must agree in full. Accepted
pairs are clustered by connected components.

Words that agree are one slip apart at most, so they share their letters or these with one left
out. In a block of more than ``HOT`` nodes only those meet that share such codes of the given
names and of the second family words, while names with an initial, or with one family word, meet
whatever these leave open. That leaves out no pair that agrees: ``HOT`` changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.names import GIVEN_NAMES, NICKNAMES, ORGANISATION_HEADS, PARTICLES, is_organisation, looks_given, plain
from acervo.llm.publication import _WORD, near, slips
from acervo.operators.components import connected_components
from acervo.operators.packed_values import split_packed
from acervo.runtime import cut, table

HOT = 200
#: Least Jaro-Winkler similarity of family words, and of given names.
FAMILY_LEAST = 0.88
GIVEN_LEAST = 0.84

#: One form for the heads of organisations in several languages.
HEADS = {
    "centro": "centro", "ctro": "centro", "centre": "centro", "center": "centro",
    "instituto": "instituto", "institute": "instituto", "institut": "instituto", "inst": "instituto",
    "grupo": "grupo", "group": "grupo", "groupe": "grupo", "gr": "grupo",
    "observatorio": "observatorio", "observatory": "observatorio", "observatoire": "observatorio", "obs": "observatorio",
}
#: Beginnings of words that say what an organisation is for, not which it is.
TOPICS = (
    "curric eval assess gest manage educ estud stud escol school escuel esc infan child territ investig research "
    "pedag ensen ensin teach learn form train lider leader polit polic desarr develop nacional national"
).split()
#: Small words of organisation names.
SMALL = PARTICLES | frozenset("for of on and the sobre para in en et des du".split())


class Name(NamedTuple):
    group: bool
    head: str
    family: tuple[str, ...]
    given: tuple[str, ...]


def _topic(word: str) -> bool:
    return any(word.startswith(t) or len(word) >= 3 and t.startswith(word) for t in TOPICS)


@lru_cache(maxsize=20_000)
def given_form(word: str) -> str:
    """The full form of a given name: nickname table, then the one name a slip away."""
    if len(word) == 1:
        return word
    if word in NICKNAMES:
        return NICKNAMES[word][0]
    if word in GIVEN_NAMES:
        return word
    close = _close(word)
    return close[0] if len(close) == 1 and len(word) > 3 else word


@lru_cache(maxsize=20_000)
def _close(word: str) -> tuple[str, ...]:
    """Full given names one slip away."""
    near_ones = (g for g in GIVEN_NAMES if g[0] == word[0] and abs(len(g) - len(word)) <= 1 and slips(word, g, 1) <= 1)
    return tuple(sorted({NICKNAMES.get(g, (g,))[0] for g in near_ones}))


@lru_cache(maxsize=30_000)
def read(name: str) -> Name:
    """The parts of a typed name."""
    if is_organisation(name):
        words = [w for w in _WORD.findall(plain(name)) if w not in SMALL]
        head = next((HEADS.get(w, w) for w in words if w in ORGANISATION_HEADS and w not in ("school", "escuela")), "")
        own = [w for w in words if HEADS.get(w, w) != head and not _topic(w)]
        return Name(True, head, tuple(own or words), ())
    if "," in name:
        family, given = name.split(",", 1)
    else:
        words = name.split()
        k = 0
        while k < len(words) - 1 and looks_given(words[k]):
            k += 1
        k = max(k, 1) if len(words) > 1 else 0
        given, family = " ".join(words[:k]), " ".join(words[k:])
    return Name(
        False,
        "",
        tuple(w for w in _WORD.findall(plain(family)) if w not in PARTICLES),
        tuple(given_form(w) for w in _WORD.findall(plain(given))),
    )


def letters(word: str) -> list[str]:
    """A word, and it with any one letter left out; words one slip apart share one of these."""
    # a slip in fewer letters is another word
    return sorted({word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 3 else set()))


@lru_cache(maxsize=30_000)
def turned(name: str) -> tuple[Name, ...]:
    """The readings of a name without a comma that puts the family words first."""
    words = name.split()
    if "," in name or len(words) < 2 or is_organisation(name):
        return ()
    found = (read(f"{' '.join(words[:k])}, {' '.join(words[k:])}") for k in {1, len(words) - 1})
    return tuple(n for n in found if n.family and n.given and len(n.given[0]) > 1)


def block_keys(name: str) -> list[str]:
    """Codes under which a name meets its variants."""
    return sorted(_keys(read(name)).union(*map(_keys, turned(name))))


def _keys(n: Name) -> set[str]:
    if not n.family:
        return set()
    first = n.head if n.group else (n.given[0][0] if n.given else "")
    words = {"".join(n.family)} if n.group else {"".join(n.family), n.family[0]}
    return {f"{first}|{c}" for w in words for c in letters(w)}


@lru_cache(maxsize=60_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    front = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        front += 1
    return jaro + 0.1 * front * (1 - jaro)


def _alike(a: str, b: str, least: float) -> bool:
    """Equal, or similar and one slip apart: two slips meet through the spelling between them."""
    return a == b or jaro_winkler(a, b) >= least and near(a, b) and slips(a, b, 1) <= 1


def _givens(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    return a == b or _alike(a, b, GIVEN_LEAST) or min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))


def same_name(a: Name, b: Name) -> bool:
    """Whether two names can be spellings of one person or organisation."""
    if a.group != b.group or not a.family or not b.family:
        return False
    if a.group:
        x, y = "".join(a.family), "".join(b.family)
        return a.head == b.head and _alike(x, y, FAMILY_LEAST)
    if not a.given or not b.given or not _givens(a.given[0], b.given[0]):
        return False
    if len(a.given) > 1 and len(b.given) > 1 and not _givens(a.given[1], b.given[1]):
        return False
    if _alike("".join(a.family), "".join(b.family), FAMILY_LEAST):
        return True
    if not _alike(a.family[0], b.family[0], FAMILY_LEAST):
        return False
    return len(a.family) < 2 or len(b.family) < 2 or _alike(a.family[1], b.family[1], FAMILY_LEAST)


def same_spelling(x: str, y: str) -> bool:
    """Whether two typed names agree, in the same or in opposite orders."""
    a, b = read(x), read(y)
    if same_name(a, b):
        return True
    return any(_all_agree(a, t) for t in turned(y)) or any(_all_agree(t, b) for t in turned(x))


def _all_agree(a: Name, b: Name) -> bool:
    if a.group or b.group or len(a.family) != len(b.family) or len(a.given) != len(b.given):
        return False
    full = all(len(g) > 1 for g in (*a.given, *b.given))
    return full and all(_alike(p, q, GIVEN_LEAST) for p, q in zip(a.given, b.given)) and all(_alike(p, q, FAMILY_LEAST) for p, q in zip(a.family, b.family))


def _reading(names: DataFrame) -> DataFrame:
    """``name, reading, keys, turned_keys, given, given_codes, second_codes`` of every name with a family word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for name in batch.column(0).to_pylist():
                n = read(name)
                keys = _keys(n)
                opposite = set().union(*map(_keys, turned(name))) - keys
                if not keys | opposite:
                    continue
                full = n.given[0] if n.given and len(n.given[0]) > 1 else ""
                vague = full and full not in GIVEN_NAMES and len(_close(full)) > 1
                # in opposite order the given name is another token
                readings = [r for r in (n, *turned(name)) if r.family]
                given = {r.given[0] for r in readings if r.given and len(r.given[0]) > 1}
                second = set()
                if all(r.group or len(r.family) > 1 for r in readings):
                    second = {f"={c}" for r in readings for c in letters("".join(r.family))} | {c for r in readings if not r.group for c in letters(r.family[1])}
                row = (
                    name,
                    "|".join((n.head, " ".join(n.family), " ".join(n.given))),
                    *([xxhash.xxh64_intdigest(k) - (1 << 63) for k in sorted(ks)] for ks in (keys, opposite)),
                    f"?{full}" if vague else full,  # a slip that fits several names
                    sorted({c for g in given for c in (*letters(g), f"<{g[:3]}")}) if full else [],
                    sorted(second),
                )
                for c, v in zip(cols, row):
                    c.append(v)
            text, texts, hashes = pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (text, text, hashes, hashes, text, texts, texts))],
                names=["name", "reading", "keys", "turned_keys", "given", "given_codes", "second_codes"],
            )

    return names.mapInArrow(
        run, "name string, reading string, keys array<bigint>, turned_keys array<bigint>, given string, given_codes array<string>, second_codes array<string>"
    )


def _meet(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """``a, b``: different names of ``left`` and ``right`` that agree in ``on``, not both of them turned."""
    side = lambda df, name: df.select(*on, F.col("name").alias(name), F.col("opposite").alias(f"{name}_turned"))
    met = side(left.where(~F.col("opposite")), "c").join(side(right, "d"), list(on))
    if left is right:
        # the other way round gives the same pairs
        met = met.where("d_turned or c < d")
    else:
        met = met.unionAll(side(left.where("opposite"), "c").join(side(right.where(~F.col("opposite")), "d"), list(on)))
    met = met.where("c <> d")
    return met.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))


def _long_block_pairs(hot: DataFrame) -> DataFrame:
    """``a, b``: pairs of long blocks (``key, name, opposite, given_codes, second_codes``) that can agree.

    A list of codes is empty where a name leaves the word open; it then meets all.
    """
    full, double = F.size("given_codes") > 0, F.size("second_codes") > 0
    by = {"g": F.explode("given_codes").alias("g"), "s": F.explode("second_codes").alias("s")}

    def meet(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        def side(df: DataFrame) -> DataFrame:
            for k in on:
                df = df.select("*", by[k])
            return df.select("key", "name", "opposite", *on)

        return _meet(side(left), side(right), "key", *on)

    known_all, no_second, initial = hot.where(full & double), hot.where(full & ~double), hot.where(~full)
    return (
        meet(known_all, known_all, "g", "s")
        .unionAll(meet(no_second, hot.where(full), "g"))
        .unionAll(meet(initial.where(double), hot.where(double), "s"))
        .unionAll(meet(initial.where(double), hot.where(~double)))
        .unionAll(meet(initial.where(~double), hot))
    )


def _accept(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                same_spelling(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a string, b string")


def name_links(names: DataFrame) -> DataFrame:
    """``a, b``: links between spellings of one entity; ``names`` has one column, ``name``."""
    rows = cut(_reading(names))
    rows = rows.join(rows.groupBy("reading").agg(F.min("name").alias("node")), "reading")
    alike = rows.where("name <> node").select(F.col("node").alias("a"), F.col("name").alias("b"))
    nodes = cut(rows.where("name = node").drop("node", "reading"))
    keys = lambda c, opposite: nodes.select("name", F.explode(c).alias("key"), F.lit(opposite).alias("opposite"))
    blocks = keys("keys", False).unionAll(keys("turned_keys", True))
    counts = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.every("opposite").alias("none")).where("n > 1 and not none")
    sized = cut(blocks.join(counts.drop("none"), "key"))
    small = sized.where(F.col("n") <= HOT).select("name", "key", "opposite")
    met = _meet(small, small, "key")
    hot = sized.where(F.col("n") > HOT).join(nodes.select("name", "given_codes", "second_codes"), "name")
    if not hot.isEmpty():
        met = met.unionAll(_long_block_pairs(hot))
    met = met.distinct()
    accepted = cut(_accept(met))
    # an initial that fits several given names tells nothing
    given = nodes.select("name", "given")
    both = accepted.select("a", "b").unionAll(accepted.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bare = given.where("given = ''").select(F.col("name").alias("a"))
    fits = (
        both.join(bare, "a", "left_semi")
        .join(given.where("given <> '' and given not like '?%'").withColumnRenamed("name", "b"), "b")
        .groupBy("a")
        .agg(F.countDistinct("given").alias("n"))
        .where("n > 1")
        .select(F.col("a").alias("vague"))
    )
    clear = accepted.join(fits, accepted["a"] == fits["vague"], "left_anti").join(
        fits, accepted["b"] == fits["vague"], "left_anti"
    )
    return alike.unionAll(clear)


def name_clusters(records: DataFrame, key: str = "record_id", field: str = "authors") -> DataFrame:
    """``name, cluster`` for every author name that has another spelling.

    Names are split by the packed-values grammar. Null, blank and null-token fields give no
    names; a name without a family word links to nothing; repeated rows count once; equal
    names typed apart are one; ties choose the least spelling as the cluster; an empty
    table gives an empty result; other columns are ignored.
    """
    names = (
        split_packed(records.select(key, field).where(F.col(field).isNotNull()).dropDuplicates([field]), key, {field: True})
        .select(F.col("item_value").alias("name"))
        .distinct()
    )
    found = connected_components(name_links(names))
    return found.select(F.col("node").alias("name"), F.col("component").alias("cluster"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different author names of the same person or organisation."""
    clusters = cut(name_clusters(table(spark, sf_dir, "master_records")))
    a = clusters.select("cluster", F.col("name").alias("name_a"))
    b = clusters.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with another spelling, and the least spelling of its cluster."""
    return name_clusters(table(spark, sf_dir, "master_records"))
