"""Identity resolution by exact and fuzzy keys with a guard against merging two DOIs."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import identifiers as I
from acervo.functions import text as T
from acervo.operators.components import connected_components
from acervo.runtime import cut

#: Most rounds in which a label travels from known DOIs to rows without one.
MOST_HOPS = 200
#: Prefix of the repository that gives each version of a deposit a DOI of its own, and links that name one item.
DEPOSITS = "10.5281/zenodo."
ITEM = r"^doi\.org/10\.|/(?:handle/|article/view/|records?/)\S"
FIELDS = ("doi", "title", "abstract", "keywords", "authors", "publication_year", "url", "pdf_url")


def with_keys(df: DataFrame) -> DataFrame:
    """Rows with the keys they are compared by.

    Versions of one deposit (same long title and authors) have one ``k_doi``. A link counts
    by itself where it names an item; a page of another kind only with its authors, and a
    home page not at all.
    """
    doi, names, title = I.doi_family("doi"), I.name_tokens("authors"), T.title_key("title", 400)
    deposit = F.startswith(doi, F.lit(DEPOSITS)) & (F.length(title) >= 20) & (F.size(names) >= 2)
    url = I.canonical_url("url")
    page = url.rlike(r"^[^/?]+/[^?]") & (F.size(names) >= 2)
    told = F.array_join(F.array_sort(names), " ")
    return (
        df.withColumn("k_doi", F.nullif(F.when(deposit, F.concat_ws("|", F.lit(DEPOSITS), title, told)).otherwise(doi), F.lit("")))
        .withColumn("k_url", F.when(url.rlike(ITEM), url).when(page, F.concat_ws("|", url, told)))
        .withColumn("k_title", F.nullif(title, F.lit("")))
        .withColumn("k_names", names)
        .withColumn("k_abstract", F.when(F.length(T.clean_value("abstract")) >= 350, F.md5(T.keep_accents("abstract"))))
        .withColumn("year", F.col("publication_year").cast("int"))
    )


def _compatible(a: str, b: str):
    x, y = F.col(f"{a}.k_names"), F.col(f"{b}.k_names")
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) >= 2) & (F.size(y) >= 2) & (within | (F.size(F.array_intersect(x, y)) >= 2))


def _star(df: DataFrame, key: str, phase: int, id_: str) -> DataFrame:
    """Links of rows that share an exact key to the least of them, rather than all pairs."""
    known = df.where(F.col(key).isNotNull()).select(key, id_)
    least = known.groupBy(key).agg(F.min(id_).alias("a"))
    return known.join(least, key).where(F.col("a") != F.col(id_)).select("a", F.col(id_).alias("b"), F.lit(phase).alias("phase"))


def title_links(keyed: DataFrame, id_: str = "record_id", years: int = 2) -> DataFrame:
    """Pairs under one title with compatible first authors and years at most ``years`` apart.

    Rows equal in title, names and year meet as one class; pairs are made between classes
    and returned between their least ids; the members of a class are linked to its least.
    """
    k = keyed.where("k_title is not null and length(k_title) >= 12").select(id_, "k_title", "k_names", "year", "k_doi")
    k = k.withColumn("class", F.md5(F.to_json(F.struct("k_title", F.array_sort("k_names").alias("n"), "year", "k_doi"))))
    reps = k.groupBy("class", "k_title").agg(F.min(id_).alias(id_), F.first("k_names").alias("k_names"), F.first("year").alias("year"), F.first("k_doi").alias("k_doi"))
    l, r = reps.alias("l"), reps.alias("r")
    near = F.col("l.year").isNull() | F.col("r.year").isNull() | (F.abs(F.col("l.year") - F.col("r.year")) <= years)
    clash = F.col("l.k_doi").isNotNull() & F.col("r.k_doi").isNotNull() & (F.col("l.k_doi") != F.col("r.k_doi"))
    pairs = l.join(r, (F.col("l.k_title") == F.col("r.k_title")) & (F.col(f"l.{id_}") < F.col(f"r.{id_}"))).where(
        near & ~clash & _compatible("l", "r")
    )
    across = pairs.select(F.col(f"l.{id_}").alias("a"), F.col(f"r.{id_}").alias("b"), F.lit(2).alias("phase"))
    told = k.where(F.size("k_names") >= 2)
    return across.unionByName(_star(told, "class", 2, id_))


def candidate_links(keyed: DataFrame, id_: str = "record_id") -> DataFrame:
    """``a, b, phase``: by DOI (0), link (1), title with people (2), long equal abstract (3)."""
    return (
        _star(keyed, "k_doi", 0, id_).unionByName(_star(keyed, "k_url", 1, id_))
        .unionByName(title_links(keyed, id_)).unionByName(_star(keyed, "k_abstract", 3, id_))
    )


def constrained_components(links: DataFrame, dois: DataFrame) -> DataFrame:
    """``node, component`` where no component holds two DOIs.

    Components that hold at most one DOI anyway are final. In the others every row without a
    DOI goes to the nearest row with one: links of the first phase are followed as far as
    they lead, then those of the next, and of DOIs equally near the least is taken. Rows that
    no DOI reaches keep together. The rule is the same for components of any size.
    ``links`` has ``a, b, phase``; ``dois`` has ``node, doi``.
    """
    links = links.where("a is not null and b is not null and a <> b").groupBy("a", "b").agg(F.min("phase").alias("phase"))
    links = cut(links)
    loose = cut(connected_components(links))
    held = loose.join(dois, "node", "left")
    n = held.groupBy("component").agg(F.min("doi").alias("lo"), F.max("doi").alias("hi"))
    mixed = cut(n.where("lo < hi").select("component"))
    final = loose.join(mixed, "component", "left_anti").select("node", "component")
    if mixed.isEmpty():
        return final
    inside = held.join(mixed, "component", "left_semi")
    known = cut(inside.where("doi is not null").select("node", F.col("doi").alias("anchor")))
    near = links.join(inside.select(F.col("node").alias("a")), "a", "left_semi")
    both = cut(near.select("a", "b", "phase").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "phase")))
    for phase in sorted(r[0] for r in links.select("phase").distinct().collect()):
        step = both.where(F.col("phase") <= phase)
        for _ in range(MOST_HOPS):
            open_ = step.join(known.select(F.col("node").alias("a")), "a", "left_anti")
            found = open_.join(known.select(F.col("node").alias("b"), "anchor"), "b").groupBy(F.col("a").alias("node")).agg(F.min("anchor").alias("anchor"))
            found = cut(found)
            if found.isEmpty():
                break
            known = cut(known.unionByName(found))
        else:
            raise RuntimeError(f"a row is more than {MOST_HOPS} links away from its DOI")
    part = known.join(loose, "node")
    anchored = part.join(part.groupBy("component", "anchor").agg(F.min("node").alias("first")), ["component", "anchor"]).select("node", F.col("first").alias("component"))
    lost = inside.select("node").join(known.select("node"), "node", "left_anti")
    apart = near.join(lost.withColumnRenamed("node", "a"), "a", "left_semi").join(lost.withColumnRenamed("node", "b"), "b", "left_semi")
    return final.unionByName(anchored).unionByName(connected_components(apart))


def survivors(df: DataFrame, parts: DataFrame, id_: str = "record_id") -> DataFrame:
    """``record_id, kept``: the row that stands for each component: with a real PDF, fullest, longest abstract."""
    pdf = T.clean_value("pdf_url")
    rank = F.struct(
        ((pdf != "") & ~F.contains(pdf, F.lit("doi.org/"))).cast("int").alias("pdf"),
        sum(((T.clean_value(c) != "").cast("int") for c in FIELDS), F.lit(0)).alias("filled"),
        F.length(T.clean_value("abstract")).alias("abstract"),
        F.length(T.clean_value("keywords")).alias("keywords"),
    )
    r = df.select(F.col(id_), rank.alias("rank")).groupBy(id_).agg(F.max("rank").alias("rank"))
    r = r.join(parts.withColumnRenamed("node", id_), id_, "left").withColumn("component", F.coalesce("component", id_))
    w = Window.partitionBy("component").orderBy(F.col("rank").desc(), id_)
    return r.select(id_, F.first(id_).over(w).alias("kept"))


def merged(df: DataFrame, kept: DataFrame, id_: str = "record_id") -> DataFrame:
    """One row per surviving record: its own values, blanks filled from the others, lists united."""
    rows = df.dropDuplicates([id_]).join(kept, id_)
    lists = ("source", "search_term", "origin")
    plain = [c for c in df.columns if c not in (*lists, id_)]
    own = F.col(id_) == F.col("kept")

    def first_known(c: str):
        v = F.when(T.clean_value(c) != "", F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c)
        return F.min_by(v, F.when(v.isNotNull(), F.struct((~own).cast("int").alias("far"), F.col(id_).alias("id")))).alias(c)

    def united(c: str):
        parts = F.flatten(F.collect_set(F.split(F.coalesce(c, F.lit("")), r"\|")))
        return F.array_join(F.array_sort(F.filter(F.array_distinct(F.transform(parts, F.trim)), lambda x: x != "")), "|").alias(c)

    return rows.groupBy("kept").agg(*[first_known(c) for c in plain], *[united(c) for c in lists if c in df.columns]).withColumnRenamed("kept", id_)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


#: Distinct titles of one year and length band that one task compares with as many others.
BAND_ROWS = 2_000


def _letters(texts: list[str]) -> np.ndarray:
    """How often each sign of the texts' common alphabet (a-z, 0-9, blank) occurs in each."""
    out = np.zeros((len(texts), 37), dtype=np.int16)
    for row, t in enumerate(texts):
        code = np.frombuffer(t.encode("ascii", "replace"), dtype=np.uint8)
        at = np.where(code >= 97, code - 97, np.where(code >= 48, code - 48 + 26, 36))
        out[row] = np.bincount(at, minlength=37)[:37]
    return out


def fuzzy_titles(df: DataFrame, least: float = 0.92, id_: str = "record_id") -> DataFrame:
    """``a, b, ratio``: all pairs of different titles of one year whose gestalt ratio is ``least`` or more.

    Titles are compared within a year with those of their band of lengths and the next one, which no
    such pair leaves; of those, only pairs whose letters in common could give the ratio
    are matched. Equal titles are one class, and bands of many titles are cut into blocks
    that meet one another, so a task holds ``BAND_ROWS`` titles of either side.
    """
    k = df.select(id_, T.ascii_key("title").alias("t"), F.col("publication_year").cast("int").alias("y")).where("length(t) >= 12 and y is not null")
    reps = k.groupBy("t", "y").agg(F.min(id_).alias("id"))
    width = math.log((2 - least) / least) * (1 + 1e-9)
    reps = cut(reps.withColumn("band", F.floor(F.log(F.length("t")) / width).cast("int")))
    top = reps.groupBy("y", "band").agg(F.count(F.lit(1)).alias("n"))
    # of a band and the next above it, the larger one says into how many blocks both are cut
    blocks = (
        top.unionAll(top.select("y", F.col("band") - 1, "n")).groupBy("y", "band")
        .agg(F.ceil(F.max("n") / BAND_ROWS).cast("int").alias("blocks"))
    )
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = reps.join(blocks, ["y", "band"]).withColumn("i", part).withColumn("j", every)
    above = reps.unionByName(reps.withColumn("band", F.col("band") - 1))
    right = above.join(blocks, ["y", "band"]).withColumn("j", part).withColumn("i", every)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        a, x = one.column("l_id").to_pylist(), one.column("l_t").to_pylist()
        b, z = two.column("r_id").to_pylist(), two.column("r_t").to_pylist()
        out: list[tuple[str, str, float]] = []
        if a and b:
            theirs, lengths = _letters(z), np.array([len(t) for t in z])
            same_band = np.array(two.column("r_len").to_pylist())
            for p, t, mine in zip(a, x, _letters(x)):
                shared = np.minimum(theirs, mine).sum(axis=1)
                for k in np.flatnonzero(2 * shared >= least * (lengths + len(t)) - 1e-9).tolist():
                    # within a band both orders meet
                    if p == b[k] or same_band[k] and p > b[k]:
                        continue
                    u, v = (t, z[k]) if p < b[k] else (z[k], t)
                    r = ratio(u, v)
                    if r >= least:
                        out.append((min(p, b[k]), max(p, b[k]), r))
        kinds = (pa.string(), pa.string(), pa.float64())
        return pa.Table.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)], names=["a", "b", "ratio"])

    keys = ("y", "band", "i", "j")
    theirs = right.withColumn("len", F.floor(F.log(F.length("t")) / width).cast("int") == F.col("band"))
    mine = left.select(*(F.col(c).alias(f"l_{c}") for c in keys), F.col("id").alias("l_id"), F.col("t").alias("l_t"))
    theirs = theirs.select(*(F.col(c).alias(f"r_{c}") for c in keys), F.col("id").alias("r_id"), F.col("t").alias("r_t"), F.col("len").alias("r_len"))
    met = mine.groupBy(*(f"l_{c}" for c in keys)).cogroup(theirs.groupBy(*(f"r_{c}" for c in keys)))
    return met.applyInArrow(run, "a string, b string, ratio double")
