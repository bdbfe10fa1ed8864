"""Review operators: modes, bindings, alerts, samples, reconciliation, containment."""

from pyspark.sql import functions as F

from acervo.operators import dedup, joins, keyword_network, review


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_modes_take_no_null_predicate(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "id int, ok boolean")
    got = review.modes(df, {"all": F.lit(True), "ok": F.col("ok")}).select("id", "mode")
    assert rows(got) == [(1, "all"), (1, "ok"), (2, "all")]
    assert review.modes(df.limit(0), {"all": F.lit(True)}).count() == 0


def test_labels_bind_by_fingerprint_then_by_descriptor_and_count(spark):
    kind = "topic string, descriptor string, n bigint, fingerprint bigint"
    topics = spark.createDataFrame([("a", "x", 3, 11), ("b", "y", 4, 12), ("c", "z", 5, 13), ("d", None, None, None)], kind)
    old = spark.createDataFrame([("a", "q", 9, 11, "A"), ("b", "y", 4, 99, "B"), ("c", "z", 6, 99, "C")], kind + ", label string")
    got = review.bind_labels(old, topics).select("topic", "bound", "label")
    assert rows(got.fillna("-")) == [("a", "fingerprint", "A"), ("b", "descriptor", "B"), ("c", "unbound", "-"), ("d", "unbound", "-")]


def test_fingerprints_of_sets_know_no_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "g int, k string")
    got = {r.g: r.f for r in df.groupBy("g").agg(review.set_fingerprint("k").alias("f")).collect()}
    assert got[1] == got[2] != got[3]


def test_issues_are_keys_that_do_not_add_up(spark):
    one = spark.createDataFrame([("a", 2), ("b", 3)], "k string, expected bigint")
    two = spark.createDataFrame([("a", 2), ("c", 1)], "k string, counted bigint")
    assert rows(review.accounting_issues(one, two, "k")) == [("b", 3, 0), ("c", 0, 1)]


def test_samples_carry_all_their_strata(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id int, n int")
    orders = {"most": [F.col("n").desc()], "least": [F.col("n")]}
    assert rows(review.multi_label_sample(df, "id", orders, 2)) == [(1, ["least"]), (2, ["least", "most"]), (3, ["most"])]
    assert review.strata_samples(df.limit(0), ["n"], "id", orders, 2).count() == 0


def test_a_margin_settles_the_best(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.9), ("b", 0.9), ("c", 0.2), ("d", None)], "g string, s double")
    got = review.best_with_margin(df, "g", "s").select("g", "status")
    assert rows(got) == [("a", "matched"), ("b", "ambiguous"), ("c", "none")]


def test_errors_are_not_missing(spark):
    cached = spark.createDataFrame([("a", "ok"), ("b", "error: x"), ("c", None)], "k string, s string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert rows(review.cache_states(cached, asked, "k", "s", "^error")) == [("a", "done"), ("b", "retry"), ("c", "done"), ("d", "missing")]


def test_a_needle_may_begin_and_end_inside_words(spark):
    t = spark.createDataFrame([(1, "notes on school leadership practice"), (2, "other notes"), (3, None)], "id int, t string")
    for needle, found in (("school lead", {1}), ("otes on school leader", {1}), ("leadership", {1}), ("ther", {2}), ("absent", set())):
        n = spark.createDataFrame([(needle,), (None,)], "n string")
        assert {r.id for r in joins.contained(t, F.col("t"), n, "n", 3).collect()} == found


def test_fuzzy_titles_are_those_of_brute_force(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(5)
    base = "la evaluacion interna de los internados en junnusur el equipo directivo con apoyo universitario"
    titles = [base]
    for _ in range(60):
        t = list(rng.choice(titles))
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("aeiou lnst")
        titles.append(" ".join("".join(t).split()))
    df = spark.createDataFrame([(f"{k:03}", t, 2020 + k % 2) for k, t in enumerate(titles)], "record_id string, title string, publication_year int")
    first = {}
    for k, t in enumerate(titles):
        first.setdefault((t, k % 2), f"{k:03}")
    want = {tuple(sorted((i, j))) for ((a, y), i), ((b, z), j) in itertools.combinations(first.items(), 2) if y == z and dedup.ratio(*((a, b) if i < j else (b, a))) >= 0.92}
    assert {(r.a, r.b) for r in dedup.fuzzy_titles(df).collect()} == want and len(want) > 50
    monkeypatch.setattr(dedup, "BAND_ROWS", 7)
    assert {(r.a, r.b) for r in dedup.fuzzy_titles(df).collect()} == want


def test_home_pages_identify_nothing(spark):
    df = spark.createDataFrame(
        [("1", "https://site.org/", "Ana Perez; Luis Diaz"), ("2", "https://site.org/handle/10/5", ""), ("3", "https://site.org/about", "Ana Perez; Luis Diaz"), ("4", "https://site.org/about", "")],
        "record_id string, url string, authors string",
    )
    for c in ("doi", "title", "abstract"):
        df = df.withColumn(c, F.lit(""))
    got = {r.record_id: r.k_url for r in dedup.with_keys(df.withColumn("publication_year", F.lit(2020))).collect()}
    assert got["1"] is None and got["4"] is None and got["2"] == "site.org/handle/10/5" and got["3"].startswith("site.org/about|")


def test_network_by_plain_jaccard(spark):
    k = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "z"), ("c", "w")], "record_id string, keyword string")
    got = keyword_network.network_edges(k, 0.5, 2, plain=True).select("source", "target", F.round("jaccard", 4))
    assert rows(got) == [("a", "b", 0.6667)]
