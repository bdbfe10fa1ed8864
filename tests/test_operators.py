import json

import pytest
from pyspark.sql import functions as F

from acervo.functions import arrow, identifiers, text, vectors
from acervo.operators import classify, dedup, joins, keyword_network, neighbours, records, retrieval, sampling, stability
from acervo.operators.components import connected_components
from acervo.sources import files, harvest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()[0]


def test_components_of_chains_stars_loops_and_nothing(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7), (500, 500), (None, 3)], "a int, b int")
    got = dict(rows(connected_components(e)))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[500] == 500
    assert connected_components(e.limit(0)).count() == 0


def test_no_component_holds_two_dois(spark):
    links = spark.createDataFrame([("a", "b", 0), ("b", "c", 2), ("c", "d", 0), ("x", "y", 1)], "a string, b string, phase int")
    dois = spark.createDataFrame([("a", "10.1/a"), ("d", "10.1/d")], "node string, doi string")
    got = dict(rows(dedup.constrained_components(links, dois)))
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["a"] != got["d"] and got["x"] == got["y"]
    assert got["a"] == "a" and got["c"] == "c"


def test_merge_fills_blanks_and_unites_lists(spark):
    r = spark.createDataFrame([("1", "", "A|B", "t"), ("2", "10.1/x", "B|C", "u")], "record_id string, doi string, source string, title string")
    kept = spark.createDataFrame([("1", "1"), ("2", "1")], "record_id string, kept string")
    got = dedup.merged(r, kept).first()
    assert (got["record_id"], got["doi"], got["source"], got["title"]) == ("1", "10.1/x", "A|B|C", "t")


def test_fuzzy_titles_meet_in_spite_of_one_changed_word(spark):
    r = spark.createDataFrame(
        [("1", "School leadership in rural schools of the north", 2020), ("2", "School leadership in rurall schools of the north", 2020), ("3", "Something else entirely in another year", 2020)],
        "record_id string, title string, publication_year int",
    )
    assert [x[:2] for x in rows(dedup.fuzzy_titles(r))] == [("1", "2")]


def test_keyword_network_weight(spark):
    k = spark.createDataFrame([("a", x) for x in ("alpha", "beta", "gamma")] + [("b", "alpha"), ("b", "beta"), ("c", "alpha"), ("c", "delta")], "record_id string, keyword string")
    from math import log

    got = keyword_network.network_edges(k, 0.2).first()
    assert (got["source"], got["target"], got["shared_count"]) == ("a", "b", 2)
    assert got["weight"] == pytest.approx((2 + log(4 / 3)) / (3 + log(4 / 3) + log(2)))
    same = spark.createDataFrame([(f"r{i:02}", x) for i in range(42) for x in ("alpha", "beta")], "record_id string, keyword string")
    assert keyword_network.network_edges(same, 0.2).count() == 861


def test_nearest_is_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.8, 0.6]), (4, None)], "vec_id bigint, embedding array<double>")
    assert rows(neighbours.mutual(v, v, 1, 0.7).select("query", "neighbour")) == [(1, 2), (2, 1)]
    assert neighbours.nearest(v.limit(0), v, 3).count() == 0


def test_combine_gives_unit_vectors_of_what_is_there(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], None)], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.combine([(F.col("a"), 0.5), (F.col("b"), 0.5)])).collect()]
    assert got[0] == pytest.approx([2**-0.5, 2**-0.5]) and got[1] == pytest.approx([1.0, 0.0])


def test_fallback_reports_ambiguity(spark):
    left = spark.createDataFrame([(1, "d1", "t"), (2, "", "u"), (3, "", "w")], "id int, doi string, title string")
    right = spark.createDataFrame([("r1", "d1", "x"), ("r2", "", "u"), ("r3", "", "u")], "rid string, doi string, title string")
    got = rows(joins.fallback(left, right, [("doi", "doi"), ("title", "title")], "rid", "id"))
    assert got == [(1, "r1", "matched", "doi"), (2, None, "ambiguous", "title"), (3, None, "standalone", "")]


def test_validated_join_fails_on_a_missing_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    assert joins.validated(a, a.select("k", F.col("a").alias("b")), "k").count() == 2
    with pytest.raises(Exception):
        joins.validated(a, a.limit(1).select("k", F.col("a").alias("b")), "k").collect()


def test_overrides_and_containment(spark):
    df = spark.createDataFrame([("1", "low"), ("2", "low")], "record_id string, status string")
    d = spark.createDataFrame([("2", "high")], "record_id string, decision string")
    assert rows(joins.overrides(df, d, "record_id", "status")) == [("1", "low"), ("2", "high")]
    t = spark.createDataFrame([("1", "a long title about school leadership today")], "id string, t string")
    n = spark.createDataFrame([("about school leadership",)], "n string")
    assert joins.contained(t, F.col("t"), n, "n", 10).count() == 1


def test_names_identify(spark):
    x = identifiers.authors_compatible(F.col("a"), F.col("b"))
    assert one(spark, x, a="Pérez, Ana", b="Ana Pérez") and not one(spark, x, a="Pérez, Ana", b="Ana Gómez")
    assert one(spark, identifiers.doi("a"), a="https://doi.org/10.1234/ABC.") == "10.1234/abc"
    assert one(spark, identifiers.canonical_url("a"), a="HTTP://www.X.org:80/p%20q/?utm_source=z&b=2&a=1") == "x.org/p q?a=1&b=2"
    assert one(spark, identifiers.stable_id(*[F.col(c) for c in "abcde"]), a="", b="", c="", d="", e="") is None


def test_text_functions(spark):
    assert one(spark, text.norm("a"), a="Gestión  ESCOLAR—número_1!") == "gestion escolar numero_1"
    assert one(spark, text.drop_phrases(F.col("a"), ["b c"]), a="a b c x b c d") == "a x d"
    assert one(spark, text.near_hit(F.col("a"), ["x"], ["y"], 2), a="x b y") and not one(spark, text.near_hit(F.col("a"), ["x"], ["y"], 1), a="x b y")
    assert one(spark, text.without_header(F.col("a"), F.col("b")), a="A long enough repeated title line\nBody.", b="A long enough repeated title line") == "Body."
    assert one(spark, text.highlight("a", "educacion"), a="La Educación") == "La <mark>Educación</mark>"
    assert one(spark, text.pages(F.col("a"), F.col("b")), a="3", b="9") == "3-9"
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(text.from_inverted(F.col("m"))).first()[0] == "a b a"


def test_parsers():
    assert arrow.unicode_form("caf&eacute; “x”\u0007") == 'café "x"'
    assert arrow.without_sources("a" * 50 + "\nReferences\nx") == "a" * 50
    assert arrow.without_sources("References\n" + "a" * 50) == "References\n" + "a" * 50
    assert arrow.sections("Intro text\n1. Introduction\nA\nMethods:\nB") == {"front": "Intro text", "introduction": "A", "methods": "B"}
    assert arrow.invert_name("Ana María de la Cruz") == "de la Cruz, A. M."
    assert arrow.cite_people("Ana Silva; Luis Pérez") == "Silva, A., & Pérez, L."
    assert arrow.cite_people(";".join(f"A N{i}" for i in range(25))).count("…") == 1
    got = arrow.parse_reference("- Silva, A. (2020). **A title**. https://doi.org/10.1234/x")
    assert (got["year"], got["title"], got["doi"]) == ("2020", "A title", "10.1234/x")
    assert arrow.sections(None) == {} and arrow.unicode_form(None) is None


def test_rules_and_samples(spark):
    df = spark.createDataFrame([("School leadership today", None), ("Other", "leadership")], "title string, abstract string")
    got = classify.scores(df, [classify.Rule("r", ("leadership",), {"title": 3, "abstract": 1})])
    assert [r["score"] for r in got.collect()] == [3, 1]
    s = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(100)], "id int, g string")
    assert rows(sampling.stratified(s, "g", "id", {"a": 3, "b": 5}).groupBy("g").count()) == [("a", 3), ("b", 5)]
    assert sampling.round_robin(s, "g", "id", 6).where("g = 'a'").count() == 3


def test_retrieval(spark):
    df = spark.createDataFrame([(1, "Alpha beta\n\nbeta beta"), (2, "alpha")], "id int, t string")
    r = retrieval.index_rows(df, "id", "t")
    assert rows(retrieval.holding_all(r, "id", ["alpha", "beta"])) == [(1,)]
    assert {t: d for t, _, d in rows(retrieval.postings(r, "id"))} == {"alpha": [1, 2], "beta": [1]}
    assert rows(retrieval.postings(r, "id", chunk=2))[0] == ("alpha", 0, [1])
    assert rows(retrieval.best_part(df, "id", "t", ["beta"])) == [(1, 1, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"x\ny"\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string, extra string").collect()
    assert [tuple(r) for r in got] == [(1, "x\ny", None)]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), "id int").count() == 0
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.js").write_text('window.D = {"n": 3};')
    (tmp_path / "j" / "y.js").write_text("broken")
    assert [r["json"]["n"] for r in files.read_json(spark, str(tmp_path / "j"), "n int", after="window.D").where("json.n is not null").collect()] == [3]
    path = str(tmp_path / "t")
    files.append(spark.createDataFrame([(1, "a")], "id int, v string"), path, "id")
    files.append(spark.createDataFrame([(1, "z"), (2, "b")], "id int, v string"), path, "id")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    cells = spark.createDataFrame([(1, ["Title", "Year"]), (2, ["A", "2000"]), (3, ["Year", "Title"]), (4, ["2001", "B"])], "n int, cells array<string>")
    got = files.rehead(cells, "n", F.lower(F.col("cells")[0]).isin("title", "year"), {"title": ["title"], "year": ["year"]})
    assert rows(got) == [(2, "A", "2000"), (4, "B", "2001")]
    cfg = tmp_path / "c.json"
    cfg.write_text('{"a": {"b": 1}}')
    assert files.load_config(str(cfg), ["a.b=2", "c=x"]) == {"a": {"b": 2}, "c": "x"}


def test_harvest_pages_and_oai(spark, tmp_path):
    work = {"id": "https://x/W1", "display_name": "T", "publication_year": 2021, "publication_date": "2021-02-03", "authorships": [{"author": {"display_name": "Ana Silva"}}], "abstract_inverted_index": {"b": [1], "a": [0]}}
    old = {**work, "id": "https://x/W0", "publication_date": "1999-01-01"}
    (tmp_path / "q-0.json").write_text(json.dumps({"results": [work, old], "meta": {"next_cursor": "c"}}))
    (tmp_path / "q-1.json").write_text(json.dumps({"results": [], "meta": {}}))
    harvest.register(spark)
    works = spark.read.format("acervo_works").option("query", "q").option("pages", str(tmp_path)).option("since", "2020-01-01").load()
    got = harvest.records_of_works(works).collect()
    assert [(r["record_id"], r["authors"], r["abstract"], r["origin"]) for r in got] == [("W1", "Ana Silva", "a b", "unknown")]
    xml = """<OAI><record><header><identifier>oai:1</identifier></header><metadata><dc:title>School leadership</dc:title><dc:date>2021-01-01</dc:date></metadata></record>
    <record><header status="deleted"><identifier>oai:2</identifier></header></record></OAI>"""
    pages = spark.createDataFrame([(xml,)], "xml string")
    assert [r["record_id"] for r in harvest.records_of_oai(pages, ["leadership"]).collect()] == ["oai:1"]
    atom = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/"><entry><title>Rural schools</title>
    <author><name>Silva, Ana</name></author><published>2022-05-01</published><dc:type>Article</dc:type><link href="https://r.org/handle/11.2/33"/>
    <link href="https://r.org/x.PDF"/><dc:identifier>doi:10.1234/abc</dc:identifier></entry></feed>"""
    got = harvest.records_of_atom(spark.createDataFrame([(atom,)], "xml string"), ["article"], "repo:").first()
    assert (got["record_id"], got["doi"], got["pdf_url"], got["publication_year"]) == ("repo:11.2/33", "10.1234/abc", "https://r.org/x.PDF", 2022)
    kv = spark.createDataFrame([(1, "k", "b"), (1, "k", "a"), (1, "z", "c")], "id int, key string, value string")
    assert harvest.key_values(kv, "id", "key", "value").first()["values"] == {"k": "a|b", "z": "c"}


def test_stability_and_assignment(spark):
    o = spark.createDataFrame([("a", "x", 5), ("a", "y", 4), ("b", "x", 4), ("c", "z", 1)], "left string, right string, overlap int")
    assert stability.assign(o) == [("a", "y", 4.0), ("b", "x", 4.0), ("c", "z", 1.0)]
    assert stability.assign(o.limit(0)) == []
    runs = spark.createDataFrame([(42, 42, 1.0), (42, 117, 0.2), (42, 233, 0.4)], "base_seed int, seed int, ari double")
    got = stability.run_summary(runs, ["ari"]).first()
    assert got["runs"] == 2 and got["mean_ari"] == pytest.approx(0.3)
    r = stability.ranked_by(spark.createDataFrame([(i, i % 7) for i in range(50)], "id int, s int"), "s", "id")
    assert [x["rank"] for x in r.orderBy(F.col("s").desc(), "id").collect()] == list(range(1, 51))


def test_fills_corrections_and_carry_over(spark):
    df = spark.createDataFrame([("1", "", 2000), ("2", "x", 2001)], "record_id string, doi string, year int")
    s = spark.createDataFrame([("1", "d1"), ("2", "d2")], "record_id string, doi string")
    got = records.fill(df, s, "record_id", ["doi"])
    assert rows(got) == [("1", "d1", 2000, ["doi"]), ("2", "x", 2001, [])]
    assert rows(records.fill(got.drop("changed"), s, "record_id", ["doi"]).select("changed")) == [([],), ([],)]
    c = spark.createDataFrame([("1", "year", "1999", "http://e"), ("2", "year", "1998", ""), ("2", "doi", "z", "http://e")], "record_id string, field string, value string, evidence string")
    assert rows(records.corrected(df, c, "record_id", ["year"])) == [("1", "", 1999), ("2", "x", 2001)]
    old = spark.createDataFrame([("1", "yes")], "record_id string, decision string")
    new = spark.createDataFrame([("1", ""), ("3", "")], "record_id string, decision string")
    assert rows(records.carried_over(new, old, "record_id", ["decision"])) == [("1", "yes"), ("3", "")]


def test_fetch_retries():
    import io
    import urllib.error

    calls = []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return io.BytesIO(b"ok")

    assert harvest.fetch("http://x", wait=0, opener=opener) == "ok" and len(calls) == 3
