"""Problems 1, 4 and 7: names, candidates and near-duplicate records."""

import itertools
import math
import random

import pyarrow as pa

from acervo.llm import entity_match, name_variants, near_records
from acervo.llm import publication as pub

TITLE = "School leadership in rural schools of Puerto Solchavedo: a case study"
PEOPLE = "Silvorodor, Ana; Pradopumar, Luis"


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group"], set()).add(r["record_id"])
    return sorted(map(sorted, out.values()))


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_spellings_of_one_person_are_linked(records):
    spellings = [
        "Silvorodor Bandatal, Alejandro Luis", "Alejandro Silvorodor", "Silvorodor, A.", "SILVORODOR, Ale",
        "Alejadro Silvorodor Bandatal", "Silvorodro, Alejandro", "alejandro luis silvorodor-bandatal",
    ]
    other = ["Silvorodor, Beatriz", "Bea Silvorodor", "Pradopumar, Alejandro"]
    df = records({"record_id": "1", "authors": "; ".join(spellings)}, {"record_id": "2", "authors": "; ".join(other)})
    assert clusters(name_variants.name_clusters(df)) == sorted([sorted(spellings), sorted(other[:2])])


def test_names_in_either_order_are_linked(records):
    pairs = [("Juan Garcia", "Garcia Juan"), ("Linda Okafor", "Okafor Linda"), ("Kenji Watanabe", "Watanabe Kenji"), ("Mbeki Thabo Adebayo", "Thabo Adebayo Mbeki")]
    df = records(*[{"record_id": str(k), "authors": "; ".join(p)} for k, p in enumerate(pairs)], {"record_id": "x", "authors": "Garcia Pedro; Okafor Linus"})
    assert clusters(name_variants.name_clusters(df)) == sorted(sorted(p) for p in pairs)


def test_short_forms_of_names(records):
    df = records({"record_id": "1", "authors": "Miller, Stephen; Miller, Steve; Baker, Andrew; Baker, Andy; Miller, Susan"})
    assert clusters(name_variants.name_clusters(df)) == [["Baker, Andrew", "Baker, Andy"], ["Miller, Stephen", "Miller, Steve"]]


def test_second_family_words_meet_their_initials_in_long_blocks(records, monkeypatch):
    names = [f"Torres {f}, {g}" for f in ("Vega", "Aguilar", "Luna", "Campos") for g in ("Maria", "M.", "María")]
    df = records({"record_id": "1", "authors": "; ".join(names)})
    want = clusters(name_variants.name_clusters(df))
    monkeypatch.setattr(name_variants, "HOT", 2)
    assert clusters(name_variants.name_clusters(df)) == want and [len(c) for c in want] == [3] * 4


def test_long_blocks_lose_no_pair_of_short_ones(records, monkeypatch):
    pairs = [("Sômia Trandurrelez", "Trndurrelez, Sônia"), ("Gezivedín, Sônia Luis", "Sôia Gezivedín"), ("Juan-Carlos Torres-Vega", "Torres Vega, Juan Carlos")]
    df = records(*[{"record_id": str(k), "authors": "; ".join(p)} for k, p in enumerate(pairs)])
    for hot in (200, 0):
        monkeypatch.setattr(name_variants, "HOT", hot)
        assert clusters(name_variants.name_clusters(df)) == sorted(sorted(p) for p in pairs)


def test_names_meet_by_their_letters():
    meet = lambda a, b: set(name_variants.block_keys(a)) & set(name_variants.block_keys(b))
    assert meet("Digezedez, Francisco", "Digrzedez, Francisco") and not meet("Silvorodor, Ana", "Salvarador, Ana")


def test_an_initial_that_fits_two_people_links_neither(records):
    df = records({"record_id": "1", "authors": "Silvorodor, Ana; Silvorodor, Alejandro; Silvorodor, A."})
    assert clusters(name_variants.name_clusters(df)) == []


def test_organisations_in_two_languages(records):
    df = records({"record_id": "1", "authors": "Centro Sombadugón de Currículo y Evaluación; Sombadugón Centre for Curriculum and Assessment; Centro Lisinutal de Currículo y Eval."})
    assert len(clusters(name_variants.name_clusters(df))) == 1


def test_hot_blocks_give_the_same_links(records, monkeypatch):
    names = [f"{f}, {g}" for f in ("Silvorodor", "Silvorodro", "Silvorodor Bandatal") for g in ("Alejandro", "Ale", "A.", "Alejandro Luis", "Alejadro", "Alejandro L.")]
    df = records({"record_id": "1", "authors": "; ".join(names)})
    want = clusters(name_variants.name_clusters(df))
    monkeypatch.setattr(name_variants, "HOT", 3)
    assert clusters(name_variants.name_clusters(df)) == want and len(want) == 1


def test_names_of_nothing(records):
    df = records({"record_id": "1"}, {"record_id": None, "authors": "n/a"}, {"record_id": "2", "authors": " "})
    assert name_variants.name_clusters(df).count() == 0
    assert name_variants.name_clusters(df.limit(0)).count() == 0


def test_jaro_winkler_known_values():
    assert round(name_variants.jaro_winkler("martha", "marhta"), 3) == 0.961
    assert round(name_variants.jaro_winkler("dixon", "dicksonx"), 3) == 0.813


def test_records_of_one_publication(records):
    df = records(
        {"record_id": "1", "title": TITLE, "authors": PEOPLE, "year": 2020},
        {"record_id": "1", "title": TITLE, "authors": PEOPLE, "year": 2020},
        {"record_id": "2", "title": TITLE.upper(), "authors": "A. Silvorodor | Luis Pradopumar", "year": 2021},
        {"record_id": "3", "title": "On school <i>leadership</i> in rurall schools of Puerto Solchavedo", "authors": PEOPLE, "year": None},
        {"record_id": "4", "title": TITLE, "authors": "Other, Person", "year": 2020},
        {"record_id": "5", "title": TITLE + " (II)", "authors": PEOPLE, "year": 2020},
        {"record_id": "6", "title": TITLE.replace("Solchavedo", "Belmicura"), "authors": PEOPLE, "year": 2020},
        {"record_id": "7", "title": TITLE + " (primary school)", "authors": PEOPLE, "year": 2020},
        {"record_id": "8"}, {"record_id": "9", "title": " "}, {"record_id": None, "title": TITLE, "authors": PEOPLE},
    )
    assert groups(near_records.near_records(df)) == [["1", "2", "3"]]
    assert near_records.near_records(df.limit(0)).count() == 0


def test_exact_copies_meet_without_sketches(records):
    df = records(*[{"record_id": str(i), "title": "Editorial", "authors": "Silva, A.", "year": 2000} for i in range(60)])
    assert [len(g) for g in groups(near_records.near_records(df))] == [60]


def test_long_lists_meet_hubs(records, monkeypatch):
    monkeypatch.setattr(near_records, "HOT", 4)
    monkeypatch.setattr(near_records, "HOT_PAIRS", 4)
    swaps = list(itertools.permutations(TITLE.split(":")[0].split()[:4]))[:20]
    rest = " ".join(TITLE.split()[4:])
    df = records(*[{"record_id": f"{i:02}", "title": " ".join(s) + " " + rest, "authors": PEOPLE, "year": 2020} for i, s in enumerate(swaps)])
    assert [len(g) for g in groups(near_records.near_records(df))] == [20]


def test_all_pairs_that_brute_force_confirms_are_found(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/master_records.parquet")
    classes, members = near_records.record_classes(rows)
    of = {r["class"]: pub.unpack(r.work) for r in classes.collect()}
    by = {}
    for r in members.collect():
        by.setdefault(r["class"], []).append(r.record_id)
    want = {tuple(sorted(p)) for c in by for p in itertools.combinations(by[c], 2)}
    for a, b in itertools.combinations(of, 2):
        if pub.same_publication(of[a], of[b]):
            want |= {tuple(sorted((x, y))) for x in by[a] for y in by[b]}
    got = {tuple(r) for r in near_records.p7_found(spark, sf_dir).collect()}
    assert want <= got and len(got) <= 1.1 * len(want) + 2


def candidates(spark, *rows):
    return spark.createDataFrame(
        [(r.get("candidate_id"), r.get("title"), r.get("authors"), r.get("year"), r.get("journal"), None, "x") for r in rows],
        "candidate_id bigint, match_title string, match_authors string, found_year int, journal string, queried_at timestamp_ntz, class string",
    )


def test_candidates_find_their_records(spark, records):
    r = records(
        {"record_id": "1", "title": TITLE, "authors": PEOPLE, "year": 2020, "origin": "Journal A"},
        {"record_id": "2", "title": TITLE.replace("schools", "shcools"), "authors": "L. Pradopumar; A. Silvorodor", "year": 2021},
        {"record_id": "3", "title": TITLE, "authors": "Other, Person", "year": 2020},
        {"record_id": None, "title": TITLE, "authors": PEOPLE},
        {"record_id": "4"},
    )
    c = candidates(
        spark,
        {"candidate_id": 1, "title": "“" + TITLE + "” *", "authors": PEOPLE, "year": 2020},
        {"candidate_id": 1, "title": "“" + TITLE + "” *", "authors": PEOPLE, "year": 2020},
        {"candidate_id": 2, "title": "Nothing like any of them", "authors": "Person, New", "year": 1999},
        {"candidate_id": 3}, {"candidate_id": None, "title": TITLE},
    )
    got = entity_match.match_entities(c, r).where("agrees")
    assert sorted((x.candidate_id, x.record_id) for x in got.collect()) == [(1, "1"), (1, "2")]
    assert all(0 <= x.confidence <= 1 for x in got.collect())
    assert entity_match.match_entities(c.limit(0), r).count() == 0
    assert entity_match.match_entities(c, r.limit(0)).count() == 0


def test_confidence_and_the_mutual_test_make_the_rows(spark, records, monkeypatch):
    r = records({"record_id": "1", "title": TITLE, "authors": PEOPLE, "year": 2020}, *[{"record_id": f"o{k}", "title": f"Other works number {k} on Puerto {k}", "authors": f"Person{k}, X."} for k in range(20)])
    c = candidates(spark, {"candidate_id": 1, "title": TITLE, "authors": PEOPLE, "year": 2020})
    assert entity_match.match_entities(c, r).where("agrees").count() == 1
    monkeypatch.setattr(entity_match, "calibrate", lambda sample: [-50.0, 0.0, 0.0])
    assert entity_match.match_entities(c, r).where("agrees").count() == 0
    monkeypatch.undo()
    monkeypatch.setattr(entity_match, "MARGIN", 1.1)
    assert entity_match.match_entities(c, r).where("agrees").count() == 0


def test_calibration_tells_far_from_near():
    w = entity_match.calibrate([(0.9, 0.5, True)] * 20 + [(0.5, 0.02, False)] * 20 + [(0.6, 0.3, True), (0.8, 0.0, False)])
    z = lambda share, gap: w[0] + w[1] * share + w[2] * gap
    assert z(0.9, 0.5) > 0 > z(0.5, 0.02) and w[2] > 0


def test_retrieval_is_exact_from_the_threshold_on(spark, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(entity_match, "BLOCK", 70)
    monkeypatch.setattr(entity_match, "CHUNK", 9)
    recs = [(i, {f"t{(i * k) % 101}": (k % 3 + 1) / 3 for k in range(1, 12)} | {"all": 1.0}) for i in range(200)]
    asks = [(q, sorted({f"t{(q * k + 3) % 101}" for k in range(1, 12)} | {"all", f"own{q}"})) for q in range(30)]
    docs = spark.createDataFrame([(i, -1, list(t.items()), float(sum(t.values()))) for i, t in recs], "doc bigint, owner bigint, terms array<struct<term:string,tf:double>>, len double")
    docs = docs.selectExpr("doc", "owner", "transform(terms, t -> struct(xxhash64(t.term) as term, t.tf as tf)) as terms", "len")
    got = entity_match.retrieve(spark.createDataFrame([(q, t, None) for q, t in asks], "q bigint, terms array<string>, skip bigint"), docs, tau=0.3)
    df = Counter(t for _, ts in recs for t in ts)
    n, avg = len(recs), sum(sum(t.values()) for _, t in recs) / len(recs)
    k1, b = entity_match.K1, entity_match.B
    idf = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
    part = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))
    want = {}
    for q, ts in asks:
        own = sum(map(idf, ts)) * part(1, len(ts))
        scored = sorted(((-sum(idf(t) * part(d[t], sum(d.values())) for t in ts if t in d), i) for i, d in recs))
        want |= {(q, i): -s for s, i in scored[: entity_match.TOP] if -s >= 0.3 * own}
    found = {(r.q, r.doc): r.score for r in got.collect()}
    assert len(want) > 20 and found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_rows_of_bytes_find_what_all_scores_would(monkeypatch):
    draw = random.Random(5)
    docs = []
    for d in range(300):
        terms = {draw.randrange(200, 500)} | {draw.choice((0, 100)) + draw.randrange(40) for _ in range(draw.choice((2, 6, 12)))}
        docs.append((d, draw.choice((-1, -1, -1, 5)), [{"term": 10_000 + t, "tf": draw.choice((0.25, 1.0, 1.0))} for t in terms]))
    docs += [(d + 1000, owner, terms) for d, owner, terms in docs[:40]]  # ties
    table = pa.table({"doc": [d for d, _, _ in docs], "owner": [o for _, o, _ in docs], "terms": [t for _, _, t in docs], "len": [float(sum(x["tf"] for x in t)) for _, _, t in docs]})
    seen = {}
    for _, _, terms in docs:
        for x in terms:
            seen[x["term"]] = seen.get(x["term"], 0) + 1
    # large enough for sums that no byte holds
    w = {10_000 + t: 6 * math.log(1 + len(docs) / seen.get(10_000 + t, 1)) for t in range(500)}
    asks = []
    for q in range(60):
        terms = {x["term"] for x in docs[draw.randrange(300)][2]} | {10_000 + draw.randrange(500) for _ in range(draw.randrange(4))}
        terms = sorted(((w[t], t) for t in terms), reverse=True)
        asks.append((q, terms, sum(x for x, _ in terms), draw.choice((-1, draw.randrange(300)))))
    avg = sum(table["len"].to_pylist()) / len(docs)
    part = lambda tf, n: tf * (entity_match.K1 + 1) / (tf + entity_match.K1 * (1 - entity_match.B + entity_match.B * n / avg))
    want = []
    for q, terms, own, skip in asks:
        scored = []
        for d, owner, held in docs:
            tf, n = {x["term"]: x["tf"] for x in held}, float(sum(x["tf"] for x in held))
            score = 0.0
            for x, t in terms:
                score += x * part(tf[t], n) if t in tf else 0.0
            if owner in (-1, q) and d != skip and score >= 0.2 * own:
                scored.append((-score, d))
        want += [(q, d, -s) for s, d in sorted(scored)[: entity_match.TOP]]
    for bounds in ({}, {"SHORT": 2, "RARE": 1000, "RUN": 8, "GAP": 0, "QUERIES": 4}, {"SHORT": 2, "RARE": 1000, "RUN": 16, "GAP": 2, "ROWS": 5, "ENTRIES": 50}):
        for name, value in bounds.items():
            monkeypatch.setattr(entity_match, name, value)
        terms = pa.array([[{"w": x, "term": t} for x, t in a[1]] for a in asks])
        queries = pa.table({"q": [a[0] for a in asks], "terms": terms, "own": [a[2] for a in asks], "skip": [a[3] for a in asks]})
        blocks = [entity_match._index(table.slice(k, 128), avg) for k in range(0, len(docs), 128)]
        got = entity_match._best(queries, blocks, tau=0.2).select(["q", "doc", "score"]).to_pylist()
        got = [(x["q"], x["doc"], x["score"]) for x in got]
        assert len(want) > 100 and [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_documents_are_not_shuffled_again_for_more_candidates(spark, monkeypatch):
    sc = spark.sparkContext
    asks = spark.createDataFrame([(q, [f"t{q % 50}", f"t{q % 7}"], None) for q in range(40)], "q bigint, terms array<string>, skip bigint")
    docs = spark.range(500).selectExpr("id as doc", "-1L as owner", "array(struct(xxhash64(concat('t', id % 50)) as term, 1.0D as tf)) as terms", "1.0D as len")

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        nothing = (sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, *nothing)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    rows, found = [], []
    for chunk in (40, 1):
        monkeypatch.setattr(entity_match, "CHUNK", chunk)
        before = shuffled()
        found.append(sorted(map(tuple, entity_match.retrieve(asks, docs).collect())))
        rows.append(shuffled() - before)
    assert found[0] == found[1] and len(found[0]) == 120
    assert rows[1] < rows[0] + 500


def test_terms_that_many_records_hold_still_find_them(spark, records, monkeypatch):
    monkeypatch.setattr(entity_match, "BLOCK", 100)
    monkeypatch.setattr(entity_match, "CHUNK", 1)
    # a third of the rows is one publication, each with a slip of its own; the rest shares nothing with it
    words = TITLE.replace(":", "").split()
    slipped = [(k, i, c) for k, w in enumerate(words) if len(w) > 5 for i in range(1, len(w) - 1) for c in "xz"][:80]
    copies = [" ".join(w[:i] + c + w[i + 1 :] if k == j else w for j, w in enumerate(words)) for k, i, c in slipped]
    rows = [{"record_id": f"c{k}", "title": t, "authors": PEOPLE, "year": 2020} for k, t in enumerate(copies)]
    rows += [{"record_id": f"o{k}", "title": f"Zq{k} yw{k} vu{k} tp{k} rs{k}", "authors": f"Mn{k}, B.", "year": 1990} for k in range(160)]
    c = candidates(spark, {"candidate_id": 1, "title": TITLE, "authors": PEOPLE, "year": 2020}, {"candidate_id": 2, "title": copies[0], "authors": PEOPLE, "year": 2021})
    got = {(x.candidate_id, x.record_id) for x in entity_match.match_entities(c, records(*rows)).where("agrees").collect()}
    assert got == {(q, f"c{k}") for q in (1, 2) for k in range(len(copies))}


def test_the_union_sketch_is_the_least_of_both():
    a, b, kind = [1, 3, 5, 7], [1, 4, 5, 9], pa.list_(pa.int64())
    shared, estimate = near_records.union_estimates(pa.array([a, a, []], kind), pa.array([b, a, a], kind), 4)
    # the four least of the union are 1, 3, 4, 5, of which both hold 1 and 5
    assert shared.tolist() == [2, 4, 0] and estimate.tolist() == [0.5, 1.0, 0.0]


def test_places_tell_the_estimate_and_gates_part_pairs(spark):
    draw = random.Random(3)
    gates = [pub.gate(pub.record(TITLE + part, "Silva, A.", year)) for part in ("", " (II)") for year in (2001, 2004, 2015)]
    rows = [(c, draw.choice(gates), sorted(draw.sample(range(60), draw.choice((1, 8, 24))))) for c in range(40)]
    listed = [(c, g, len(v), x, k, 2) for c, g, v in rows for k, x in enumerate(v)]
    sized = spark.createDataFrame(listed, "class bigint, gate bigint, size int, value bigint, place int, n int")
    got = {tuple(r) for r in near_records.short_pairs(sized, spark.createDataFrame([], "class bigint, hot int")).collect()}
    pairs = list(itertools.combinations(rows, 2))
    kind = pa.list_(pa.int64())
    likely = near_records.likely_pairs(*(pa.array([p[k][2] for p in pairs], kind) for k in (0, 1)))
    years, parts = {g: (2001, 2004, 2015)[k % 3] for k, g in enumerate(gates)}, {g: k // 3 for k, g in enumerate(gates)}
    near = lambda g, h: abs(years[g] - years[h]) <= 3 and parts[g] == parts[h]
    assert got == {(a[0], b[0], True) for (a, b), ok in zip(pairs, likely) if ok and near(a[1], b[1])}
    assert 0 < len(got) < sum(likely)


def test_long_and_short_lists_give_the_same_groups(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/master_records.parquet")
    want = groups(near_records.near_records(rows))
    for hot, pairs in ((2, 2), (2, 100_000)):
        monkeypatch.setattr(near_records, "HOT", hot)
        monkeypatch.setattr(near_records, "HOT_PAIRS", pairs)
        assert groups(near_records.near_records(rows)) == want
