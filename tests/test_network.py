"""The keyword network counted by classes of equal keyword sets agrees with its edges."""

import random

import pytest

from acervo.operators import keyword_network as N


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def words(spark):
    draw = random.Random(5)
    sets = [draw.sample("abcdefghij", draw.randint(1, 5)) for _ in range(12)]
    sets += [["k", "l"]] * 3 + [["m", "n"], ["o", "p"]]
    rows = [(f"r{i:02}", w) for i in range(40) for w in sets[draw.randrange(len(sets))]]
    return spark.createDataFrame(rows, "record_id string, keyword string").cache()


def by_hand(words, least, plain=False):
    weight = {r["keyword"]: r["idf"] for r in N.keyword_weights(words).collect()}
    held: dict[str, set] = {}
    for r, w in words.collect():
        held.setdefault(r, set()).add(w)
    out = []
    for x in held:
        for y in held:
            both, either = held[x] & held[y], held[x] | held[y]
            value = len(both) / len(either) if plain else sum(weight[w] for w in both) / sum(weight[w] for w in either)
            if x < y and len(both) > 1 and value + 1e-12 >= least:
                out.append((x, y, len(both)))
    return sorted(out, key=str)


@pytest.mark.parametrize("plain", [False, True])
def test_edges_are_made_of_lists_of_any_length_and_not_shuffled(words, plain, monkeypatch):
    monkeypatch.setattr(N, "LISTED", 2)
    edges = N.network_edges(words, 0.3, plain=plain)
    assert rows(edges.select("source", "target", "shared_count")) == by_hand(words, 0.3, plain)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "explode(who_a" in above and "explode(who_b" in above


def test_profiles_are_counted_by_classes(words):
    got = rows(N.profile_counts(words, {"low": 0.2, "high": 0.6}).unionAll(N.profile_counts(words, {"plain": 0.5}, plain=True)))
    want = []
    for name, least, plain in (("low", 0.2, False), ("high", 0.6, False), ("plain", 0.5, True)):
        edges = by_hand(words, least, plain)
        want.append((name, len(edges), len({e[0] for e in edges})))
    assert got == sorted(want, key=str)
    assert N.profile_counts(words.limit(0), {"low": 0.2}).count() == 0


def test_degrees_are_counted_by_classes(words):
    ends = [e for x, y, _ in by_hand(words, 0.3) for e in (x, y)]
    assert rows(N.network_degrees(words, 0.3)) == sorted(((e, ends.count(e)) for e in set(ends)), key=str)


def test_components_are_found_by_classes(words, monkeypatch):
    monkeypatch.setattr(N, "TREES_KEPT", 3)
    part = {}
    for x, y, _ in by_hand(words, 0.5):
        one = part.get(x, {x}) | part.get(y, {y})
        part |= dict.fromkeys(one, one)
    assert rows(N.network_components(words, 0.5)) == sorted(((r, min(p)) for r, p in part.items()), key=str)


def test_agreement_is_counted_by_classes(spark, words):
    topic = {f"r{i:02}": i % 3 for i in range(36)}
    assigned = spark.createDataFrame(list(topic.items()), "record_id string, topic int")
    edges = [(topic[x], topic[y]) for x, y, _ in by_hand(words, 0.3) if x in topic and y in topic]
    got = N.network_agreement(words, assigned, 0.3).first()
    assert (got["eligible_edges"], got["same_topic_edges"]) == (len(edges), sum(x == y for x, y in edges))
