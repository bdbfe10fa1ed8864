"""Problems 2, 3, 6, 8, 9 and 10: survivors, scans, languages, ids, leaks, shared spans."""

import datetime as dt
import random

import numpy as np
import pytest

from acervo.llm import encode_corpus, eval_leaks, languages, pages, scan_noise, shared_spans, survivors

CORPUS = (
    "document_id string, duplicate_group_id string, doi_normalized string, abstract string, source_database string, "
    "updated_at timestamp_ntz, text_for_modeling string, title string, journal string, language_detected string, "
    "language_metadata string, pdf_path_or_id string, text string, word string"
)
LONG = "The senior team in rural schools recovers role clarity with 343 participants from Villa Garadama, mostly in the first years. More follows here."


@pytest.fixture
def corpus(spark):
    names = [c.split()[0] for c in CORPUS.split(", ")]

    def make(*rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CORPUS)

    return make


def day(n):
    return dt.datetime(2024, 1, n)


def test_survivors_take_the_latest_doi_and_the_fullest_real_abstract(corpus):
    notice = "This item was deposited by its authors and the archive keeps a copy of it for readers."
    others = [
        {"document_id": f"n{i}", "duplicate_group_id": f"n{i}", "abstract": notice, "source_database": "S"} for i in range(4)
    ]
    df = corpus(
        {"document_id": "a", "duplicate_group_id": "g", "doi_normalized": "10.1234/old", "abstract": LONG[:80] + "…", "source_database": "A", "updated_at": day(1)},
        {"document_id": "b", "duplicate_group_id": "g", "doi_normalized": "https://doi.example/10.1234/NEW", "abstract": LONG, "source_database": "B", "updated_at": day(2)},
        {"document_id": "b", "duplicate_group_id": "g", "doi_normalized": "https://doi.example/10.1234/NEW", "abstract": LONG, "source_database": "B", "updated_at": day(2)},
        {"document_id": "c", "duplicate_group_id": "g", "doi_normalized": "1O.1234 new", "abstract": notice + notice, "source_database": "C", "updated_at": day(3)},
        {"document_id": "d", "duplicate_group_id": "g", "doi_normalized": "n/a", "abstract": "See PDF"},
        {"document_id": "e", "duplicate_group_id": "h"},
        {"document_id": "f", "duplicate_group_id": None, "doi_normalized": "10.1234/x"},
        *others,
    )
    got = {r[0]: tuple(r)[1:] for r in survivors.survivors(df).collect()}
    assert got["g"] == ("10.1234/new", "b") and got["h"] == ("", "")
    assert all(got[f"n{i}"] == ("", "") for i in range(4)) and None not in got
    assert survivors.survivors(df.limit(0)).count() == 0


def _planted(corpus):
    """Groups in which B and C copy A: a notice at times, and one wrong abstract against two sources that have the right one."""
    notice = "This item was deposited by its authors and the archive keeps a copy of it for readers."
    rows = []

    def add(g, by_source):
        rows.extend({"document_id": f"{g}{s}", "duplicate_group_id": g, "abstract": t, "source_database": s} for s, t in by_source.items())

    for k in range(40):
        add(f"t{k}", dict.fromkeys("ABCDE", f"Study {k} of the senior team of school {k} and its {k} programmes in the region of Garadama."))
    for k in range(10):
        add(f"n{k}", dict.fromkeys("ABC", notice) | dict.fromkeys("DE", f"Visits {k} to the {k} schools of the province and what their {k} inspectors recorded there."))
    add("x", dict.fromkeys("ABC", "Quite another abstract about markets of wool and salt in the ports of the far north.") | dict.fromkeys("DE", LONG))
    return corpus(*rows)


def test_copied_votes_are_discounted(corpus, monkeypatch):
    df = _planted(corpus)
    got = {r[0]: r[2] for r in survivors.survivors(df).collect()}
    assert got["x"] in ("xD", "xE") and all(got[f"n{k}"][-1] in "DE" for k in range(10))
    # without copy detection the majority wins
    monkeypatch.setattr(survivors, "COPY_SHARE", 0.0)
    assert {r[0]: r[2] for r in survivors.survivors(df).collect()}["x"] in ("xA", "xB", "xC")


def test_texts_with_one_beginning_are_told_apart(corpus):
    opening = "This study describes the work of school principals in the rural schools of the region, "
    works = [opening + f"with {k} interviews in {k} towns and the {k} lessons that their teams draw." for k in range(5)]
    df = corpus(*[{"document_id": f"d{k}", "duplicate_group_id": f"g{k}", "abstract": t, "source_database": "S"} for k, t in enumerate(works)])
    assert {r[0]: r[2] for r in survivors.survivors(df).collect()} == {f"g{k}": f"d{k}" for k in range(5)}


PAGE = """REVISTA SOL DE EDUCACIÓN    12
La planificación de la es-
cuela rural orienta el trabajo de los equi-
                 - 12 -

REVISTA SOL DE EDUCACIÓN    13
pos en 2O14, con base teórico-
práctica y un traba¬
jo de camp0 (ver 9B). La escuela cornparte
el trabajo.

xiv"""
CLEAN = ("La planificación de la escuela rural orienta el trabajo de los equipos con base teórico-práctica en el campo. La escuela comparte el trabajo. " * 6).strip()



def test_texts_that_begin_alike_are_told_apart_by_all_letters(corpus):
    start = "This article examines the leadership of principals in schools and the work of their teams over time. "
    ends = ["Interviews in six towns show how meetings were run.", "Statistics of forty districts are compared at length, table by table, with those of an earlier study."]
    rows = [(start + ends[k == 3], k + 1) for k in range(4)] + [(start + "Interviews in six...", 9)]
    df = corpus(*[{"document_id": f"d{k}", "duplicate_group_id": "g", "abstract": t, "source_database": f"s{k}", "updated_at": day(at)} for k, (t, at) in enumerate(rows)])
    # the longer text has one vote, the other has those of its copies and of its cut
    assert survivors.survivors(df).first()["document_id"] == "d2"


def test_scanned_text_is_repaired(corpus):
    df = corpus(
        {"document_id": "s", "text_for_modeling": PAGE, "pdf_path_or_id": "x.pdf"},
        {"document_id": "s", "text_for_modeling": PAGE, "pdf_path_or_id": "x.pdf"},
        {"document_id": "c", "text_for_modeling": CLEAN},
        {"document_id": "n", "text_for_modeling": None, "pdf_path_or_id": "y.pdf"},
        {"document_id": "b", "text_for_modeling": "  ", "pdf_path_or_id": "z.pdf"},
        {"document_id": None, "text_for_modeling": PAGE, "pdf_path_or_id": "x.pdf"},
    )
    got = {(r.defect, r.item_value) for r in scan_noise.scan_defects(df).collect() if r.document_id == "s"}
    assert got == {
        ("header", "REVISTA SOL DE EDUCACIÓN    12"), ("header", "REVISTA SOL DE EDUCACIÓN    13"), ("page_number", "- 12 -"), ("page_number", "xiv"),
        ("hyphen", "escuela"), ("hyphen", "equipos"), ("hyphen", "teórico-práctica"), ("hyphen", "trabajo"),
        ("misread", "2014"), ("misread", "campo"), ("misread", "comparte"),
    }
    text = scan_noise.repaired_texts(df).where("document_id = 's'").first()["repaired"]
    assert "REVISTA" not in text and "los equipos en 2014, con base teórico-práctica y un trabajo de campo (ver 9B)" in text
    assert scan_noise.scan_defects(df.limit(0)).count() == 0


def _weather_and_months(corpus):
    """Clean texts of two subjects, and scanned ones with a word that has a reading in each."""
    weather = ["un viento malo trajo lluvia fría al valle", "otro viento malo trajo nieve fría al monte", "aquel viento malo trajo lluvia gris al puerto"]
    months = ["desde abril o maio empieza curso nuevo de idiomas", "hasta junho o maio empieza taller nuevo de lectura", "entre abril o maio empieza curso breve de idiomas"]
    clean = [{"document_id": f"c{k}", "text_for_modeling": ". ".join(weather + months) + "."} for k in range(20)]
    ladies = [{"document_id": f"l{k}", "text_for_modeling": "La dama blanca de la torre canta. La dama blanca de la torre duerme."} for k in range(20)]
    return corpus(
        *clean, *ladies,
        {"document_id": "w", "text_for_modeling": "un viento ma1o trajo lluvia gris al monte.", "pdf_path_or_id": "w.pdf"},
        {"document_id": "m", "text_for_modeling": "hasta abril o ma1o empieza taller breve de lectura.", "pdf_path_or_id": "m.pdf"},
        {"document_id": "d", "text_for_modeling": "viento clama trajo lluvia.", "pdf_path_or_id": "d.pdf"},
    )


def test_context_decides_between_readings(corpus, monkeypatch):
    df = _weather_and_months(corpus)
    found = lambda: {(r.document_id, r.item_value) for r in scan_noise.scan_defects(df).where("defect = 'misread'").collect()}
    # a word of its own among words that its one reading never keeps company with stays
    assert found() == {("w", "malo"), ("m", "maio")}
    # without vectors the readings cannot be told apart, and the rare word is taken for the frequent one
    nothing = np.zeros((0, scan_noise.skipgram.DIM), dtype=np.float32)
    monkeypatch.setattr(scan_noise.skipgram, "train", lambda *given: scan_noise.skipgram.Vectors([], nothing, nothing))
    blind = found()
    assert len({v for d, v in blind if d in "wm"}) == 1 and ("d", "dama") in blind


def test_layout_knows_furniture_from_text():
    kinds = [x.kind for x in pages.layout("Silva, Ana María\n[47]\nPágina 9\nv\n2014.\n(p. 99)\n[sic]\nText that runs on")]
    assert kinds == ["header", "page_number", "page_number", "page_number", "body", "body", "body", "body"]


def test_languages_of_texts_and_segments(spark, corpus):
    say = {
        "es": "La escuela rural de la región orienta el trabajo del equipo directivo con las familias en los primeros años.",
        "en": "The senior team in rural schools shapes the work of the governing board with the families in the first years.",
        "fr": "Le conseil de l'école rurale oriente le travail de l'équipe avec les familles pendant les premières années.",
        "pt": "A escola da região orienta o trabalho da equipe diretiva com as famílias nos primeiros anos do ensino médio.",
        "id": "Sekolah di daerah itu mengarahkan pekerjaan tim pimpinan dengan orang tua pada tahun pertama pendidikan dasar.",
    }
    base = [{"document_id": f"{k}{i}", "text_for_modeling": f"{v} {v[:-1]} {i}.", "language_detected": k} for k, v in say.items() for i in range(6)]
    df = corpus(
        *[{**b, "text_for_modeling": b["text_for_modeling"] + "\n\n" + b["text_for_modeling"]} for b in base],
        {"document_id": "wrong", "text_for_modeling": say["fr"], "language_detected": "es"},
        {"document_id": "none", "text_for_modeling": say["en"]},
        {"document_id": "mixed", "text_for_modeling": f"{say['es']} {say['id']}\n\n{say['es']}", "language_detected": "es"},
        {"document_id": "blank", "text_for_modeling": " "}, {"document_id": "null"},
    )
    labelled = languages._by_text(languages.label_segments(df)).where("held")
    got = {}
    for r in labelled.collect():
        got.setdefault(r.document_id, set()).add(r.lang_code)
    assert got["wrong"] == {"fr"} and got["none"] == {"en"} and got["mixed"] == {"es", "id"} and "blank" not in got
    assert all(got[b["document_id"]] == {b["language_detected"]} for b in base)
    assert languages.label_segments(df.limit(0)).count() == 0


def test_far_texts_are_rejected():
    m = languages.Model(["the school and the team of the board"] * 5 + ["la escuela y el equipo de la mesa"] * 5, ["en"] * 5 + ["es"] * 5)
    assert [c for c, _ in m.classify(["the team and the school", "ελληνικά γράμματα", ""])] == ["en", None, None]


@pytest.mark.parametrize("leaf", [3, 17, 4096])
def test_ids_are_those_of_the_tokenizer(leaf):
    path = encode_corpus.TOKENIZER_DIR + "/byte_bpe_50k.tiktoken"
    whole = encode_corpus.tokenizer(path).encode_ordinary
    mine = encode_corpus.Encoder(path, leaf)
    random.seed(leaf)
    letters = "ab'sld tre\n\r\t  12,.é́中\x1c\x85 　"
    for _ in range(1500):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        assert mine.encode(t) == whole(t), repr(t)
    assert mine.encode("x" * 20_000 + " y" * 5_000) == whole("x" * 20_000 + " y" * 5_000)


def test_every_document_is_encoded(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "Hola  mundo", 3), (3, "Hola  mundo", 3)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus.encode_corpus(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) > 2
    assert encode_corpus.encode_corpus(df.limit(0)).count() == 0


def test_documents_are_joined_up_the_tree():
    import pandas as pd

    texts = [t for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text if t and len(t) > 512]
    encoder = encode_corpus.Encoder(encode_corpus.TOKENIZER_DIR + "/byte_bpe_50k.tiktoken")
    joins = []
    join = encoder.join
    encoder.join = lambda *a: joins.append(0) or join(*a)
    for t in texts:
        before = len(joins)
        assert encoder.encode(t) == encoder.whole(t) and len(joins) > before


def test_leaks_are_those_of_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éxito", "ﬁn", "10"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(10, 30)))) for i in range(80)]
    docs = []
    for d in range(150):
        words = random.choices(vocabulary + [f"z{i}" for i in range(20)], k=80)
        if d % 3 == 0:
            source = random.choice(items)[1].split()
            k = random.randint(8, len(source))
            at = random.randint(0, len(source) - k) if len(source) > k else 0
            words[20 : 20 + k] = source[at : at + k]
        docs.append((d, ", ".join(words).upper()))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    run = eval_leaks.RUN
    grams = {}
    for i, t in items:
        w = eval_leaks.words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    want = set()
    for d, t in docs:
        w = eval_leaks.words(t or "")
        for k in range(len(w) - run + 1):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    di = spark.createDataFrame(docs, "doc_id bigint, text string")
    ii = spark.createDataFrame([*items, (500, None), (501, "short")], "item_id bigint, text string")
    assert {tuple(r) for r in eval_leaks.eval_leaks(di, ii).collect()} == want and want
    assert eval_leaks.eval_leaks(di, ii.limit(0)).count() == 0 and eval_leaks.eval_leaks(di.limit(0), ii).count() == 0


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}w{k}" for k in range(14))) for i in range(6)]
    di = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    ii = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(eval_leaks, "INDEX_CHARS", 120)
    assert {tuple(r) for r in eval_leaks.eval_leaks(di, ii).collect()} == {(i, i) for i in range(6)}


def brute_pairs(docs, least):
    seen = {}
    for d, t in docs:
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(d)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def shared(spark, docs, monkeypatch=None):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans, members = shared_spans.shared_spans(df)
    by = {}
    for r in members.collect():
        by.setdefault(r["class"], set()).add(r.doc_id)
    out = {(a, b) for m in by.values() for a in m for b in m if a < b}
    for r in spans.collect():
        out |= {tuple(sorted((x, y))) for x in by[r.class_a] for y in by[r.class_b]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans_are_those_of_brute_force(spark, seed):
    random.seed(seed)
    letters = "abcdefgh   éñ中😀"
    text = lambda n: "".join(random.choice(letters) for _ in range(n))
    common = [text(random.randint(230, 400)) for _ in range(12)] + ["ab" * 200, "a" * 300, "xyz " * 90]
    docs = []
    for d in range(80):
        c = random.choice(common)
        a = random.randint(0, 60)
        docs.append((d, text(random.randint(0, 300)) + c[a : a + random.randint(200, 400)] + text(random.randint(0, 300))))
    docs += [(200, None), (201, ""), (202, "x"), (203, docs[0][1]), (204, docs[0][1])]
    assert shared(spark, docs) == brute_pairs(docs, 250)


def test_hot_boilerplate_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "HOT", 3)
    random.seed(9)
    text = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    short, long = text(180), text(320)
    docs = [(d, text(200) + short + text(200)) for d in range(12)] + [(20 + d, text(100) + long + text(100)) for d in range(8)]
    got = shared(spark, docs)
    assert got == brute_pairs(docs, 250) and len(got) == 28


@pytest.mark.parametrize("bits", [15, 17, 26])
def test_bitmaps_lose_no_class(spark, bits):
    rows = spark.range(3000).selectExpr("id * 7 - 9000 as class", "'t' as text")
    asked = spark.range(0, 3000, 9).selectExpr("id * 7 - 9000 as class")
    got = {r["class"] for r in shared_spans.of_asked(rows, asked, bits).collect()}
    assert got == {r["class"] for r in asked.collect()}
    assert shared_spans.of_asked(rows, asked.limit(0), bits).count() == 0


def test_the_bitmap_goes_before_the_texts_are_shuffled(spark):
    rows = spark.range(300).selectExpr("id as class", "'t' as text")
    plan = shared_spans.of_asked(rows, spark.range(9).selectExpr("id as class"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "_bucket" not in joins[0] and "_bucket" in joins[1]


def test_short_boilerplate_meets_in_no_place(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    plate, long = word(150), word(250)
    texts = [(k, word(260) + (plate if k < 4 else long) + word(260)) for k in range(6)]
    rows = spark.createDataFrame(texts, "class bigint, text string")
    named = rows.mapInArrow(shared_spans._name_places(72, shared_spans._spread(250, 72), 250), "name bigint, class bigint, start int, sides int")
    met = shared_spans._shared_names(named)
    assert {r["class"] for r in met.collect()} == set(range(6))
    assert {r["class"] for r in shared_spans._shared_names(shared_spans._by_side(met)).collect()} == {4, 5}


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    spans, members = shared_spans.shared_spans(df)
    assert spans.count() == 0 and members.count() == 0


def test_coverage_is_that_of_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    seen = {}
    for d, t in docs:
        for k in range(len(t or "") - 249):
            seen.setdefault(t[k : k + 250], set()).add(d)
    want = {}
    for d, t in docs:
        held = [False] * len(t or "")
        for k in range(len(held) - 249):
            if len(seen[t[k : k + 250]]) > 1:
                held[k : k + 250] = [True] * 250
        if any(held):
            want[d] = sum(held)
    assert {r.doc_id: r.shared_chars for r in shared_spans.p10_coverage(spark, sf_dir).collect()} == want and want
