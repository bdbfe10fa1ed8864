from acervo.operators.packed_values import parse, split_packed


def people(text):
    return [v.text for v in parse(text, True)]


def terms(text):
    return [v.text for v in parse(text, False)]


def test_family_comma_given_is_one_value():
    assert people("Griniepegui, Guadalupe María") == ["Griniepegui, Guadalupe María"]
    assert people("Silva, Ana M.; de la Cruz, José") == ["Silva, Ana M.", "de la Cruz, José"]


def test_lists_without_hard_separators():
    assert people("Ana Silva, Luis Pérez y Marta Gómez") == ["Ana Silva", "Luis Pérez", "Marta Gómez"]
    assert people("Silva, Ana and Pérez, Luis and Gómez, Marta") == ["Silva, Ana", "Pérez, Luis", "Gómez, Marta"]
    assert people("Ana Silva & Luis Pérez") == ["Ana Silva", "Luis Pérez"]


def test_an_organisation_keeps_its_own_conjunction():
    name = "Centro Sol de Currículo y Evaluación"
    assert people(name) == [name]
    assert people(f"{name}; Ana Silva") == [name, "Ana Silva"]


def test_quotes_brackets_and_doubled_quotes():
    assert terms('a;"b, c";"d ""e"""') == ["a", "b, c", 'd "e"']
    assert terms('["a b", "c; d"]') == ["a b", "c; d"]
    assert people('["Silva, Ana"; "Luis Pérez"]') == ["Silva, Ana", "Luis Pérez"]


def test_malformed_quotes_backtrack_and_are_flagged():
    got = parse('"a b; c', False)
    assert [v.text for v in got] == ['"a b', "c"]
    assert got[0].flag == "malformed_quote" and got[1].flag is None


def test_empty_pieces_are_left_out():
    assert terms("; a;; b |c //  ") == ["a", "b", "c"]
    assert terms(" N/A ") == [] and terms("") == [] and terms(None) == []


def test_very_long_fields_are_parsed_whole():
    assert len(terms(";".join(f"t{i}" for i in range(50_000)))) == 50_000


def test_rows_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [("r1", "Ana Silva; Luis Pérez", "a|b", 7), ("r1", "Ana Silva; Luis Pérez", "a|b", 7), (None, "X Y", None, 1), ("r2", None, "nan", 2)]
    df = spark.createDataFrame(rows, "record_id string, authors string, keywords string, pos int")
    got = split_packed(df, "record_id", {"authors": True, "keywords": False})
    assert got.columns == ["record_id", "field_name", "pos", "item_value"]
    out = sorted(map(tuple, got.collect()), key=str)
    assert out.count(("r1", "authors", 2, "Luis Pérez")) == 2
    assert (None, "authors", 1, "X Y") in out
    assert not [r for r in out if r[0] == "r2"]
    assert split_packed(df.limit(0), "record_id", {"authors": True}).count() == 0
