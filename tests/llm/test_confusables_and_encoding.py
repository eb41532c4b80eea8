import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingloom.llm.confusables import consistent, lookalike_groups, one_form, skeleton
from filingloom.llm.mojibake import PAGES, encode, repair, repair_encoding, repair_span, search


@pytest.fixture(autouse=True, scope="module")
def _session(spark):
    """The look-alike table comes from the session's ICU library."""


LATIN = "abcdeghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ 0189.-"


@given(st.lists(st.tuples(st.sampled_from(LATIN), st.integers(0, 10**6)), max_size=25))
@settings(max_examples=400, deadline=None)
def test_equal_skeletons_give_equal_forms(picks):
    """Latin text, and the same text with any letters replaced by true look-alikes of theirs."""
    from filingloom.llm.confusables import tables

    table, strong = tables()
    of = {}
    for c in sorted(strong):
        of.setdefault(table[c], []).append(c)
    plain = "".join(c for c, _ in picks)
    stored = "".join(of[c][i % len(of[c])] if c in of and i % 3 else c for c, i in picks)
    words = zip(re.split("[ .-]", stored), re.split("[ .-]", plain))
    if any(w != v and sum(map(str.isalpha, w)) == 1 for w, v in words):
        return  # a single Greek letter is a symbol, and ordinary
    assert skeleton(stored) == skeleton(plain) and consistent(stored)[0] == consistent(plain)[0] == plain


@pytest.mark.parametrize(("a", "b"), [("СОСА", "COCA"), ("ΝΙΚΕ", "NIKE"), ("аррӏе", "appie"), ("ƒund", "fund"), ("ᴀsset", "asset"), ("ʟoss", "loss"), ("ⲟil", "oil"), ("ⅼoan", "loan"), ("υnit", "unit"), ("бank", "6ank")])
def test_values_that_look_equal_have_one_form(a, b):
    assert consistent(a) == (b, True) and skeleton(a) == skeleton(b)


def test_the_table_is_the_public_one():
    from filingloom.llm.confusables import tables

    table, strong = tables()
    assert len(table) > 1500 and table["Ι"] == "I" and table["О"] == "O" and table["о"] == "o" and strong <= set(table)


@pytest.mark.parametrize(
    ("stored", "form"),
    [
        ("Ｒｉｓｋ Factors", "Risk Factors"), ("Рropеrtiеs", "Properties"), ("Ρrοperties", "Properties"), ("Prop\u200berties", "Properties"), ("Staff\xa0Comments", "Staff Comments"),
        ("suﬀer", "suffer"), ("𝐁𝐮𝐬𝐢𝐧𝐞𝐬𝐬", "Business"), ("Cre\u0300velac", "Crèvelac"), ("re\u2011export", "re-export"), ("So\xadft", "Soft"), ("１０%", "10%"), ("A\u3000B", "A B"),
        ("the сору of", "the copy of"), ("a\u200b", "a"), ("\u200b", ""),
    ],
)
def test_stand_ins_are_replaced(stored, form):
    assert consistent(stored) == (form, True)
    assert skeleton(stored) == skeleton(form)
    assert consistent(form) == (form, False)


@pytest.mark.parametrize("sound", ["“quotes” – and — dashes… • ™ ½ m² £5 €6 ±3", "naïve Ñandará Élorix", "the β of it and Δ", "Завод Ковральт; its name", "東陵工業（株） supplies", "Привет мир", "αβγ", "", "plain"])
def test_ordinary_text_stays(sound):
    assert consistent(sound) == (sound, False)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_one_form_is_stable_and_looks_alike(t):
    form, changed = consistent(t)
    assert changed == (form != t)
    assert skeleton(form) == skeleton(t)


def test_groups_and_table_cases(spark, with_clashes):
    rows = [(1, "Properties"), (2, "Рropеrtiеs"), (3, "Рropеrtiеs"), (4, "Prop\u200berties"), (5, None), (6, ""), (7, "Other"), (7, "Other"), (8, "а" + "b" * 200_000)]
    df = with_clashes(spark.createDataFrame(rows, "k long, t string"))
    got = {r["k"]: (r["changed"], r["form"]) for r in one_form(df, ["k"], "t").collect()}
    assert got[1] == (False, "Properties") and got[2] == got[3] == got[4] == (True, "Properties") and got[5] == (False, None) and got[6] == (False, "") and got[8][1] == "a" + "b" * 200_000
    assert one_form(df, ["k"], "t").count() == 9 and one_form(df, ["k"], "t", only_changed=True).count() == 4
    groups = lookalike_groups(df, "t").collect()
    assert [(g["skeleton"], g["n_rows"], g["n_forms"]) for g in groups] == [("Properties", 4, 3)]
    assert one_form(df.where("false"), ["k"], "t").count() == 0 and lookalike_groups(df.where("false"), "t").count() == 0


def test_p2_queries_cover_both_fields(spark, tmp_path):
    from hashlib import sha256

    from filingloom.llm import queries

    records = [(1, "Properties of it"), (2, "Рropеrtiеs of it"), (2, "Рropеrtiеs of it"), (3, "Other"), (4, None)]
    chunks = [("a|1", "Risk Factors"), ("a|2", "Ｒｉｓｋ Factors"), ("a|3", "Staff\xa0Comments"), ("a|3", "Staff\xa0Comments"), ("a|4", "Other"), ("a|5", None)]
    spark.createDataFrame(records, "record_id long, text string").write.parquet(str(tmp_path / "records.parquet"))
    spark.createDataFrame(chunks, "chunk_id string, item_title string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = sorted((r["tab"], r["item_key"], r["form_hash"]) for r in queries.p2_forms(spark, str(tmp_path)).collect())
    want = [("chunks", "a|2", "Risk Factors"), ("chunks", "a|3", "Staff Comments"), ("records", "2", "Properties of it")]
    assert got == [(tab, key, sha256(form.encode()).hexdigest()) for tab, key, form in want]
    groups = sorted((r["tab"], r["skeleton"], r["n_rows"], r["n_forms"], r["form"]) for r in queries.p2_titles(spark, str(tmp_path)).collect())
    assert groups == [("chunks", "Risk Factors", 2, 2, "Risk Factors"), ("records", "Properties of it", 3, 2, "Properties of it")]


SENTENCES = ["L’été a été réévalué à la clôture — 12 M€.", "Größere Überkapazitäten für die Brücke", "¿Podrá la compañía más?", "The “Leldon” brand™ isn’t sold – yet…", "Жарков was licensed"]


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("sentence", SENTENCES)
def test_round_trip_through_a_wrong_page(sentence, page):
    from filingloom.llm.mojibake import _hybrid

    back = {v: k for k, v in _hybrid[page].items()}
    garbled = "".join(chr(b) if b < 128 else back.get(b, chr(b)) for b in sentence.encode())
    text, steps, bad, _ = repair(garbled)
    assert bad and text == sentence and steps


def test_double_damage_and_bytes_read_as_latin():
    twice = "café — prêt"
    for _ in range(2):
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in twice.encode())
    assert repair(twice)[0] == "café — prêt"
    assert repair("it isn\x92t \x80 5")[0] == "it isn’t € 5"
    assert repair("price &Atilde;&copy;")[0] == "price é"


@pytest.mark.parametrize("sound", ["SÃO LÉVANO", "À l’Âtre", "Château-Âgé", "in Ångvik", "Þórvik ehf.", "ÎLE-DU-NORD", "Gemäß § 6", "“Élorix” – à voir", "R&D &amp; Co &eacute;", "日本語", "Завод Ковральт", "", "plain"])
def test_genuine_text_is_no_damage(sound):
    assert repair(sound) == (sound, (), False, False)


def test_lost_characters_are_found_and_stay():
    assert repair("Gr��ere") == ("Gr��ere", (), True, False)


@given(st.text(max_size=12))
@settings(max_examples=200, deadline=None)
def test_search_never_fails(t):
    text, path, _ = search(t)
    assert isinstance(text, str) and len(path) <= 6
    repair_span(t or "x")
    assert encode("é", "cp1252") == b"\xe9"


def test_encoding_table_cases(spark, with_clashes):
    rows = [(1, "sound"), (2, "cafÃ©"), (2, "cafÃ©"), (3, None), (4, ""), (5, "x" * 300_000 + "Ã©"), (None, "cafÃ©")]
    df = with_clashes(spark.createDataFrame(rows, "k long, t string"))
    got = [(r["k"], r["garbled"], r["restored"]) for r in repair_encoding(df, ["k"], "t").collect()]
    want = [(1, False, "sound"), (2, True, "café"), (2, True, "café"), (3, False, None), (4, False, ""), (5, True, "x" * 300_000 + "é"), (None, True, "café")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert repair_encoding(df, ["k"], "t", only_garbled=True, with_text=False).count() == 4
    assert repair_encoding(df.where("false"), ["k"], "t").count() == 0


@pytest.mark.parametrize(
    ("read", "written", "sentence"),
    [
        ("latin-1", "cp1251", "Привет мир, компания выросла на рынке"), ("cp1251", "koi8_r", "Выручка группы выросла"), ("latin-1", "gbk", "中文公司的收入增加了"),
        ("latin-1", "shift_jis", "日本語の会社は売上を伸ばした"), ("cp1252", "shift_jis", "日本語の会社"),
    ],
)
def test_other_alphabets_come_back(read, written, sentence):
    garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in sentence.encode(written))
    assert repair(garbled)[:3] == (sentence, (f"{read}>{written}",), True)


def test_restored_texts_of_damaged_prose():
    """The share of texts that come back exactly, over every page, plain and twice damaged."""
    good = n = 0
    for page in PAGES:
        for sentence in SENTENCES:
            for times in (1, 2):
                t = sentence
                for _ in range(times):
                    t = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in t.encode())
                n += 1
                good += repair(t)[0] == sentence
    assert good / n > 0.9, good / n
