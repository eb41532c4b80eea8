import pytest
from pyspark.sql import functions as F

from filingloom.operators import cleaning, html, sections
from filingloom.plans import pipeline

BOLD = 'style="font-weight:700"'


def items(doc):
    return [s[0] for s in html.sections(doc)[1:]]


@pytest.mark.parametrize(
    ("doc", "found"),
    [
        (f"<div><span {BOLD}>Item 1A. Risk Factors</span></div>", ["1A"]),
        ('<div><span style="font-weight:500">Item 1A. Risk Factors</span></div>', []),
        ("<div><b>Item 7: MD&amp;A</b></div>", ["7"]),
        (f"<div><span {BOLD}>Item\xa01—Business</span></div>", ["1"]),
        (f"<div><span {BOLD}>Items 1 and 2.</span></div>", ["1-2"]),
        ('<div><span style="text-decoration:underline">Item 2. X</span></div>', ["2"]),
        ('<div><span style="font-size:12pt">Item 2. X</span></div>', ["2"]),
        ('<div><span style="font-size:11pt">Item 2. X</span></div>', []),
        ('<div><span style="font-size:16px">Item 2. X</span></div>', []),
        (f'<div><a href="#x"><span {BOLD}>Item 2. X</span></a></div>', []),
        (f'<div><a name="x"><span {BOLD}>Item 2. X</span></a></div>', ["2"]),
        ('<p>As discussed in <u style="text-decoration:underline">Item 1A. Risk Factors</u> above</p>', []),
        (f"<p>As discussed in <span><span {BOLD}>Item 1A. Risk</span></span></p>", []),
        ("<div>" + "<div>text that is long enough</div>" * 9 + f"<div><span {BOLD}>Item 3. Y</span></div></div>", ["3"]),
        (f"<div>123456789<span {BOLD}>Item 3. Y</span></div>", ["3"]),
        (f"<div>1234567890<span {BOLD}>Item 3. Y</span></div>", []),
        (f"<table><tr><td><b>Item 1. A</b></td></tr><tr><td><b>Item 2. B</b></td></tr></table>", []),
        (f"<table><tr><td><b>Item 1. A</b></td></tr></table>", ["1"]),
        ("<b><span>Item 1. X</span></b>", []),
    ],
)
def test_headings(doc, found):
    assert items(f"<html><body>{doc}</body></html>") == found


def test_sections_keep_order_titles_and_text():
    doc = f"<p>cover</p><div><span {BOLD}>Item 1. Business</span><span> of ours</span></div><p>We do things.</p><div><b>Item 2.</b></div><p>Land.</p><ix:header><ix:hidden>secret</ix:hidden></ix:header>"
    got = html.sections(doc)
    assert [(i, t) for i, t, _ in got] == [("FRONT", ""), ("1", "Business"), ("2", "")]
    assert "cover" in got[0][2] and "We do things." in got[1][2] and "Land." in got[2][2] and "secret" not in got[2][2]


def test_text_renderings():
    doc = "<style>a{}</style><script>if (a </p> b) x()</script><p>One &amp; two<p><b>bold</b> line<br>next<table><tr><th>h</th><td>1 <i>2</i></td></tr><tr><td> </td></tr></table><h2>Head</h2><ul><li>x</li></ul>"
    assert "x()" not in html.text_plain(doc) and "One & two" in html.text_plain(doc)
    assert "[TABLE]\nh\t12\n[/TABLE]" in html.text_with_tables(doc)
    marked = html.text_marked(doc)
    assert "## Head" in marked and "* x" in marked and "h | 1 2" in marked


def test_parse_html_reports_errors_and_keeps_nulls(spark, monkeypatch):
    df = spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, "")], "k int, h string")
    got = {r["k"]: r["text"] for r in html.parse_html(df, ["k"], "h", ["plain"]).collect()}
    assert got == {1: "a", 2: None, 3: ""}
    raw = spark.createDataFrame([(1, bytearray(b"<p>a\xff</p>"))], "k int, h binary")
    assert html.parse_html(raw, ["k"], "h", ["plain"]).first()["text"] == "a�"


def test_contents_shape_and_duplicates(spark):
    toc = "\tBusiness.\t1\n\tOverview\t1\n\tSegments\t1-3"
    data = [("f", 0, "1", toc), ("f", 1, "1", "Real prose here."), ("f", 2, "2", toc), ("f", 3, "2", toc), ("f", 4, "3", "None."), ("f", 5, "3", "A long text."), ("f", 6, "4", "\tA\t1\n\tB\t2"), ("f", 7, "4", "x")]
    df = spark.createDataFrame(data, "f string, section_pos int, item_id string, text string")
    flags = [r[0] for r in df.orderBy("section_pos").select(sections.looks_like_contents(F.col("text"))).collect()]
    assert flags == [True, False, True, True, False, False, False, False]
    kept = sorted(r["section_pos"] for r in sections.drop_contents_duplicates(df, ["f"]).collect())
    assert kept == [1, 2, 3, 4, 5, 6, 7]


def test_parts(spark):
    annual = [("a", "10-K", i, x) for i, x in enumerate(["FRONT", "1", "1A", "1-2", "7A", "10", "16", "99"])]
    interim = [("q", "10-Q", i, x) for i, x in enumerate(["FRONT", "1", "2", "3", "4", "1", "1A", "2", "6"])]
    single = [("s", "10-Q", i, x) for i, x in enumerate(["1", "2"])] + [("o", "8-K", 0, "1")]
    df = spark.createDataFrame(annual + interim + single, "f string, form string, section_pos int, item_id string")
    got: dict[str, list[str]] = {}
    for r in sections.assign_parts(df, ["f"]).orderBy("f", "section_pos").collect():
        got.setdefault(r["f"], []).append(r["item_id"])
    assert got["a"] == ["FRONT", "I-1", "I-1A", "I-1-2", "II-7A", "III-10", "IV-16", "?-99"]
    assert got["q"] == ["FRONT", "I-1", "I-2", "I-3", "I-4", "II-1", "II-1A", "II-2", "II-6"]
    assert got["s"] == ["I-1", "I-2"] and got["o"] == ["1"]


def test_boilerplate(spark):
    long99, long100 = "x" * 99, "y" * 100
    texts = {
        1: "[TABLE]\n[/TABLE]\n[TABLE]\n[/TABLE]",
        2: "12\na\n2024\n12345\nTABLE OF CONTENTS\n  indented",
        3: "Acme | 5\nbody\nAcme | 5\n\n\n\nend",
        4: f"{long99}\n{long99}\n{long100}\n{long100}",
        5: None,
        6: "",
        7: "1\n2",
    }
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {r["k"]: r["text"] for r in cleaning.strip_boilerplate(df, ["k"], "t").collect()}
    assert got[1] == texts[1]
    assert got[2] == "a\n12345\n  indented"
    assert got[3] == "body\n\nend"
    assert got[4] == f"{long100}\n{long100}"
    assert got[5] is None and got[6] == "" and got[7] == ""
    audit = {(r["k"], r["line"], r["times"]) for r in cleaning.stripped_lines(df, "k", "t").collect()}
    assert audit == {(3, "Acme | 5", 2), (4, long99, 2)}


def test_joined_words_and_context(spark):
    df = spark.createDataFrame([("business,which",), ("end.The",), ("delayof",), ("1,000",), ("U.S.",)], "t string")
    assert [r[0] for r in df.select(cleaning.has_joined_words(F.col("t"))).collect()] == [True, True, False, False, False]
    ctx = spark.createDataFrame([(1, "aa <img> The Phrase <IMG> bb"), (2, "none"), (3, None)], "k int, t string")
    got = cleaning.keyword_context(ctx, ["k"], "t", "the phrase", 10, "<img").collect()
    assert [(r["k"], r["at"], r["around"]) for r in got] == [(1, 9, 1)]


def test_section_pipeline(spark):
    doc = f"<p>{'cover page words ' * 9}</p><div><b>Item 1. Business</b></div><p>{'We make pumps and valves. ' * 9}</p><div><b>Item 1B. Comments</b></div><p>None.</p>"
    df = spark.createDataFrame([("T", "1", "Co", "10-K", "2024-01-01", "2023-12-31", "acc", bytearray(doc.encode()))], "ticker string, cik string, company string, form string, filing_date string, report_date string, accession string, content binary")
    got = sorted((r["item_id"], r["item_title"]) for r in pipeline.section_records(df).collect())
    assert got == [("10-K:FRONT", ""), ("10-K:I-1", "Business")]


def test_section_records_parse_the_front_text(spark, tmp_path):
    """Front text comes before the first heading, also where a filing has nothing else."""
    from filingloom import catalog

    front, body = "Front text of R&D <filing> number " + "x" * 40, "Body text of the section, " + "y" * 40
    rows = [(1, "a", "10-K", "10-K-1", body), (2, "a", "10-K", "10-K-FRONT", front), (2, "a", "10-K", "10-K-FRONT", front), (3, "b", "10-K", "10-K-FRONT", front), (4, "c", "10-K", "10-K-1", body), (5, "c", "10-K", "10-K-FRONT", None)]
    spark.createDataFrame(rows, "record_id long, accession string, form string, item_id string, text string").write.parquet(str(tmp_path / "records.parquet"))
    got = sorted((r["accession"], r["item_id"].split(":")[-1].split("-")[-1], r["char_count"]) for r in catalog.section_records(spark, str(tmp_path)).collect())
    assert [x[:2] for x in got] == [("a", "1"), ("a", "FRONT"), ("b", "FRONT"), ("c", "1")]
    assert {n for _, item, n in got if item == "FRONT"} == {len(front)}
    sections = sorted((r["accession"], r["section_pos"], r["item_id"]) for r in catalog.html_sections(spark, str(tmp_path)).collect())
    assert sections == [("a", 0, "FRONT"), ("a", 1, "1"), ("c", 0, "FRONT"), ("c", 1, "1")]


def test_rules_within_a_filing_agree_with_those_over_rows(spark):
    contents = "\n".join(f"\tTitle {i}\t{i}" for i in range(4))
    rows = [("a", "10-K", [("FRONT", "x"), ("1", contents), ("1", "prose"), ("99", "y"), ("7", contents), ("7", contents)]), ("b", "10-Q", [("FRONT", "x"), ("1", "p"), ("2", "q"), ("1", "r"), ("1A", "s")]), ("c", "8-K", [("1", "z")])]
    flat = [(acc, form, pos, i, "", t) for acc, form, secs in rows for pos, (i, t) in enumerate(secs)]
    df = spark.createDataFrame(flat, "accession string, form string, section_pos int, item_id string, item_title string, text string")
    by_rows = sections.assign_parts(sections.drop_contents_duplicates(df, ["accession"]), ["accession"])
    one = df.groupBy("accession", "form").agg(F.array_sort(F.collect_list(F.struct("section_pos", "item_id", "item_title", "text"))).alias("s"))
    kept = one.withColumn("s", sections.kept_in_filing(F.col("s")))
    inside = kept.select("accession", "form", F.inline(sections.parts_in_filing(F.col("s"), F.col("form"))))
    pick = lambda d: sorted((r["accession"], r["section_pos"], r["item_id"], r["text"]) for r in d.collect())
    assert pick(by_rows) == pick(inside) and ("a", 2, "I-1", "prose") in pick(inside) and ("b", 3, "II-1", "r") in pick(inside)
    assert len(pick(inside)) == len(flat) - 1
