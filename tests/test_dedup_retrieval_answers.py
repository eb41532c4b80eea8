import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.operators import answers, dedup, retrieval
from filingloom.plans import pipeline


def shingles(t, n=5):
    w = t.split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(30):
        words = list(rng.choice(vocabulary, 120))
        out.append((len(out), " ".join(words)))
        for _ in range(i % 4):
            changed = list(words)
            for _ in range(int(rng.integers(1, 6))):
                changed[int(rng.integers(0, len(changed)))] = "new"
            out.append((len(out), " ".join(changed)))
    out += [(len(out) + i, out[3][1]) for i in range(3)]
    return [*out, (900, None), (901, ""), (902, "short"), (903, "x" * 300), (904, "x" * 300)]


def brute(rows, t=0.8):
    first = {}
    for k, x in rows:
        if x and len(x) >= 200:
            first.setdefault(x, k)
    reps = [(k, shingles(x)) for x, k in first.items()]
    return {(a, b): len(x & y) / len(x | y) for i, (a, x) in enumerate(reps) for b, y in reps[i + 1 :] if len(x & y) >= t * len(x | y)}


@pytest.mark.parametrize("how", ["exact", "minhash"])
def test_near_duplicates_against_brute_force(spark, how):
    rows = corpus()
    df = spark.createDataFrame(rows, "k long, t string")
    run = dedup.near_duplicates_exact if how == "exact" else dedup.near_duplicates_minhash
    got = {(r["a"], r["b"]): r["similarity"] for r in run(df, "k", "t").collect()}
    want = brute(rows)
    assert want and got == pytest.approx(want)
    assert run(df.where("false"), "k", "t").count() == 0


def test_unverified_minhash_estimates(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "k long, t string")
    want = brute(rows, 0.8)
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.near_duplicates_minhash(df, "k", "t", verify=False).collect()}
    assert set(want) <= set(got) and all(abs(got[p] - want[p]) < 0.2 for p in want)


def test_classes(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 8), (8, 9), (6, 9), (20, 21)] + [(30 + i, 31 + i) for i in range(20)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(60)], "k long")
    got = {r["k"]: (r["class_id"], r["links"]) for r in dedup.classes_of(pairs, nodes, "k").collect()}
    assert len(got) == 60
    assert [got[i][0] for i in (1, 2, 3)] == [1, 1, 1] and {got[i][0] for i in (5, 6, 7, 8, 9)} == {5}
    assert {got[i][0] for i in range(30, 51)} == {30} and got[4] == (4, 0) and got[2][1] == 2


def test_near_classes_hold_exact_copies(spark):
    rows = corpus()
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # copies without a near text
    near = {frozenset(p) for p in brute(rows)}
    first = {}
    for k, x in rows:
        if x and len(x) >= 200:
            first.setdefault(x, k)
    rep = {k: first.get(x, k) for k, x in rows}
    linked = {k: {o for o in rep if o != k and (rep[o] == rep[k] or frozenset((rep[o], rep[k])) in near)} for k in rep}
    want = {}
    for k in sorted(rep):
        todo = [] if k in want else [k]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = (k, len(linked[x]))
                todo += linked[x]
    df = spark.createDataFrame(rows, "k long, t string")
    got = dedup.near_duplicate_classes(df, "k", "t").collect()
    assert len(got) == len(rows) and {r["k"]: (r["class_id"], r["links"]) for r in got} == want
    assert any(rep[k] != k and frozenset((rep[k], o)) in near for k in rep for o in rep)
    assert dedup.near_duplicate_classes(df.where("false"), "k", "t").count() == 0


def test_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "k int, t string")
    assert [(r["copies"], r["first_key"]) for r in dedup.exact_copies(df, "k", "t").collect()] == [(2, 1)]
    assert sorted((r["k"], r["class_id"]) for r in dedup.copy_classes(df, "k", "t").collect()) == [(1, 1), (2, 1), (3, 3)]


def test_cosine_topk_edges(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [float("nan"), 0.0]), (5, None), (6, [0.6, 0.8])]
    df = spark.createDataFrame(v, "k long, e array<float>")
    q = df.where("k in (1, 3)")
    got = sorted((r["query_id"], r["rank"], r["k"]) for r in retrieval.cosine_topk(q, df, "k", "k", "e", 3).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 6), (3, 1, 3), (3, 2, 6), (3, 3, 1)]
    assert retrieval.cosine_topk(q, df, "k", "k", "e", 99).count() == 8
    assert retrieval.cosine_topk(q.where("false"), df, "k", "k", "e", 3).count() == 0
    assert retrieval.cosine_topk(q, df.where("false"), "k", "k", "e", 3).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)], "k long, e array<float>")
    assert sorted(r["k"] for r in retrieval.cosine_topk(q.limit(1), ties, "k", "k", "e", 3, block=1).collect()) == [1, 2, 3]


def test_blocks_of_queries_and_string_keys(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in r]) for i, r in enumerate(m)], "k string, e array<double>")
    got = {(r["query_id"], r["rank"]): r["k"] for r in retrieval.cosine_topk(df, df, "k", "k", "e", 4, block=7).collect()}
    order = np.argsort(-(m @ m.T), axis=1)[:, :4]
    assert got == {(f"v{i:02d}", j + 1): f"v{order[i, j]:02d}" for i in range(60) for j in range(4)}


def test_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "e array<float>")
    assert [r[0] for r in df.select(retrieval.normalized(F.col("e"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0], None]


@pytest.mark.parametrize(
    ("answer", "cited"),
    [("[A|d|10-K:I-1|0]", ["A|d|10-K:I-1|0"]), ("x [A|1, B|2; C|3]", ["A|1", "B|2", "C|3"]), ("[1]", []), ("[x](http://u)", []), ("[[a|b]]", ["a|b"]), ("[a|b, plain]", ["a|b", "plain"]), (None, []), ("", [])],
)
def test_citations(spark, answer, cited):
    df = spark.createDataFrame([(answer, ["A|1", "a|b"])], "t string, ids array<string>")
    r = answers.verify_citations(df, "t", "ids").first()
    assert r["cited"] == cited and r["fabricated"] == [c for c in cited if c not in ("A|1", "a|b")] and r["valid"] == (not r["fabricated"])


def test_run_metrics(spark):
    ms = [(3272, 3060, 3447, 184), (22, 2050, 3325, 154), (19, 2028, 3487, 141), (21, 1219, 3654, 75), (17, 3126, 3011, 323), (17, 3595, 2997, 303), (20, 1379, 3366, 87), (17, 1451, 3443, 90)]
    df = spark.createDataFrame([("r", i, a, b, c, d, []) for i, (a, b, c, d) in enumerate(ms)] + [("one", 0, 5, 6, 1, 1, ["x"])], "run string, pos int, retrieval_ms int, generation_ms int, input_tokens int, output_tokens int, fabricated_citations array<string>")
    got = {r["run"]: r for r in answers.run_metrics(df, "run", "pos").collect()}
    assert (got["r"]["retrieval_ms_warm"], got["r"]["generation_ms"], got["r"]["input_tokens"], got["r"]["output_tokens"]) == (19, 2050, 26730, 1357)
    assert (got["one"]["retrieval_ms_warm"], got["one"]["fabricated_answers"]) == (5, 1)


def test_questions_to_answers(spark):
    text = " ".join(f"pump{i}" for i in range(40))
    recs = spark.createDataFrame([("T", "C", "10-K", "d", "r", "a", "10-K:I-1", "Title", text), ("T", "C", "10-K", "d", "r", "a", "10-K:I-2", "Land", "acres of land")], "ticker string, company string, form string, filing_date string, report_date string, accession string, item_id string, item_title string, text string")
    encoder = retrieval.hashing_encoder(64)
    index = pipeline.index_of(recs, encoder)
    asked = spark.createDataFrame([(1, "acres of land"), (2, "pump1 pump2 pump3")], "question_id int, question string")
    got = {r["question_id"]: r for r in pipeline.answer_questions(asked, index, encoder, answers.echo_generator, k=1).collect()}
    assert got[1]["citations"] == ["T|r|10-K:I-2|0"] and got[2]["citations"] == ["T|r|10-K:I-1|0"] and got[1]["citations_valid"]
    assert got[1]["retrieved"][0]["rank"] == 1 and got[1]["stop_reason"] == "end_turn"


def test_answer_pipeline_has_vectors_of_the_full_dimension(monkeypatch):
    from filingloom import catalog

    class Seen(Exception):
        pass

    def index_of(records, encoder, *more):
        raise Seen(encoder(["some text"]).shape)

    monkeypatch.setattr(catalog.pipeline, "index_of", index_of)
    monkeypatch.setattr(catalog, "_records", lambda spark, d: None)
    with pytest.raises(Seen) as seen:
        catalog.answer_pipeline(None, "")
    assert seen.value.args == (retrieval.hashing_encoder()(["some text"]).shape,) == ((1, 384),)


def test_templates_and_hot_shingles_lose_no_pair(spark, monkeypatch):
    """Texts of one template share their prefixes in runs; with small pieces and run
    bounds every way of the join is taken, and it is brute force that decides."""
    from filingloom.operators import similarity

    for name, value in (("RUNS", 3), ("SPLIT", 8), ("LEAST_BITS", 8)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(3)
    rows = []
    for t in range(3):
        body = [f"t{t}w{i}" for i in range(60)]
        for v in range(40):
            words = list(body)
            for _ in range(v % 5):
                words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "k long, t string")
    texts, sets = {}, {}
    for k, t in rows:
        texts.setdefault(t, k)
    for t, k in texts.items():
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    keys = sorted(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = dedup.near_duplicates_exact(df, "k", "t", 0.6)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) > 300
    banded = {(r["a"], r["b"]) for r in dedup.near_duplicates_minhash(df, "k", "t", 0.6, bands=64).collect()}
    assert banded <= want and len(banded) > 0.99 * len(want)
    signed = dedup.signatures(df.select(df["k"].alias("_k"), df["t"].alias("_t")), 32, 5)
    pairs = lambda n: {tuple(r) for r in dedup.band_candidates(signed, 16, 2, n).collect()}
    assert pairs(4) == pairs(10**6)
