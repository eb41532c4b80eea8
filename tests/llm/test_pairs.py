import pytest

from filingloom.llm.pairs_crf import TAGS, TRAINING, Field, broken_pairs, clauses, complete, features, fit_languages, is_empty, judge, labelled, own_languages, sequences, trained

Q = "What was Nord Pumpen AG's gross margin in fiscal 2016?"
CITE = "[NP|0001-16-1|10-K:I-1|0]"


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " \n\t", "empty"), (Q, "\u200b\ufeff", "empty"), (Q, "...", "empty"), (Q, "[]", "empty"), (Q, "N/A", "empty"), (Q, "(none)", "empty"), (Q, "—", "empty"),
        (Q, f"Gross margin was 31% in fiscal 2016 {CITE}.", None),
        (Q, f"31% {CITE}", None),
        (Q, f"- Margin rose by 3% {CITE}\n- Costs fell {CITE}", None),
        (Q, f"Margin rose {CITE}. The company expects costs to f", "truncated"),
        (Q, "Margin rose [NP|0001-16-1|10-", "truncated"),
        (Q, f"Margin rose {CITE} and then [", "truncated"),
        (Q, "I'm sorry, but I can't help with that.", "refusal"),
        (Q, f"I would rather not answer questions about this company {CITE}.", "refusal"),
        (Q, "Es tut mir leid, dabei kann ich nicht helfen.", "refusal"),
        (Q, "The retrieved chunks do not contain the gross margin, so I cannot say what it was.", None),
        (Q, "I am unable to find the gross margin in the provided context.", None),
        (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f'"{Q}"', "copy"), (Q, f"Q: {Q}\nA: {Q}", "copy"), (Q, Q.rstrip("?"), "copy"),
        (Q, f"{CITE} {Q}", "copy"), (Q, f"{CITE} Margin came to 31% in the year.", None), (Q, CITE, "empty"),
        (Q, f"{Q} Margin came to 31% of sales {CITE}.", None),
        (Q, f"{Q} No {CITE}", None),
        (Q, f"Die Bruttomarge der Gruppe lag im Jahr 2016 bei 31% und damit über dem Vorjahr {CITE}.", "language"),
        ("Wie hoch war die Marge von Nord Pumpen im Jahr 2016?", f"Die Marge lag bei 31% und damit über dem Vorjahr {CITE}.", None),
        ("Wie hoch war die Marge von Nord Pumpen im Jahr 2016?", f"The margin was above that of the year before {CITE}.", "language"),
        ("Quelle était la marge de Nord Pumpen en 2016 ?", f"La marge du groupe a progressé de 3% en 2016 grâce à la demande {CITE}.", None),
        ("¿Cuál fue el margen de Nord Pumpen en 2016?", f"Le groupe a cédé une activité pour un prix de 12 M€ {CITE}.", "language"),
        (None, f"Margin was up by 3% in the year {CITE}.", None),
    ],
)
def test_defects(question, answer, defect):
    assert judge(question, answer, trained())[0] == defect


def test_field_learns_its_training_text():
    f = trained()
    hit = total = 0
    for question, labelled in TRAINING:
        tags = f.tag(features(question, "\n".join(c for c, _ in labelled)))
        hit += sum(TAGS[t] == want for t, (_, want) in zip(tags, labelled))
        total += len(labelled)
    assert hit / total > 0.97


def test_held_out_accuracy():
    """Leave out every fourth sequence, train on the rest, tag the left-out ones."""
    data = labelled(sequences())
    good = n = 0
    for k in range(4):
        f = Field.train([d for i, d in enumerate(data) if i % 4 != k], rounds=150)
        for x, y in data[k::4]:
            good += int((f.tag(x) == y).sum())
            n += len(y)
    assert good / n > 0.93


def test_transitions_decide():
    """With all transition weights at zero many tags change."""
    f, data = trained(), labelled(sequences())
    bare = Field(f.unary, f.step * 0)
    right = [sum(int((m.tag(x) == y).sum()) for x, y in data) / sum(len(y) for _, y in data) for m in (f, bare)]
    assert right[0] > 0.95 and right[1] < right[0] - 0.05


#: Pairs written for this test alone: no clause of them is trained on.
HELD_OUT = [
    ("This falls outside what I do here.", "refusal"), ("I would prefer to leave that one alone.", "refusal"), ("I'd rather we talked about something else.", "refusal"), ("Answering that is nothing I can do.", "refusal"),
    ("My instructions keep me from speaking about companies. Is there anything else I can help with?", "refusal"), ("De brutomarge van de groep lag in dat jaar boven die van het jaar ervoor.", "language"),
    ("Il margine lordo del gruppo è cresciuto rispetto all'anno precedente.", "language"), ("Валовая маржа группы выросла по сравнению с прошлым годом.", "language"), ("グループの粗利益率は前年を上回りました。", "language"),
    (f"La marge brute du groupe a dépassé celle de l’exercice précédent {CITE}. Elle était de 31% {CITE}.", "language"), (f"Die Marge war höher als im Vorjahr {CITE}. 31% {CITE}.", "language"),
    (f"Gross margin came to 31% {CITE}. Freight costs, which had weighed on the ye", "truncated"), (f"- 31% {CITE}\n- a rise of", "truncated"), (f"Gross margin came to 31% {CITE[:12]}", "truncated"), ("It was about", "truncated"),
    (f"Gross margin was 31%, as “La Belle Maison” sold well {CITE}.", None), (f"31% {CITE}", None), (f"Yes {CITE}", None), ("The sections I have do not state it, so I cannot give you a number.", None), ("I could find nothing on gross margin in the retrieved documents.", None),
    (f"The board refused to comment on margin targets {CITE}.", None), (f"Management could not help the rise in costs, which its policy did not foresee {CITE}.", None), (f"{Q} It was 31% {CITE}.", None), (f"Margins rose {CITE}. I hope this helps.", None), (f"- Margin: 31% {CITE}\n- Costs: 69% {CITE}", None),
    (Q.lower(), "copy"), (f"{CITE} {Q}", "copy"), (f"{Q} {Q}", "copy"), ("nil", "empty"), ("\u2060 .", "empty"),
]


def test_precision_and_recall_on_pairs_held_out():
    got = [(judge(Q, a, trained())[0], want) for a, want in HELD_OUT]
    right = sum(g == w for g, w in got if w)
    assert right >= 0.95 * sum(w is not None for _, w in got), [(a, g, w) for (a, w), (g, _) in zip(HELD_OUT, got) if g != w]
    assert right >= 0.99 * sum(g is not None for g, _ in got), [(a, g, w) for (a, w), (g, _) in zip(HELD_OUT, got) if g != w]


def test_languages_from_labelled_rows(spark):
    rows = [(i, lang and lang.upper() if i % 2 else lang, t) for i, (lang, t) in enumerate([("en", "The costs of the group were higher than in the year before."), ("de", "Die Kosten der Gruppe waren höher als im Vorjahr."), ("xx", "zzz"), (None, "nothing"), ("fr", None)])]
    made = fit_languages(spark.createDataFrame(rows, "k long, l string, t string"), "t", "l", "k", sample=4)
    name = lambda t: made.names[made.language(t)]
    assert made.names == ["de", "en", "es", "fr"]
    assert [name(t) for t in ("Die Kosten waren höher", "The costs were higher", "Les coûts ont augmenté dans le groupe", "Los costes del grupo crecieron")] == ["de", "en", "fr", "es"]


def test_parts():
    assert clauses("One. Two Inc. three. [a|b]\n- Four") == ["One.", "Two Inc. three. [a|b]", "- Four"]
    assert complete("a.") and complete("a [x|y]") and complete('"a."') and not complete("a") and not complete("a [x|y")
    assert is_empty("[a|b]") and not is_empty("[a|b")
    made = own_languages()
    assert made.names[made.language("Der Umsatz der Gruppe ist gestiegen")] == "de"


def test_table_cases(spark, with_clashes):
    rows = [(1, Q, None), (1, Q, None), (2, None, None), (3, Q, "word " * 50_000 + "end."), (4, Q, Q), (None, Q, Q)]
    df = with_clashes(spark.createDataFrame(rows, "k long, question string, answer string"))
    got = [(r["k"], r["defect"]) for r in broken_pairs(df, ["k"], "question", "answer").collect()]
    assert sorted(got, key=str) == sorted([(1, "empty"), (1, "empty"), (2, "empty"), (3, None), (4, "copy"), (None, "copy")], key=str)
    assert broken_pairs(df.where("false"), ["k"], "question", "answer").count() == 0
    assert broken_pairs(df, ["k"], "question", "answer", only_defects=True).count() == 5
