import random
import re

import pytest

from netloom.llm.toxicity import Recipe, Classifier, rates, score_documents, segments, train, train_on

NOUNS = "harbour bridge garden council ledger ferry mirror window orchard clerk".split()
VERBS = "moved repaired painted counted opened sorted".split()
INSULTS = "idiot scumbag coward halfwit".split()


def harmless(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the old {rng.choice(NOUNS)}."


def toxic(rng):
    return rng.choice(["Shut up you stupid {}!", "I hope you rot, {} lol", "what a worthless {} you are ...", "You are a {} and everyone knows it!!!"]).format(rng.choice(INSULTS))


def disguise(rng, text):
    return rng.choice([str.upper, lambda t: t.replace("o", "0").replace("i", "1"), lambda t: t.replace("o", "о"), lambda t: t.replace("idiot", "i d i o t").replace("scumbag", "s.c.u.m.b.a.g"), lambda t: t.replace("i", "iiii")])(text)


@pytest.fixture(scope="module")
def material():
    rng = random.Random(1)
    rated = [(toxic(rng), 1) for _ in range(80)] + [(harmless(rng), -1) for _ in range(80)] + [(harmless(rng), 1) for _ in range(2)] + [(f"The report says nobody should call a {x} names.", -1) for x in NOUNS]
    page = lambda bad: " ".join([harmless(rng) for _ in range(6)]) + (f"\n{bad}\n" if bad else " ") + " ".join([harmless(rng) for _ in range(3)])
    pages = [(i, page(disguise(rng, toxic(rng)) if i % 10 == 0 else None)) for i in range(400)]
    return rated, pages


def test_held_out(material):
    rated, pages = material
    unlabelled = sorted({(" ".join(w), m) for _, t in pages[:200] for w, m in segments(t)})
    model = train(rated, [(w.split(), m) for w, m in unlabelled], None, Recipe())
    flagged = {i for i, t in pages[200:] if model.document(t) >= model.threshold}
    truth = {i for i, _ in pages[200:] if i % 10 == 0}
    assert len(flagged & truth) >= 0.9 * len(truth) and len(flagged - truth) <= 1
    assert model.document("") < 0.1


def test_disguises_are_undone():
    plain = segments("what a worthless scumbag you are")[0][0]
    for text in ("what a w0rthl355 scumb4g you are", "WHAT A WORTHLESS SCUMBAG YOU ARE", "what a worthless s.c.u.m.b.a.g you are", "what a worthless s c u m b a g you are", "what a worth​less sсumbаg you are", "what a worthless scuuuumbag you are", "what a worthless scumbÃ¤g you are"):
        assert segments(text)[0][0] == plain, text
    model = Classifier({}, 0.0, {("s", "g", 5): "scumbag"})
    assert model.unmask(segments("you s*****g!")[0][0]) == ["you", "scumbag"]


def test_marks_tell_how_it_is_written():
    long = " ".join(f"{a}{b}" for a in "bdfgk" for b in "aeiou")
    got = segments("One two three. why this now !!!\nGO HOME NOW\nUser: and so on ...\n\nthis line\nwent on\n\nso no more? " + long + "!")
    assert [m for _, m in got] == [".", "!!!S", "C", "", "...S", "", "", "?S", "S", "", "", "!"]
    assert [m for _, m in segments(long + "!")] == ["S", "", "", "!"]
    assert [w for w, _ in segments("if a < b and c > d then")] == ["if a b and c d then".split()]


def test_prior_and_threshold_are_estimated(material):
    rated, pages = material
    unlabelled = sorted({(" ".join(w), m) for _, t in pages for w, m in segments(t)})
    model = train(rated, [(w.split(), m) for w, m in unlabelled])
    assert 0.001 < model.prior < 0.2 and 0 < model.threshold < 1
    assert train(rated, [(w.split(), m) for w, m in unlabelled], r=Recipe(prior=0.03)).prior == 0.03


def test_candidates_come_from_outside_the_sample(material):
    """A wording that neither the ratings nor the drawn segments have is learnt from what is asked for."""
    rated, pages = material
    unlabelled = [(w, m) for _, t in pages[:100] for w, m in segments(t)]
    new = [(f"crawl away you {x} mudlark".split(), "!!!S") for x in INSULTS] + [(["crawl", "away", "you", "mudlark"], m) for m in ("!!!S", "...S")]
    asked = []

    def ask(model, ways):
        asked.append(ways)
        return new

    model = train(rated, unlabelled, ask=ask)
    assert asked and any(m.startswith("!!!") or m.startswith("...") for m in asked[0])
    assert model.document("Crawl away, you mudlark.") > train(rated, unlabelled).document("Crawl away, you mudlark.")


def test_segments_cover_long_text_without_punctuation():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(500)]
    seen = {w for ws, _ in segments(" ".join(words)) for w in ws}
    assert {re.sub(r"(.)\1", r"\1", w) for w in words} <= seen and len(segments("a" * 300_000)) == 1 and segments(" \n ") == []


def test_documents(spark, material):
    rated, pages = material
    docs = [(i, "s" if i % 2 else None, t, 1.0) for i, t in pages] + [(900, "s", None, 1.0), (901, "s", "", 1.0), (None, "s", pages[0][1], 1.0)]
    docs = spark.createDataFrame(docs, "doc_id long, source string, text string, score double")
    labels = spark.createDataFrame([(t, "abusive" if v > 0 else "none", "x") for t, v in rated] + [(None, "none", "x"), ("x", None, "x"), (rated[0][0], "none", "x")], "sample_text string, label string, text string")
    model = train_on(docs, labels)
    model = Classifier.from_table(model.as_table(spark))  # kept as rows
    scored = score_documents(docs, model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got[900] == got[901] == 0.0 and got[None] >= model.threshold and len(got) == 403
    table = {r["source"]: (r["documents"], r["flagged"]) for r in rates(scored, model.threshold).collect()}
    assert table[None][0] == 200 and table["s"][0] == 203 and 38 <= table[None][1] + table["s"][1] <= 48
    assert score_documents(docs.limit(0), Classifier({}, 0.0, {})).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    model = train_on(docs, spark.createDataFrame([], "sample_text string, label string"))
    assert model.document("anything") < model.threshold


def test_abuse_copied_onto_a_third_of_the_rows_stays_abuse(spark, material):
    """Exact and slightly other wordings than the rated ones, in plain spelling and without marks of an outburst."""
    rated, pages = material
    rated = rated + [("You are a coward and everyone knows it.", 1)]
    for bad in ("You are a coward and everyone knows it.", "What a worthless coward you are."):
        docs = [(i, "s", f"{t} {bad}" if i % 3 == 0 else t) for i, t in pages]
        docs = spark.createDataFrame(docs, "doc_id long, source string, text string")
        labels = spark.createDataFrame([(t, "abusive" if v > 0 else "none") for t, v in rated], "sample_text string, label string")
        model = train_on(docs, labels)
        got = {x["doc_id"] for x in score_documents(docs, model).where(f"score >= {model.threshold}").collect()}
        assert {i for i, _ in pages if i % 3 == 0} <= got and len(got) <= 134 + 40, bad
