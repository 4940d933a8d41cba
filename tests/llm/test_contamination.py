import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm.contamination import Index, Leaks, aligned, leaked_items, longest_carried, may_carry, words_of

WORDS = [f"{a}{b}" for a in ("har", "bri", "lam", "tor", "vel", "gan", "mus", "pel") for b in ("bour", "dge", "ps", "quin", "vet", "den", "tard", "lo", "ric", "sam")]


def passage(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(p, text, edits):
    """Most words carried, over all stretches of the text and pieces of the passage, by plain edit distance."""
    best = 0
    for i in range(len(p)):
        for a in range(len(text)):
            cost = {(0, 0): (0, 0)}
            for x in range(len(p) - i + 1):
                for y in range(len(text) - a + 1):
                    options = []
                    if x and (x - 1, y) in cost:
                        options.append((cost[x - 1, y][0] + 1, cost[x - 1, y][1]))
                    if y and (x, y - 1) in cost:
                        options.append((cost[x, y - 1][0] + 1, cost[x, y - 1][1]))
                    if x and y and (x - 1, y - 1) in cost:
                        same = p[i + x - 1] == text[a + y - 1]
                        options.append((cost[x - 1, y - 1][0] + (not same), cost[x - 1, y - 1][1] - same))
                    if options:
                        cost[x, y] = min(options)
                        e, m = cost[x, y]
                        if -m >= (edits - 1) * e:
                            best = max(best, -m)
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=9), st.lists(st.integers(1, 5), min_size=1, max_size=9))
def test_alignment_is_never_too_generous(p, t):
    assert longest_carried(np.array(p), np.array(t), 4) <= brute(p, t, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), min_size=1, max_size=9))
def test_judge_is_the_brute_force(p, t):
    best = brute(p, t, 4)
    p, t = np.array(p), np.array(t)
    assert aligned(p, t, 4) <= longest_carried(p, t, 4) == best
    assert may_carry(p, t, 4, best)


def test_words_that_did_not_leak_do_not_pull_on_the_stretch():
    """Stretches of exactly 40 % are accepted, though the rest of the passage finds its common words around them."""
    rng = random.Random(5)
    common = "the a and of to in it is".split()
    mixed = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(n)]
    index = Index([mixed(60) for _ in range(150)], Leaks())
    vocabulary = {v: k for k, v in index.vocabulary.items()}
    for k, p in enumerate(index.passages):
        at = rng.randrange(len(p) - 24 + 1)
        text = mixed(80) + [vocabulary[i] for i in p[at : at + 24].tolist()] + mixed(80)
        assert index.leaks(np.array([index.vocabulary.get(w, 0) for w in text], np.int32), k)


def test_alignment_of_whole_and_part():
    rng = random.Random(0)
    p = list(range(1, 61))
    assert longest_carried(np.array(p), np.array([99] * 9 + p + [98] * 9), 8) == 60
    assert longest_carried(np.array(p), np.array([99] * 30 + p[20:50] + [98] * 30), 8) == 30
    edited = p[:10] + [97] + p[11:30] + p[31:45] + [96] + p[45:]
    assert longest_carried(np.array(p), np.array(edited), 8) == 58
    shuffled = p[:]
    rng.shuffle(shuffled)
    assert longest_carried(np.array(p), np.array(shuffled), 8) < 8


def test_words():
    noisy = "<p>The&nbsp;old har-\nbour&#8203; MOVED</p> a cafÃ©&#160 “café” it's &Nbsp;now"
    assert words_of(noisy) == "the old harbour moved a caf caf its now".split()
    assert words_of("") == [] and words_of("…!") == []
    assert words_of("it held that a < b and c > d, <img alt='x' " + "y" * 400 + ">so <!-- a > b --> there") == "it held that a b and c d so there".split()


@pytest.mark.parametrize("text, words", [("Это утечка", ["это", "утечка"]), ("試験の問題", list("試験の問題")), ("Η διαρροή του", ["η", "διαρροή", "του"]), ("naïve café", ["nave", "caf"])])
def test_words_of_other_scripts_survive_wrong_decoding(text, words):
    wrong = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    assert words_of(text) == words_of(text.upper()) == words_of(wrong) == words


@pytest.mark.parametrize("sizes", [(28, 60, 120), (28,), (12, 14), (300, 700)])
def test_search_keeps_recall_at_the_edge_of_the_definition(sizes):
    """Judged by alignment alone, stretches of 40 to 45 % with up to one word in eight changed are found."""
    rng = random.Random(8)
    how = Leaks()
    passages = [passage(rng, rng.choice(sizes)) for _ in range(80)]
    found = total = 0
    for width in {how.width(len(p)) for p in passages}:
        own = [p for p in passages if how.width(len(p)) == width]
        index = Index(own, how)
        assert index.planted_recall >= how.recall
        for k, words in enumerate(own):
            n = -(-len(words) * rng.choice([41, 45]) // 100)
            at = rng.randrange(len(words) - n + 1)
            part = words[at : at + n]
            for e in range(rng.randrange(2, 8), n - 2, rng.choice([8, 9, 10])):  # changed, dropped or added
                part[e] = rng.choice(["zz", "", part[e] + " zz", rng.choice(WORDS)])
            text = passage(rng, 80) + " ".join(part).split() + passage(rng, 80)
            ids = np.array([index.vocabulary.get(w, 0) for w in text], np.int32)
            if longest_carried(index.passages[k], ids, 8) >= how.least(len(words)):
                total += 1
                found += (0, k) in index.search([ids])
    assert total > 30 and found >= 0.98 * total


def test_runs_of_three_words_never_lose_a_leak():
    """The count asked for before alignment is met by every leak."""
    rng = random.Random(3)
    how = Leaks()
    for n in range(1, 200):
        p = list(range(n))
        part = p[: rng.randrange(how.least(n), n + 1)]
        for _ in range(len(part) // 8 + 1):
            place = rng.randrange(len(part))
            part[place : place + rng.randrange(2)] = [-1] * rng.randrange(2)
        if longest_carried(np.array(p), np.array(part), how.edits) >= how.least(n):
            runs = sum(a + 1 == b and b + 1 == c and a >= 0 for a, b, c in zip(part, part[1:], part[2:]))
            assert runs >= how.triples(n)


@pytest.mark.parametrize("block", [1, 5000])
def test_leaks(spark, block):
    rng = random.Random(2)
    a, b = passage(rng), passage(rng)
    items = [(1, " ".join(a), "x", 1), (2, " ".join(a).upper(), "x", 1), (3, " ".join(b), "x", 1), (4, None, "x", 1), (None, " ".join(b), "x", 1), (5, "", "x", 1), (3, " ".join(b), "x", 1)]
    mixed = a[:]
    rng.shuffle(mixed)
    docs = [
        (10, " ".join(passage(rng) + a + passage(rng))), (11, "<b>" + "&nbsp;\n".join(b[10:45]) + "</b>"), (12, " ".join(passage(rng) + mixed)), (13, " ".join(a[:15] + passage(rng))),
        (14, None), (15, ""), (None, " ".join(a)), (16, " ".join(passage(rng, 120_000) + a + b)), (10, " ".join(a)),
    ]
    got = leaked_items(
        spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, passage string, text string, doc_id int"), block=block
    )
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(10, 1), (10, 2), (11, 3), (16, 1), (16, 2), (16, 3)]


def test_passages_of_all_lengths_and_scripts_at_once(spark):
    """Classes by length and blocks by number are searched in one pass over the corpus."""
    rng = random.Random(4)
    other = "в этом году старый завод у реки снова открыл музей и школу для детей из соседнего города после долгого ремонта зимой".split()
    passages = [passage(rng, n) for n in (5, 9, 16, 28, 90, 400)] + [other]
    docs = [(k, " ".join(passage(rng) + p + passage(rng))) for k, p in enumerate(passages)]
    docs.append((90, "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in " ".join(other[4:14]).encode())))
    items = [(k, " ".join(p)) for k, p in enumerate(passages)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), block=2)
    got = {(r["item_id"], r["doc_id"]) for r in got.collect()}
    assert {(k, k) for k in range(7)} | {(6, 90)} <= got and all(len(passages[i]) < 28 for i, d in got if i != d and d != 90)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, passage string")
    assert leaked_items(docs, items).count() == 0
    assert leaked_items(docs.limit(0), spark.createDataFrame([(1, "a b c")], items.schema)).count() == 0
