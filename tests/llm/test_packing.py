import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm.packing import best_fit, counter, pack_texts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit(sizes):
    bins = best_fit(sizes, 50)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    used = [sum(sizes[k] for k in b) for b in bins]
    assert all(u <= 50 for u in used) and len(bins) <= 11 / 9 * -(-sum(sizes) // 50) + max(4, sum(s > 25 for s in sizes))


def texts(n):
    rng = random.Random(1)
    words = "the old harbour moved a bridge near seven lamps".split()
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("per_task", [20, 40_000])
def test_whole_and_within_capacity(spark, per_task):
    count = counter()
    rows = [(i, t, "n", 1) for i, t in enumerate(texts(400))] + [(1000, None, "n", 1), (1001, "", "n", 1), (None, "x", "n", 1), (1002, "a " * 30_000, "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pack_name string, used int").repartition(4)
    packs = spark.createDataFrame([("s", 64), ("l", 512), ("s", 64), (None, 5), ("z", None), ("q", 0)], "pack_name string, capacity_tokens int")
    got = pack_texts(docs, packs, items_per_task=per_task).collect()
    sizes = {i: count(t) for i, t, *_ in rows if i is not None and t}
    for name, capacity in (("s", 64), ("l", 512)):
        mine = [r for r in got if r["pack_name"] == name]
        parts, bins = {}, {}
        for r in mine:
            parts.setdefault(r["doc_id"], []).append((r["part"], r["start"], r["n_tokens"]))
            bins.setdefault(r["container"], []).append(r)
        assert set(parts) == set(sizes)
        for i, p in parts.items():
            p.sort()
            assert sum(n for _, _, n in p) == sizes[i] and len(p) == -(-sizes[i] // capacity)
            assert [(k, k * capacity) for k in range(len(p))] == [(a, b) for a, b, _ in p]
        assert all(sum(r["n_tokens"] for r in b) == b[0]["used"] <= capacity for b in bins.values())
        assert len(bins) <= 1.05 * -(-sum(sizes.values()) // capacity) + 1
    assert {r["pack_name"] for r in got} == {"s", "l"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_texts(docs, spark.createDataFrame([("s", 64)], "pack_name string, capacity_tokens int")).count() == 0
    assert pack_texts(spark.createDataFrame([(1, "a")], docs.schema), spark.createDataFrame([], "pack_name string, capacity_tokens int")).count() == 0


def test_executors_need_not_have_the_tokenizer(spark, tmp_path):
    """A vocabulary that only the driver has is brought along; a second packing finds it again."""
    from netloom.llm.packing import TOKENIZER

    own = tmp_path / "vocabulary.tiktoken"
    own.write_bytes(open(TOKENIZER, "rb").read())
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    packs = spark.createDataFrame([("s", 64)], "pack_name string, capacity_tokens int")
    for _ in range(2):
        assert {r["doc_id"] for r in pack_texts(docs, packs, tokenizer=str(own)).collect()} == {1, 2}
    spark.sparkContext.addFile(str(own))
    own.unlink()
    assert counter(str(own))("one two three") == counter()("one two three")
