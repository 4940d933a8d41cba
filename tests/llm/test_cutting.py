import random
import re
import time
import unicodedata

from netloom.llm import queries, toxicity
from netloom.llm.text import MOJIBAKE, decoded

SIGNS = "aaabcdezAEZ015@$*_ .-·!?…\n\t'\"”’)éÃ©¤Âå\xad​а\x85–ﬁ²½߀𝐚𐐨İſ9:<>b/ ÀÂ€â„¢ôÿ"


def least(make, texts):
    """CPU seconds, the least of several times."""
    took = []
    for _ in range(5):
        began = time.thread_time()
        for t in texts:
            make(t)
        took.append(time.thread_time() - began)
    return min(took)


def test_cutting_costs_little():
    """p9_found cuts all documents, so that this is most of its work: it took 3.4 times as long as finding the words, and takes about 2.2 (measured)."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("etaoinshrdluåäéö", k=rng.randrange(1, 9)))
    page = lambda: " ".join(" ".join(word() for _ in range(11)).capitalize() + rng.choice([".", ".", "!", "?", ",", ".\n"]) for _ in range(25))
    texts = [page() for _ in range(300)]
    assert least(toxicity.pieces, texts) < 2.75 * least(re.compile(r"\w+").findall, texts)


def test_signs_of_disguise_are_those_of_the_expressions():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices(SIGNS, k=rng.randrange(26)))
        assert toxicity._odd(t) == toxicity._odd_beyond(t, t.lower()), ascii(t)
        t = t.replace("<", "")
        text = decoded(t) if MOJIBAKE.search(t) else t
        shown = bool(toxicity._HIDDEN.search(text) or toxicity._LOOKS.search(text)) and not t.isascii()
        got = toxicity.pieces(t)
        assert all(bool(odd & toxicity.LOOKS) == shown for _, odd in got), ascii(t)
        if not shown:
            plain = toxicity._ACCENT.sub("", unicodedata.normalize("NFKD", text))
            assert "".join("".join(p for p, _ in got).split()) == "".join(plain.split()), ascii(t)


def test_documents_are_cut_once(spark, tmp_path):
    """p9_scores, p9_found and p9_rates score what was cut for the fits and don't read the texts again; the scores are those of the texts."""
    rng = random.Random(4)
    tame = lambda: f"The {rng.choice(['harbour', 'bridge', 'garden'])} was {rng.choice(['moved', 'painted', 'counted'])} by the {rng.choice(['clerk', 'council', 'mayor'])}."
    bad = lambda: f"Shut up you {rng.choice(['stupid', 'rotten', 'worthless'])} {rng.choice(['idiot', 'coward', 'halfwit'])}!!!"
    texts = [" ".join(tame() for _ in range(4)) + f"\n{bad()}" * (k % 10 == 0) for k in range(200)] + [None, "", "<b></b> ...", "\n", "You st*pid idi0t!!! You st*pid idi0t!!!"]
    docs = [(k, "s" if k % 2 else None, t) for k, t in enumerate(texts)] + [(None, "s", texts[0]), (7, "s", texts[10])]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(bad(), "abusive") for _ in range(40)] + [(tame(), "none") for _ in range(40)]
    spark.createDataFrame(labels, "sample_text string, label string").write.parquet(f"{tmp_path}/abuse_labels.parquet")
    scored = queries.p9_scores(spark, str(tmp_path))
    for df in (scored, queries.p9_found(spark, str(tmp_path)), queries.p9_rates(spark, str(tmp_path))):
        assert df.inputFiles() and not any("documents.parquet" in x for x in df.inputFiles())
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = toxicity.cut_documents(read)
    model = toxicity.train_on_cut(cut, spark.read.parquet(f"{tmp_path}/abuse_labels.parquet"))
    kept = lambda df: sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["source"] or "", round(x["score"], 9)) for x in df.collect()))
    got = kept(toxicity.score_cut(cut, model))
    assert got == kept(toxicity.score_documents(read, model)) and len(got) == len(docs)
    assert [x[:3] for x in kept(scored)] == [x[:3] for x in got]
    assert [x[3] for x in got if x[1] in (200, 201)] == [0.0, 0.0]
    segs = {(" ".join(w), m) for _, _, t in docs if t for w, m in toxicity.segments(t)}
    assert {(x["words"], x["marks"]) for x in cut.selectExpr("inline(segments)").collect()} == segs
    assert cut.selectExpr("inline(segments)").groupBy().sum("times").first()[0] == sum(len(toxicity.segments(t)) for _, _, t in docs if t)
