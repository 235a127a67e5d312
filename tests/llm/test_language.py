import numpy as np
from pyspark.sql import functions as F

from cohortscope.llm import language
from cohortscope.llm.catalog import op8_hyperdimensional_language, table
from helpers import no_docs, odd_docs, shipped  # noqa: F401

SF = "/root/testdata/sf0.01"


def grams(text):
    """Letter trigrams of a text, other characters as one boundary: the plain way."""
    import unicodedata

    out = [0]
    for c in text.lower():
        k = ord(c) if unicodedata.category(c)[0] in "LM" else 0
        if k or out[-1]:
            out.append(k)
    if out[-1]:
        out.append(0)
    return [tuple(out[k:k + 3]) for k in range(len(out) - 2)]


def vector(text, dim, seed):
    v = np.zeros(dim)
    for a, b, c in grams(text):
        x, y, z = (language._letter(k, dim, seed).astype(float) for k in (a, b, c))
        v += np.roll(x, 2) * np.roll(y, 1) * z
    return v


def test_vectors_against_brute_force():
    texts = ["Hello, wörld! a", "x", "", "12", "naïve  Ünïcode\0text", "日本語テスト"]
    firsts, gram, parts, has = language._ngrams(texts, 3)
    got = language._bundle(firsts, gram, parts, 64, 5)
    assert has.tolist() == [True, True, False, False, True, True]
    for t, v in zip(texts, got):
        assert np.allclose(v, vector(t, 64, 5))


def test_prototypes_and_scores_against_brute_force(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the house", "en"),
            (4, None, "en"), (5, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language.train_profiles(docs, dim=128)
    assert p.languages == ["de", "en"]
    en = vector(rows[0][1], 128, 11) + vector(rows[2][1], 128, 11)
    assert np.allclose(p.vectors[1], en / np.linalg.norm(en), atol=1e-6)
    got = {r.doc_id: r for r in language.identify(docs, p, ["doc_id"]).collect()}
    de, v = vector(rows[1][1], 128, 11), vector("the", 128, 11)
    cos = [max(0, v @ x / np.linalg.norm(v) / np.linalg.norm(x)) for x in (de, en)]
    assert got[5].lang_pred == p.languages[int(np.argmax(cos))] and abs(got[5].score - max(cos)) < 1e-5
    assert (got[4].lang_pred, got[4].score) == ("und", 0.0)


def test_held_out_accuracy(spark):
    pred = op8_hyperdimensional_language(spark, SF)
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    both = pred.filter("held_out").join(truth, "doc_id")
    share = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    p = language.train_profiles(docs)
    got = language.identify(docs.drop("score", "lang_pred"), p, ["doc_id", "norm"]).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 6}
    none = language.train_profiles(no_docs(spark))
    assert none.languages == []
    assert {r.lang_pred for r in language.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert language.identify(no_docs(spark), p, ["doc_id"]).collect() == []
