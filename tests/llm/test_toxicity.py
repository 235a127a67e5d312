import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.llm import toxicity
from cohortscope.llm.catalog import op1_noisy_channel_toxicity, table
from helpers import no_docs, odd_docs, shipped  # noqa: F401

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def chars(spark):
    from cohortscope.llm.common import prepare

    prepare(spark)
    return toxicity.train_char_model(table(spark, SF, "documents"))


@pytest.mark.parametrize("seen,read", [
    ("1d10t", "idiot"), ("idiiiiot", "idiot"), ("i.d.i.o.t", "idiot"), ("st*pid", "stupid"), ("m0r0n", "moron"),
    ("cl0wn", "clown"), ("l0$er", "loser"), ("7ra$h", "trash"), ("path3tic", "pathetic"), ("stuuupid", "stupid"),
    ("tr@sh", "trash"), ("moron", "moron"),
])
def test_restores_disguised_words(chars, seen, read):
    assert toxicity.restore(seen, chars) == read


def test_viterbi_finds_the_best_path(chars):
    """The path equals the best of all readings, enumerated."""
    from itertools import product

    def cost(text):
        a = b = 0
        total = 0.0
        for c in text + " ":
            k = 0 if c == " " else toxicity._LETTER[c]
            total += float(chars.logp[a, b, k])
            a, b = (0, 0) if k == 0 else (b, k)
        return total

    for token in ("1d10t", "5tup1d", "b0o", "a11", "m.0.r"):
        lattice = toxicity._readings(token)
        best = max((cost("".join(o for o, _ in p)) - sum(x for _, x in p), "".join(o for o, _ in p)) for p in product(*lattice))
        assert toxicity.restore(token, chars) == best[1]


def test_spaced_letters_become_a_word(spark, chars):
    docs = spark.createDataFrame([(1, "you are an i d i o t, sir"), (2, "a normal line")], "doc_id long, text string")
    model = toxicity.ToxicityModel(chars, np.zeros(1 << toxicity.FEATURE_BITS, np.float32), 0.0)
    got = {r.doc_id: r.restored for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    assert [x.read for x in got[1]] == ["idiot"] and got[2] == []


def test_held_out_accuracy(spark):
    pred = op1_noisy_channel_toxicity(spark, SF).filter("held_out")
    truth = table(spark, SF, "labels").select("doc_id", "toxic")
    rows = pred.join(truth, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.01


def test_disguised_toxic_documents_are_caught(spark, chars):
    docs = table(spark, SF, "documents")
    model = toxicity.train_toxicity(docs, table(spark, SF, "labels"), chars)
    seen = ["you 1d10t m0r0n", "what a l0$er and cl0wn", "such tr@sh, st*pid", "i d i o t and l.o.s.e.r"]
    rows = [(k, s) for k, s in enumerate(seen)] + [(10, "the and of in to that is"), (11, "")]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(
        spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert all(got[k] >= 0.7 for k in range(4)) and got[10] < 0.5 and got[11] < 0.5


def test_odd_and_empty_tables(spark, chars):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (7, 0, 0), (8, 0, 0), (8, None, None), (None, 1, 1), (99, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    model = toxicity.train_toxicity(docs, labels, chars)
    got = toxicity.score_toxicity(docs.drop("score"), model, ["doc_id", F.col("norm")]).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train_toxicity(no_docs(spark), labels, toxicity.train_char_model(no_docs(spark)))
    assert toxicity.score_toxicity(no_docs(spark), none, ["doc_id"]).collect() == []
    assert all(r.score < 0.01 for r in toxicity.score_toxicity(docs, none, ["doc_id"]).collect())


def readings(spark, chars, texts):
    model = toxicity.ToxicityModel(chars, np.zeros(1 << toxicity.FEATURE_BITS, np.float32), 0.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.restored for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    return [" ".join(x.read for x in got[k]).split() for k in range(len(texts))]


def test_disguises_of_any_length_are_read(spark, chars):
    said = "you are such an idiot and a loser that this is all that there is to say about you and the trash"
    bare = said.replace(" ", "")
    spaced, run, joined, hyphens, long = readings(spark, chars, [
        " ".join(bare), "what an " + "i" * 60 + "diot", "you.are.such.an.idiot.and.this.is.what.they.say.about.you",
        "you-are-such-an-1d10t-and-this-is-what-they-say-about-you", " ".join(bare * 40)])
    assert "".join(spaced) == bare and any(w.startswith("idiot") for w in spaced)
    assert run == ["idiot"] and "idiot" in joined and "idiot" in hyphens
    assert "".join(long) == bare * 40 and sum(w.startswith("idiot") for w in long) >= 35


def test_lower_case_words_of_letters_are_read(spark, chars):
    """Look-alike letters and doubled letters pass through the scoring."""
    lookalike, capital, doubled, both, triple = readings(spark, chars, [
        "what an idi\u043et", "What an IDI\u041eT", "what an iiddioott he is", "a mm\u043er\u043en", "an iiiidiot"])
    assert lookalike == capital == doubled == triple == ["idiot"] and both == ["moron"]


@pytest.mark.parametrize("copies", [1, 40, 4000])
def test_a_disguise_is_read_however_often_it_occurs(spark, copies):
    """The corpus that the character model learns from holds the disguises many times over."""
    said = "what an iiddioott he is, such an id\u0456ot and mmoorroonn"
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text")
    disguised = spark.range(copies).select(F.lit(said).alias("text"))
    model = toxicity.train_char_model(docs.unionByName(disguised))
    (read,) = readings(spark, model, [said])
    assert read == ["idiot", "idiot", "moron"]


def test_genuine_doubled_letters_stay_features(spark, chars):
    """Frequent words of the corpus with doubled letters: few get a second reading, and the word
    itself counts beside it."""
    texts = table(spark, SF, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    frequent = texts.filter(F.col("w").rlike(r"([a-z])\1")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(300)
    words = [r.w for r in frequent.collect()]
    read = readings(spark, chars, words)
    assert sum(bool(r) for r in read) / len(words) < 0.5
    model = toxicity.ToxicityModel(chars, np.ones(1 << toxicity.FEATURE_BITS, np.float32), 0.0)
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    assert all(s > 0.5 for s in scores.values())


def test_model_does_not_depend_on_the_layout(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    a, b = (toxicity.train_char_model(docs.repartition(n)) for n in (1, 13))
    assert np.array_equal(a.logp, b.logp)
