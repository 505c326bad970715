import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamlens.llm.abuse import THRESHOLD, FactorizationMachine, _sentence_sets, _sentences, canonical, fit, labelled_bags, pieces, scored_documents, source_rates, term_ids

DOCUMENTS = "doc_id long, text string, source string, score double, words string"
LABELS = "doc_id long, toxic int, rater string, text string"


@pytest.mark.parametrize(("word", "want"), [("IDIOT", "idiot"), ("m0ron", "moron"), ("іdiоt", "idiot"), ("cl0wn", "clown"), ("idiooooot", "idiot"), ("p@r@s1te", "parasite"), ("идиот", "идиот"), ("250ms", "250ms")])
def test_canonical_words(word, want):
    assert canonical(word) == want


def test_terms_of_a_word():
    assert set(term_ids("morons")) & set(term_ids("moron")) and set(term_ids("morons")) != set(term_ids("moron"))
    assert set(term_ids("m*ron")) & set(term_ids("b*****d"))
    assert set(term_ids("m0ron")) > set(term_ids("moron"))
    assert term_ids("250") == term_ids("7.5") == term_ids("")


def sentences(spark, text):
    """The sets of terms of the sentences of a text."""
    cut = spark.range(1).select(pieces(F.lit(text)).alias("p")).first().p
    ids, begins, owner = _sentence_sets(pa.array([[], list(cut), None], pa.list_(pa.string())))
    assert set(owner) <= {1}
    return [set(s) for s in np.split(ids, begins[1:])] if len(begins) else []


def test_sentences_and_hidden_spelling(spark):
    terms = lambda *ws: {i for w in ws for i in term_ids(w)}
    assert sentences(spark, "You i.d.i.o.t! Go now.") == [terms("You", "idiot"), terms("Go", "now")]
    assert sentences(spark, "mo\u200bron s c u m") == [terms("mo\u200bron", "scum")]
    assert sentences(spark, "It goes\n * on, here\nBut not there") == [terms("It", "goes", "on", "here"), terms("But", "not", "there")]
    assert sentences(spark, 'he said "go" `x`') == [terms("he", "said", '"', "go", "`", "x")]
    assert sentences(spark, "") == [] and sentences(spark, "?! ...") == []


def test_quoted_text_of_any_length_is_kept(spark):
    assert len(sentences(spark, '"' + "word " * 500 + 'end" and `' + "code " * 500 + "stop`")[0]) > len(set(term_ids("word")) | set(term_ids("end")))


def test_scores_against_the_definition():
    rng = np.random.default_rng(1)
    fm = FactorizationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    sets = [[1, 5, 9], [7], list(range(20, 40))]
    ids, begins = np.concatenate([np.array(s) for s in sets]), np.array([0, 3, 4])
    want = []
    for s in sets:
        x = np.sqrt(8 / max(len(s), 8))
        want.append(0.3 + sum(fm.weights[i] * x for i in s) + sum(fm.factors[i] @ fm.factors[j] * x * x for a, i in enumerate(s) for j in s[a + 1 :]))
    assert np.allclose(fm.scores(ids, begins), want)


def test_a_term_counts_once_a_sentence(spark):
    """Runs of base64 held the mark of a disguised word hundreds of times and scored by that."""
    cut = spark.range(1).select(pieces(F.lit("the The m0ron id1ot 4bc5de 12 3.5 moron. You m0ron")).alias("p")).first().p
    lists = pa.array([list(cut)], pa.list_(pa.string()))
    ids, begins, _ = _sentence_sets(lists)
    sets = np.split(ids, begins[1:])
    assert [len(s) for s in sets] == [len(set(s)) for s in sets] and len(sets) == 2
    rng = np.random.default_rng(2)
    fm = FactorizationMachine(0.1, rng.normal(size=1 << 16), rng.normal(size=(1 << 16, 4)))
    assert np.allclose(fm.scores_of_words(*_sentences(lists)[:3]), fm.scores(ids, begins), atol=1e-4)


def test_rare_harmless_sentences_outweigh_their_number():
    """A few labelled sentences that share their words with abusive ones, among many others, are not flagged."""
    rng = np.random.default_rng(3)
    bag = lambda *ws: [tuple(sorted({i for w in ws for i in term_ids(w)}))]
    some = lambda n: [f"word{i}" for i in rng.choice(300, n)]
    harmless = [(0, bag("drop", "the", "dead", *some(1))) for _ in range(12)]
    fm = fit([(1, bag("drop", "dead", "you", *some(2))) for _ in range(60)] + harmless + [(0, bag("the", *some(5))) for _ in range(6000)])
    score = lambda b: fm.scores(np.array(b[0]), np.array([0]))[0]
    assert not [b for _, b in harmless if score(b) >= 0]
    assert sum(score(bag("drop", "dead", "you", *some(2))) > 0 for _ in range(20)) >= 19


def test_interactions_are_learnt():
    words = {w: term_ids(w) for w in "dog cat red blue".split()}
    bag = lambda *ws: [tuple(sorted({i for w in ws for i in words[w]}))]
    data = [(1, bag("dog", "red")), (1, bag("cat", "blue")), (0, bag("dog", "blue")), (0, bag("cat", "red"))] * 40
    fm = fit(data)
    score = lambda b: fm.scores(np.array(b[0]), np.array([0]))[0]
    assert min(score(bag("dog", "red")), score(bag("cat", "blue"))) > max(score(bag("dog", "blue")), score(bag("cat", "red")))


def test_held_out_labels(spark, sf):
    """Four folds of all labels; what the README says of them is measured here."""
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").cache()
    hit = flagged = wanted = 0
    for fold in range(4):
        held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == fold)
        scored = scored_documents(labelled, labels.join(held.select("doc_id").distinct(), "doc_id", "left_anti"))
        rows = scored.join(held.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("y")), "doc_id").where("y <> 0.5").dropDuplicates(["doc_id"]).collect()
        hit += sum(r.score >= THRESHOLD and r.y > 0.5 for r in rows)
        flagged, wanted = flagged + sum(r.score >= THRESHOLD for r in rows), wanted + sum(r.y > 0.5 for r in rows)
    labelled.unpersist()
    assert wanted >= 80 and hit / wanted >= 0.8 and hit / flagged >= 0.85, (hit, wanted, flagged)


def test_null_empty_repeated_unlabelled_and_clashing(spark):
    docs = spark.createDataFrame([(1, "You are an idiot.", None, 9.0, "x"), (1, "You are an idiot.", None, 9.0, "x"), (2, None, "s", 9.0, "x"), (3, "", "s", 9.0, "x"), (4, "The cache is rebuilt after a restart.", "s", 9.0, "x"), (5, "you are an idiot " * 5000, "s", 9.0, "x")], DOCUMENTS)
    taught = [(10 + i, "You are an idiot." if i % 2 else "The tree is rebuilt after a commit.", "t", 9.0, "x") for i in range(40)]
    labels = spark.createDataFrame([(1, None, "a", ""), (4, 0, "a", ""), (4, 1, "b", ""), (None, 1, "a", "")] + [(10 + i, i % 2, "a", "") for i in range(40)], LABELS)
    scored = scored_documents(docs.union(spark.createDataFrame(taught, DOCUMENTS)), labels).where("doc_id < 10")
    assert [(r.doc_id, r.score >= THRESHOLD) for r in scored.orderBy("doc_id").collect()] == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True)]
    assert {r.source: (r.n_documents, r.n_flagged) for r in source_rates(scored).collect()} == {None: (2, 2), "s": (4, 1)}
    assert scored_documents(docs, labels.where("false")).where(F.col("score") >= THRESHOLD).count() == 0
    assert scored_documents(docs.where("false"), labels.where("false")).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "some text", None, 0.0, "") for i in range(20)], DOCUMENTS)
    labels = spark.createDataFrame([(i, 0, "a", "") for i in range(20)], LABELS)
    assert len(labelled_bags(docs, labels, max_labelled=7)) == 7
