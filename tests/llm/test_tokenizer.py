import random

import pytest
from pyspark.sql import functions as F

from loamlens.llm.tokenizer import VOCABULARY, TokenAutomaton, automaton, decoded, encoded, token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def odd_texts(n=400, seed=5):
    rng = random.Random(seed)
    pools = [range(32, 127), range(0xA0, 0x500), range(0x3040, 0x30FF), range(0x4E00, 0x4F00), range(0x1F600, 0x1F640), [9, 10, 13, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 32, 32], range(0x16000, 0x16F00)]
    return ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(80))) for _ in range(n)]


SPECIAL = ["", " ", "\n\n  x", "aaaa" * 300, " " * 2000, "<|endoftext|> is text", "don't we'll I'VE", "x" * 100_000, "ab" * 5000, "naïve ﬁne ½ 𝓢", "it's  \t end "]


def test_ids_are_those_of_the_public_tokenizer(spark, public):
    texts = SPECIAL + odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in encoded(df).collect()}
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_documents_and_round_trip(spark, sf, public):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ids = encoded(docs)
    rows = {r.doc_id: list(r.ids) for r in ids.collect()}
    for r in docs.collect():
        assert rows[r.doc_id] == public.encode(r.text or "", add_special_tokens=False).ids
    back = ids.join(docs, "doc_id").select((decoded(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))
    assert back.where("NOT same").count() == 0


def test_null_empty_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 1, [9]), (1, "", 2, [9]), (None, "ab", 3, [9])], "doc_id long, text string, key int, ids array<int>")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encoded(df).collect()), key=str)
    assert [x for x in got if x[0] == 1] == [(1, []), (1, [])]
    assert [x[1] for x in got if x[0] == 0] == [automaton().encode("ab")]
    assert sorted(r.n_tokens for r in token_counts(df).collect()) == sorted([0, 0, len(automaton().encode("ab"))])
    assert encoded(df.where("false")).count() == 0


def greedy(word, merges):
    """Byte-pair encoding as it is defined: merge the pair of the least rank, the first of its places, again and again."""
    parts = [bytes([b]) for b in word]
    ranks = {m: i for i, m in enumerate(merges)}
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_gadgets_of_random_merges_accept_the_greedy_encoding_only(seed):
    rng = random.Random(seed)
    known, merges = [b"a", b"b", b"c"], []
    while len(merges) < 25:
        pair = (rng.choice(known), rng.choice(known))
        if pair not in merges and pair[0] + pair[1] not in known:
            merges.append(pair)
            known.append(pair[0] + pair[1])
    letters = {bytes([b]): c for c, b in __import__("loamlens.llm.tokenizer", fromlist=["x"]).byte_letters().items()}
    spell = lambda t: "".join(letters[bytes([b])] for b in t)
    vocabulary = {spell(bytes([b])): b for b in range(256)} | {spell(a + b): 256 + i for i, (a, b) in enumerate(merges)}
    machine = TokenAutomaton(vocabulary, [(spell(a), spell(b)) for a, b in merges])
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randrange(1, 12)))
        assert [machine.label[i] for i in machine.word(word)] == greedy(word.encode(), merges)


def test_a_run_over_met_arcs_looks_up_only(public, monkeypatch):
    machine = TokenAutomaton.load(VOCABULARY)
    words = ["encodeSegmentHarbor", "unparsable", "idiosyncrasy", "x" * 300, "ab" * 99, "0x1fe3c"]
    first = [machine.word(w) for w in words]
    machine.known.clear()
    monkeypatch.setattr(machine, "open", None)
    assert [machine.word(w) for w in words] == first == [tuple(public.encode(w).ids) for w in words]
    assert machine.entries == sum(len(row) for row in machine.table.values()) > 0
