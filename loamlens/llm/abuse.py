"""Abusive, hateful or sexual content."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many labelled documents, the first by a hash of their id, are used to fit the model.
MAX_LABELLED = 20_000
#: The share of the sentences without abuse that a pass of the fit looks at, drawn anew for each pass, besides those from this score on.
NEGATIVE_SHARE = 0.25
HARD_SCORE = -1.0
#: How many times as much a sentence without abuse weighs each time it is found to score so high, up to an abusive one.
HARD_FACTOR = 8.0
#: How many times as much as the others the sentences taken for abusive weigh together, before the former are found.
POSITIVE_WEIGHT = 4.0
DIMENSIONS = 1 << 16
FACTORS = 8

# Letters that look like Latin ones, signs that stand for letters, signs that aren't shown, marks of quotation.
_LOOKALIKES = dict(zip("аеорсухікмтнвѕјԁһӏαοερτυνικχ", "aeopcyxikmtnbsjdhlaoeptuvikx", strict=True))
_SIGNS = dict(zip("0134578@$+!|", "oieastbastiil"[:12], strict=True))
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"
QUOTATION = "\"“”«»„"


def canonical(word: str) -> str:
    """``word`` in plain lower-case letters: look-alikes, signs for letters and stretched letters are put back."""
    w = unicodedata.normalize("NFKC", word.translate(_NOT_SHOWN)).lower().strip("'’!*+|$@")
    if any("a" <= c <= "z" for c in w) or any(c in _SIGNS for c in w):
        if any(c in _LOOKALIKES for c in w) and any("a" <= c <= "z" for c in w):
            w = "".join(_LOOKALIKES.get(c, c) for c in w)
        if any(c.isalpha() for c in w) and any(c in _SIGNS for c in w) and not re.fullmatch(r"\d+\w{0,3}|\D+\d+", w):
            w = "".join(_SIGNS.get(c, c) for c in w)
    return re.sub(r"([^*])\1{2,}", r"\1", w)


_NOT_SHOWN = {ord(c): None for c in INVISIBLE}


def _hashed(*terms: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % DIMENSIONS for t in terms)


def term_ids(word: str) -> tuple[int, ...]:
    """The hashed terms of a word: itself, its first five letters, and whether it was starred or disguised."""
    if len(word) == 1 and word in QUOTATION + "`":
        return _hashed("\x00code" if word == "`" else "\x00quote")
    w = canonical(word)
    if re.fullmatch(r"[\d.,]+", w or "0"):
        return _hashed("0")
    terms = [w]
    if len(w) > 3 and w.isalpha():
        terms.append("\x01" + w[:5])
    if "*" in w:
        terms.append("\x02starred")
    elif w != word.lower():
        terms.append("\x02disguised")
    return _hashed(*terms)


_LETTER = r"\p{L}\p{M}\p{N}"
#: Words, ends of sentences, and marks of quotation and code, in one pass. A line that goes on in lower case ends nothing.
PIECES = (
    rf"[{_LETTER}][{_LETTER}@$*+|{INVISIBLE}]*+(?:![\p{{L}}\p{{N}}]++)?|[.!?…]++(?=[\s\")])|[。！？]++"
    rf"|[\r\n]++(?![ \t]*(?:[*#>-]|//+)?[ \t]*\p{{Ll}}++[ ,.])|[{QUOTATION}`]"
)
_ENDS = frozenset(".!?…。！？\r\n")


def pieces(text: Column) -> Column:
    """The words and marks of a text as an array of texts."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


@dataclass
class FactorizationMachine:
    """Score of a set of terms: bias + sum of weights + sum over all pairs of the inner products of their factors.

    The terms of a set of more than eight weigh less, so that long sentences don't score by length.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The scores of sets laid out one behind the other; none may be empty."""
        if not len(begins):
            return np.zeros(0)
        factors = self.factors[ids]
        sizes = np.diff(np.append(begins, len(ids)))
        return self._score(sizes, np.add.reduceat(self.weights[ids], begins), np.add.reduceat(factors, begins, axis=0), np.add.reduceat((factors * factors).sum(axis=1), begins))

    def scores_of_words(self, terms: list[tuple[int, ...]], which: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The scores of sentences of words, each a tuple of terms; the terms of a word are added up once for all sentences.

        What a sentence holds again, by another word, is taken off its sums.
        """
        if not len(begins):
            return np.zeros(0)
        flat, counts = _flat(terms)
        held = counts > 0
        places = (np.cumsum(counts) - counts)[held]
        weights, squares, factors = np.zeros(len(terms), np.float32), np.zeros(len(terms), np.float32), np.zeros((len(terms), self.factors.shape[1]), np.float32)
        weights[held] = np.add.reduceat(self.weights[flat], places)
        factors[held] = np.add.reduceat(self.factors[flat], places, axis=0)
        squares[held] = np.add.reduceat((self.factors[flat] ** 2).sum(axis=1), places)
        sums = [np.add.reduceat(x[which], begins, axis=0) for x in (counts, weights, factors, squares)]
        ids, _, owner, again = _spread(flat, counts, which, begins)
        if len(again):
            starts = np.flatnonzero(np.diff(owner[again], prepend=-1))
            held, more = owner[again][starts], ids[again]
            for x, of_terms in zip(sums, (np.ones(len(more), counts.dtype), self.weights[more], self.factors[more], (self.factors[more] ** 2).sum(axis=1)), strict=True):
                x[held] -= np.add.reduceat(of_terms, starts, axis=0)
        return self._score(*sums)

    def _score(self, sizes: np.ndarray, weights: np.ndarray, totals: np.ndarray, squares: np.ndarray) -> np.ndarray:
        share = np.sqrt(8 / np.maximum(sizes, 8))
        return self.bias + weights * share + 0.5 * ((totals * totals).sum(axis=1) - squares) * share**2


def _share_of(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(begins, len(ids)))
    return np.repeat(np.sqrt(8 / np.maximum(sizes, 8)), sizes)


def _laid_out(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.int64), np.cumsum(sizes) - sizes


def _log_odds(bags: list[tuple[int, list[tuple[int, ...]]]]) -> np.ndarray:
    """The log odds of each term between documents with and without abuse."""
    counts = np.zeros((2, DIMENSIONS))
    totals = [0, 0]
    for label, sentences in bags:
        totals[label] += 1
        if sentences:
            counts[label, np.unique(np.concatenate([np.array(s) for s in sentences]))] += 1
    return np.log((counts[1] + 0.25) / (totals[1] + 0.5)) - np.log((counts[0] + 0.5) / (totals[0] + 1))


def fit(bags: list[tuple[int, list[tuple[int, ...]]]], *, rounds: int = 3, passes: int = 8, negative_share: float = NEGATIVE_SHARE, rate: float = 0.05, slower: float = 0.3, decay: float = 1e-3, seed: int = 7) -> FactorizationMachine:
    """A machine fitted to documents (label, sentences as sets of terms), of which one sentence makes a document abusive.

    All sentences of documents without abuse are negative. Of an abusive document the sentence with the highest score is
    positive, chosen anew in each round among those that no document without abuse holds; the first choice is the sentence
    whose terms have the greatest log odds between the two kinds of documents. Further sentences of abusive documents are negative where
    their score is low. Each pass visits all positive sentences and a ``negative_share`` of the others, in eight batches, more if
    these would hold more than some thousand sentences. A term's value is its
    inverse document frequency among the documents, scaled to at most 1; the values are worked into the weights that are
    returned. The loss is logistic, in a pass the positive sentences weigh :data:`POSITIVE_WEIGHT` times as much as the others, minimised by Adam, whose steps
    are ``slower`` in each round, else the last ones decide on sentences that are not in each pass.

    Twice a round all sentences are scored. Negative ones from :data:`HARD_SCORE` on are visited by each of the next passes, and
    weigh :data:`HARD_FACTOR` times as much as before, up to a positive sentence: there are few of them, beside a hundred thousand others.
    """
    seen = np.bincount(np.concatenate([np.unique(np.concatenate([np.array(s) for s in b[1]])) for b in bags if b[1]] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=DIMENSIONS)
    value = np.log((len(bags) + 2) / (seen + 1)) / np.log(len(bags) + 2)
    rng = np.random.default_rng(seed)
    fm = FactorizationMachine(-2.0, np.zeros(DIMENSIONS), rng.normal(0, 0.01, (DIMENSIONS, FACTORS)))
    negatives: dict[tuple[int, ...], int] = {}
    for label, sentences in bags:
        if not label:
            for s in sentences:
                negatives[s] = negatives.get(s, 0) + 1
    harmless = [np.array(s) for s in negatives]
    odds = _log_odds(bags)
    state = [np.zeros_like(fm.weights), np.zeros_like(fm.weights), np.zeros_like(fm.factors), np.zeros_like(fm.factors)]
    step = 0
    for turn in range(rounds):
        rows: list[tuple[int, tuple[int, ...], float]] = []
        for label, sentences in bags:
            if label and sentences:
                ids, begins = _laid_out([np.array(s) for s in sentences])
                if turn:
                    z = FactorizationMachine(fm.bias, fm.weights * value, fm.factors * value[:, None]).scores(ids, begins)
                    rows += [(0, s, 0.5) for s, low in zip(sentences, z < min(-1.0, z.max() - 2), strict=True) if low]
                else:
                    z = np.add.reduceat(np.maximum(odds[ids], -2) * _share_of(ids, begins), begins)
                z = np.where([s in negatives for s in sentences], -np.inf, z)
                rows.append((1, sentences[int(np.argmax(z))], 2.0))
        y = np.array([0.0] * len(harmless) + [r[0] for r in rows])
        weight = np.array([*np.sqrt(list(negatives.values())), *(r[2] for r in rows)])
        weight[y == 1] *= POSITIVE_WEIGHT * negative_share * weight[y == 0].sum() / max(weight[y == 1].sum(), 1e-9)
        weight /= max(weight.mean(), 1e-9) if len(weight) else 1.0
        flat, starts = _laid_out(harmless + [np.array(r[1]) for r in rows])
        sizes, values = np.diff(np.append(starts, len(flat))), value[flat] * _share_of(flat, starts)
        hard = np.zeros(len(y), dtype=bool)
        for k in range(passes):
            if step and k % max(1, passes // 2) == 0:
                hard = (y == 0) & (FactorizationMachine(fm.bias, fm.weights * value, fm.factors * value[:, None]).scores(flat, starts) >= HARD_SCORE)
                weight[hard] = np.minimum(weight[hard] * HARD_FACTOR, np.maximum(weight[hard], weight[y == 1].max(initial=0)))
            visited = rng.permutation(np.flatnonzero((y == 1) | hard | (rng.random(len(y)) < negative_share)))
            for chunk in np.array_split(visited, min(len(visited), max(8, len(visited) // 1024))) if len(visited) else []:
                n = sizes[chunk]
                begins, row = np.cumsum(n) - n, np.repeat(np.arange(len(chunk)), n)
                places = (starts[chunk] - begins)[row] + np.arange(len(row))
                ids, x = flat[places], values[places]
                v = fm.factors[ids] * x[:, None]
                total = np.add.reduceat(v, begins, axis=0)
                z = fm.bias + np.add.reduceat(fm.weights[ids] * x, begins) + 0.5 * (total * total - np.add.reduceat(v * v, begins, axis=0)).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chunk]) * weight[chunk] / len(chunk)
                order = np.argsort(ids.astype(np.uint16), kind="stable")
                begins = np.flatnonzero(np.diff(ids[order], prepend=-1))
                used, e = ids[order][begins], error[row] * x
                gw = np.add.reduceat(e[order], begins) + decay * fm.weights[used]
                gv = np.add.reduceat((e[:, None] * (total[row] - v))[order], begins, axis=0) + decay * fm.factors[used]
                step += 1
                for target, g, m, s in ((fm.weights, gw, state[0], state[1]), (fm.factors, gv, state[2], state[3])):
                    m[used] = 0.9 * m[used] + 0.1 * g
                    s[used] = 0.999 * s[used] + 0.001 * g * g
                    target[used] -= rate * slower**turn * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-8)
                fm.bias -= rate * 0.1 * np.sign(error.sum()) * min(1.0, abs(error.sum()) * 10)
    return FactorizationMachine(fm.bias, fm.weights * value, fm.factors * value[:, None])


def _sentences(lists: pa.Array) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the distinct words, the words sentence by sentence, the begins of these, and the document of each.

    A word counts once per sentence, with all its terms. Three and more single letters in a row are read as one word.
    """
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False).copy()
    kinds = np.array([2 if w[0] in _ENDS else len(w) == 1 and w.isalpha() for w in words], dtype=np.int8)[which]
    terms = [() if w[0] in _ENDS else _term_cache(w) for w in words]
    opens = kinds == 2
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    sentence = np.cumsum(opens, dtype=np.int32) - 1
    single = np.flatnonzero(kinds == 1)
    if len(single):
        begins = np.flatnonzero((np.diff(single, prepend=-2) != 1) | (np.diff(sentence[single], prepend=-1) != 0))
        lengths = np.diff(np.append(begins, len(single)))
        for begin, length in zip(begins[lengths > 2], lengths[lengths > 2], strict=True):
            run = single[begin : begin + length]
            terms.append(_term_cache("".join(words[i] for i in which[run])))
            kinds[run], kinds[run[0]], which[run[0]] = 2, 0, len(terms) - 1
    by_word = np.argsort(which.astype(np.uint16) if len(terms) < 1 << 16 else which, kind="stable")
    kept = kinds != 2
    kept[by_word[1:][(np.diff(which[by_word]) == 0) & (np.diff(sentence[by_word]) == 0)]] = False
    which, sentence, opened = which[kept], sentence[kept], np.flatnonzero(opens)
    begins = np.flatnonzero(np.diff(sentence, prepend=-1))
    return terms, which, begins, np.searchsorted(np.cumsum(sizes), opened[sentence[begins]], side="right")


def _flat(terms: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(t) for t in terms], dtype=np.int64)
    return np.fromiter((i for t in terms for i in t), dtype=np.int64, count=int(counts.sum())), counts


def _spread(flat: np.ndarray, counts: np.ndarray, which: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all words, where sentences begin among them, the sentence of each, and the places of terms that a sentence has held before."""
    starts, n = (np.cumsum(counts) - counts)[which], counts[which]
    before = np.cumsum(n) - n
    ids = flat[np.repeat(starts - before, n) + np.arange(n.sum())]
    owner = np.repeat(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(which)))), n)
    by_id = np.argsort(ids.astype(np.uint16), kind="stable")  # there are as many terms as 16 bits tell apart
    again = by_id[1:][(np.diff(ids[by_id]) == 0) & (np.diff(owner[by_id]) == 0)]
    return ids, before[begins], owner, np.sort(again)


def _sentence_sets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, each once a sentence, begins of sentences in them, and of each sentence the number of its document."""
    terms, which, begins, owner = _sentences(lists)
    ids, begins, _, again = _spread(*_flat(terms), which, begins)
    return np.delete(ids, again), begins - np.searchsorted(again, begins), owner


_terms: dict[str, tuple[int, ...]] = {}


def _term_cache(word: str) -> tuple[int, ...]:
    found = _terms.get(word)
    if found is None:
        if len(_terms) >= 200_000:
            _terms.clear()
        found = _terms[word] = term_ids(word)
    return found


def labelled_bags(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> list[tuple[int, list[tuple[int, ...]]]]:
    """The labelled sample as label and sets of terms: at most ``max_labelled`` documents, the first by a hash of their id.

    Answers that are null don't count; a document counts as abusive if most of its raters say so, and is left out if they are
    even. Words are hashed in the tasks; the driver gets the numbers of the terms only.
    """
    votes = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share <> 0.5")
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select((F.col("share") > 0.5).cast("int").alias("y"), pieces(F.col("text")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begins, owner = _sentence_sets(batch.column(1))
            sentences = pa.ListArray.from_arrays(np.append(begins, len(ids)).astype(np.int32), pa.array(ids, pa.int32()))
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, sentences)], names=["y", "sentences"])

    found = rows.mapInArrow(run, "y int, sentences array<array<int>>").toArrow()
    return [(y, [tuple(sorted(s)) for s in sentences]) for y, sentences in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)]


def abuse_scores(documents: DataFrame, machine: FactorizationMachine, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, source and ``score``: the probability of the sentence that is most likely abusive; 0 where there is none.

    The machine's weights, of a fixed size, go to the tasks with the function.
    """
    fm = machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
            scores = np.zeros(batch.num_rows)
            terms, which, begins, owner = _sentences(batch.column(2))
            z = fm.scores_of_words(terms, which, begins)
            np.maximum.at(scores, owner, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["key", "source", "score"])

    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col(key).alias("key"), source.alias("source"), pieces(F.coalesce(F.col(text), F.lit(""))).alias("pieces"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, source string, score double").withColumnRenamed("key", key)


#: A document counts as abusive from this score on.
THRESHOLD = 0.5


def scored_documents(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, source, score of every document by a machine fitted to the labelled ones.

    Null and empty texts score 0. Every row gives one row, repeated and null keys too. Without labels the machine
    knows nothing and scores all documents alike, below the threshold. Empty documents give an empty result.
    """
    fm = fit(labelled_bags(documents, labels, max_labelled=max_labelled))
    return abuse_scores(documents, FactorizationMachine(fm.bias, fm.weights.astype(np.float32), fm.factors.astype(np.float32)))


def source_rates(scored: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """source, n_documents, n_flagged, rate; a null source is a source."""
    return (
        scored.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") >= threshold).alias("n_flagged"))
        .withColumn("rate", F.round(F.col("n_flagged") / F.col("n_documents"), 6))
    )
