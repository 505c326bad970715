"""Encoding a corpus with a public byte-level BPE by a tokenization automaton."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie, unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the public pre-tokenizer pattern of this family of vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The deterministic automaton over tokens that accepts exactly the BPE encodings.

    It starts as one state with a loop for every byte. Each merge (u, v) adds a gadget: where a u-arc is followed by a
    v-arc, an arc for the merged token leads to where v led, and the u-arc is led to a copy of its state without the v-arc.
    All arcs of a token lead to one state, so a state is named by its token. The copies differ from the state they were
    taken from by the arcs cut later, so only these are stored: ``cut[u, v]`` is the time at which v was cut behind u, and
    the state of a merged token is that of its right part as it was at the time of the merge. An arc is open in a state if
    no part on its left edge was cut, in time, behind a part on the right edge of the state's token.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.label: dict[int, bytes] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[bytes, int] = {}
        self.prefixes: set[bytes] = set()
        for letter, byte in letters.items():
            token = vocabulary[letter]
            self.label[token], self.time[token] = bytes([byte]), -1
            self.arcs[bytes([byte])] = token
        for at, (a, b) in enumerate(merges):
            self._gadget(at, vocabulary[a], vocabulary[b], vocabulary[a + b])
        for text in self.arcs:
            self.prefixes.update(text[:i] for i in range(1, len(text)))
        self.known: dict[str, tuple[int, ...]] = {}
        self.table: dict[int, dict[int, bool]] = {}
        self.entries = 0

    @classmethod
    def load(cls, path: str = VOCABULARY) -> TokenAutomaton:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def _gadget(self, at: int, u: int, v: int, merged: int) -> None:
        if merged not in self.label:
            self.label[merged] = self.label[u] + self.label[v]
            self.left[merged], self.right[merged], self.time[merged] = u, v, at
            if self.open(u, v):
                self.arcs[self.label[merged]] = merged
        self.cut.setdefault((u, v), at)

    def arc(self, state: int, token: int) -> bool:
        """:meth:`open` by the transition table: a row per state, an entry per token, each made when it is first met.

        The table of all states and tokens has billions of entries, of which texts meet few; beyond two millions it is begun anew.
        """
        row = self.table.get(state)
        if row is None:
            row = self.table[state] = {}
        found = row.get(token)
        if found is None:
            if self.entries >= 2_000_000:
                self.table.clear()
                self.entries, row = 0, self.table.setdefault(state, {})
            found = row[token] = self.open(state, token)
            self.entries += 1
        return found

    def open(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` has an arc for ``token``, from what the gadgets have cut."""
        cut, left, right, time = self.cut, self.left, self.right, self.time
        until = _NEVER
        while True:
            first, upto = token, _NEVER
            while True:
                at = cut.get((state, first))
                if at is not None and at < until and at <= upto:
                    return False
                if first not in left:
                    break
                upto, first = time[first], left[first]
            if state not in right:
                return True
            until, state = time[state], right[state]

    def word(self, word: str) -> tuple[int, ...]:
        """The labels of the one accepted path over the bytes of ``word``.

        Every prefix has one accepted path as well, so one state per position is all that a run has to keep.
        """
        found = self.known.get(word)
        if found is not None:
            return found
        data = word.encode("utf-8", "surrogatepass")
        whole = self.arcs.get(data)
        if whole is not None:
            path = (whole,)
        else:
            size, arcs, prefixes, passes = len(data), self.arcs, self.prefixes, self.arc
            behind: list[int | None] = [None] * (size + 1)
            for begin in range(size):
                state = behind[begin]
                if begin and state is None:
                    continue
                end = begin
                while True:
                    end += 1
                    piece = data[begin:end]
                    token = arcs.get(piece)
                    if token is not None and behind[end] is None and (not begin or passes(state, token)):
                        behind[end] = token
                    if end == size or piece not in prefixes:
                        break
            ids, end = [], size
            while end:
                ids.append(behind[end])
                end -= len(self.label[behind[end]])
            path = tuple(reversed(ids))
        if len(word) < 64:
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[word] = path
        return path

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty text or null."""
        ids: list[int] = []
        if text:
            known, word = self.known, self.word
            for w in _WORDS.findall(text):
                path = known.get(w)
                ids.extend(word(w) if path is None else path)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text whose bytes are the labels of the arcs ``ids``."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_WORDS = regex.compile(WORDS)
_loaded: dict[str, TokenAutomaton] = {}


def automaton(path: str = VOCABULARY) -> TokenAutomaton:
    """The automaton of a vocabulary file, built once per Python process."""
    if path not in _loaded:
        _loaded[path] = TokenAutomaton.load(path)
    return _loaded[path]


# Fixed value: the same pattern for the JVM, whose short classes know ASCII only.
_SPACE = r"\t-\r \x85\p{Z}"
JVM_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _word_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, words and text: the words as the JVM splits them, or the text where it knows too little of Unicode for that."""
    body = F.coalesce(F.col(text), F.lit(""))
    unsure = body.rlike(r"\p{Cn}")
    return documents.select(
        F.col(key).alias("key"),
        F.when(~unsure, F.regexp_extract_all(body, F.lit(JVM_WORDS), F.lit(0))).alias("words"),
        F.when(unsure, body).alias("text"),
    )


def _paths(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.Array, np.ndarray, list[tuple[int, ...]], np.ndarray]]:
    """Of each batch: keys, ends of the rows in the words, the paths of the distinct words, and each word's path."""
    machine = automaton(vocabulary)
    for batch in batches:
        keys, words, texts = (batch.column(i) for i in range(3))
        parts = [(keys, words)]
        if texts.null_count < len(texts):
            split = pa.array([_WORDS.findall(t) for t in texts.drop_null().to_pylist()], pa.list_(pa.string()))
            parts = [(keys.filter(words.is_valid()), words.drop_null()), (keys.filter(texts.is_valid()), split)]
        for own, lists in parts:
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            coded = lists.flatten().dictionary_encode()
            yield own, ends, [machine.word(w) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False)


def _until(ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ends of the rows in ids, from their ends in words and the words' numbers of ids."""
    return np.concatenate([[0], np.cumsum(lengths)])[ends]


def encoded(documents: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, by the BPE in ``vocabulary`` (a path all executors can read).

    Special tokens are not used: their names in a text are ordinary text. A null and an empty text give an empty list, never
    null. Every row gives one row, repeated and null keys too; other columns are ignored. The work is one pass in map tasks
    without a shuffle: the JVM splits texts into words, the distinct words of a batch run through the automaton, and the
    paths are laid out by array operations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ends, paths, which in _paths(batches, vocabulary):
            sizes = np.array([len(p) for p in paths], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(paths), dtype=np.int32, count=int(sizes.sum()))
            begins, lengths = (np.cumsum(sizes) - sizes)[which], sizes[which]
            places = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            offsets = np.concatenate([[0], _until(ends, lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[places], pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, ids], names=["key", "ids"])

    rows = _word_rows(documents, key, text)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``n_tokens`` (bigint) of every row; 0 for an empty text and for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ends, paths, which in _paths(batches, vocabulary):
            upto = _until(ends, np.array([len(p) for p in paths], dtype=np.int64)[which])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(upto, prepend=0), pa.int64())], names=["key", "n_tokens"])

    rows = _word_rows(documents, key, text)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("key", key)


def decoded(ids: Column, *, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array of ids: the labels of its arcs, one behind the other; null for null."""

    @F.pandas_udf("string")
    def run(rows):  # noqa: ANN001, ANN202
        machine = automaton(vocabulary)
        return rows.map(lambda r: None if r is None else machine.decode(list(r)))

    return run(ids)
