"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round finds each pair's rank by binary search over the sorted pair
keys, takes every word's lowest rank, merges that pair everywhere in the word, and drops finished words.  Rounds grow with
a word's length, so words beyond ``LONG`` letters are merged one by one from a heap over linked symbols.  Words already seen
by the worker are remembered (the memory is emptied at ``MEMO_WORDS`` words or ``MEMO_LETTERS`` letters), so only new words are merged.

Scale: one map over the texts, no shuffle; the vocabulary is a file every machine has.  Memory is bounded by one Arrow
batch, the memo and one block of new words.  Defined results: null text is empty and has no tokens; repeated rows and
null ids are carried as they are; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_text

MEMO_WORDS = 250_000
MEMO_LETTERS = 8_000_000
#: Letters beyond which a word is merged by itself.
LONG = 512
DOCS_AT_ONCE = 256
#: Symbols of new words merged together in one flat array.
FLAT_SYMBOLS = 1_000_000
#: Fixed pre-tokenization pattern of the vocabulary, with the meaning of white space spelled out.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
WHITE_SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile("[\x1c-\x1f]")
NO_RANK = np.int64(1 << 40)
SHIFT = 20


def lowered(text: str) -> str:
    """Lower case letter by letter, without regard to a word's end."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class MergeRounds:
    """A byte-level BPE vocabulary with word ends, encoded in batched rounds."""

    def __init__(self, path: str):
        with open(path) as f:
            file = json.load(f)
        model = file["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << SHIFT) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.token_bytes = [t.encode() for t in self.tokens]
        self.number = [str(i).encode() for i in range(size)]
        self.by_pair: dict[int, int] = {}
        self.letters = 0  # of the words remembered

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words given as bytes; each word ends with its end-of-word symbol."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[raw[ends]]
        out: list[list[int]] = [[]] * len(words)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NO_RANK)
            key = (sym[:-1] << SHIFT) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.ranks[at[hit]]
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            done = low == NO_RANK
            if done.any():
                stop = starts + size
                for w, a, b in zip(word[starts[done]].tolist(), starts[done].tolist(), stop[done].tolist()):
                    out[w] = sym[a:b].tolist()
                stay = np.repeat(~done, size)
                low, size, sym, word, rank = low[~done], size[~done], sym[stay], word[stay], rank[stay]
                if not len(sym):
                    break
            here = (rank == np.repeat(low, size)) & (rank != NO_RANK)
            idx = np.flatnonzero(here)
            run = np.r_[True, np.diff(idx) != 1]  # overlapping occurrences merge from the left
            first = idx[run][np.cumsum(run) - 1]
            idx = idx[(idx - first) % 2 == 0]
            sym[idx] = self.merged[rank[idx]]
            keep = np.ones(len(sym), bool)
            keep[idx + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: the lowest rank first, the leftmost of equal ones, in n log n steps."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        raw = np.frombuffer(word, np.uint8)
        sym = self.inner[raw].tolist()
        sym[-1] = int(self.last[raw[-1]])
        n, rank, merged = len(sym), self.by_pair.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((sym[i] << SHIFT) | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or rank((sym[i] << SHIFT) | sym[j]) != r:
                continue  # one of the two has been merged since
            sym[i], sym[j], after[i] = int(merged[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := rank((sym[i] << SHIFT) | sym[after[j]])) is not None:
                    heapq.heappush(heap, (q, i))
            if before[i] >= 0 and (q := rank((sym[before[i]] << SHIFT) | sym[i])) is not None:
                heapq.heappush(heap, (q, before[i]))
        return [x for x in sym if x >= 0]

    def pre_tokens(self, word: str) -> list[bytes]:
        """Pre-tokens of a word without white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        return [t.encode() for t in PRE_TOKEN.findall(lowered(word))]

    def words_of(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if any(t in text for t in self.special):
            return [w for part in self.special_cut.split(text) for w in ([part] if part in self.special else self.words_of(part))]
        if SEPARATORS.search(text):
            return [w for w in WHITE_SPACE.split(text) if w]
        return text.split()

    def learn(self, words: list[str], memo: dict[str, list[int]]) -> None:
        """Put the ids of new words into ``memo``, in blocks of bounded size."""
        cut = [[] if w in self.special else self.pre_tokens(w) for w in words]
        ids: dict[bytes, list[int]] = {}
        block: list[bytes] = []
        held = 0
        for t in dict.fromkeys(t for ts in cut for t in ts):
            if len(t) > LONG:
                ids[t] = self.merge_long(t)
                continue
            block.append(t)
            held += len(t)
            if held >= FLAT_SYMBOLS:
                ids.update(zip(block, self.merge(block)))
                block, held = [], 0
        if block:
            ids.update(zip(block, self.merge(block)))
        for w, ts in zip(words, cut):
            memo[w] = [self.special[w]] if w in self.special else [i for t in ts for i in ids[t]]

    def encode_batch(self, texts: list[str], memo: dict[str, list[int]]) -> list[list[int]]:
        """Ids of whole texts; ``memo`` keeps words between calls."""
        cut = self.new_words(texts, memo)
        return [[i for w in words for i in memo[w]] for words in cut]

    def new_words(self, texts: list[str], memo: dict) -> list[list[str]]:
        if len(memo) > MEMO_WORDS or self.letters > MEMO_LETTERS:
            memo.clear()
            self.letters = 0
        cut, new = [self.words_of(t) for t in texts], {}
        for words in cut:
            new.update(dict.fromkeys(filterfalse(memo.__contains__, words)))
        if new:
            self.learn(list(new), memo)
            self.letters += sum(map(len, new))
        return cut

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: tokens are joined by blanks, special ones included."""
        return " ".join([self.tokens[i] for i in ids])


class _Rendered(dict):
    """Words' (number of ids, their decimal text, their decoded text)."""

    def __init__(self, model: MergeRounds):
        self.model = model

    def __setitem__(self, word: str, ids: list[int]) -> None:
        super().__setitem__(word, (len(ids), b" ".join([self.model.number[i] for i in ids]), b" ".join([self.model.token_bytes[i] for i in ids])))


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for b in it:
        for at in range(0, b.num_rows, DOCS_AT_ONCE):
            part = b.slice(at, DOCS_AT_ONCE)
            yield part.column(0).to_pylist(), as_text(part.column(1))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = MergeRounds(vocabulary), {}
        for doc_ids, texts in _parts(it):
            ids = model.encode_batch(texts, memo)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc_ids, ids, [model.decode(x) for x in ids]), ENCODED.types)], schema=ENCODED)

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens`` and the digests of the ids and of the decoded text of every whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeRounds(vocabulary)
        memo = _Rendered(model)
        for doc_ids, texts in _parts(it):
            rows = []
            for doc, words in zip(doc_ids, model.new_words(texts, memo)):
                found = list(map(memo.__getitem__, words))
                ids, decoded = (b" ".join([f[k] for f in found if f[0]]) for k in (1, 2))
                rows.append((doc, sum(f[0] for f in found), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), DIGESTS.types)], schema=DIGESTS)

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
