"""Language-model scores of whole documents: a gated recurrent model in numpy with class-factored softmax.

Training documents are those whose id's crc32 modulo ``FOLDS`` is not ``HELD_OUT``.  Token counts over all of them give the
add-half unigram ``base_score`` and the model's vocabulary: the ``HEAD`` commonest words, in classes of ``CLASS_WORDS`` by
frequency, whose probability within the class depends on the state; and tail classes by word ending and count, within
which a word's probability comes from the counts (unseen words share the class of words seen once, by Good-Turing).  The
recurrent state predicts the class.  Untrained, the model is the class unigram; training is truncated backpropagation
(``WINDOW`` steps, state carried on) by Adam on every chunk, with weighted averages of the weights after each round.
Scoring carries the state through all windows of a document, so the likelihood is that of the complete text.

Scale: documents are dealt into chunks by a hash of id and text, once; a chunk reports its distinct word hashes, so shuffles
grow with distinct words, and its texts as places among them; counts return by an equi-join.  Texts become two bytes a token
in a written table that training and scoring read.  Weights (about 40,000 numbers) are averaged in a tree; a few of them and tables of fixed size are all that
reaches the driver.  Gradient steps take every training document once, in one of ``ROUNDS`` rounds (by a hash of the id);
counts and scores cover everything.  Chunks depend on the rows alone, and a chunk trains in the order of its ids, so scores
do not depend on partitions or on the size of the cluster.

Defined results: null text is empty (one token, its end); a null id counts as the empty text in the fold rule; repeated rows
are counted and scored each; with no training documents N is 0 and the model untrained; empty tables give empty results;
extra columns are ignored.  Words are known by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import cycle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LOWER, as_bytes, crc32_mod, release, stored, unstore, word_hashes, words_in

FOLDS, HELD_OUT = 5, 1
HIDDEN = 16
HEAD_CLASSES, CLASS_WORDS = 16, 32
HEAD = HEAD_CLASSES * CLASS_WORDS
ENDINGS = 16
#: Least counts of the tail's count groups.
COUNT_GROUPS = (0, 2, 10)
TAIL = ENDINGS * len(COUNT_GROUPS)
END_ID = HEAD + TAIL
START_ID = END_ID + 1
CLASSES = HEAD_CLASSES + TAIL + 1
WINDOW = 16
STREAMS = 64
#: Places that are scored at once.
AT_ONCE = 1024
SCORE_STREAMS = 768
ROUNDS = 4
RATE = 0.01
CHUNK_BYTES = 12 << 20
#: Weights averaged by one task.
FAN_IN = 32

_CLASS_OF = np.concatenate([np.arange(HEAD) // CLASS_WORDS, HEAD_CLASSES + np.arange(TAIL + 1)]).astype(np.int64)
_CLASS_BEGINS = np.arange(HEAD_CLASSES + 1) * CLASS_WORDS
_SIGN = np.repeat([-1, 1], [2 * HIDDEN, HIDDEN])


def hashes_and_endings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, ending groups, words per text) of lower-cased texts."""
    raw, begin, last, n = words_in(texts)
    lower = LOWER[raw[last]].astype(np.int64)
    ending = ((lower * 31 + np.where(last > begin, LOWER[raw[last - 1]], 32)) * 2654435761 >> 16) % ENDINGS
    return word_hashes(raw, begin, last).view(np.int64), ending, n


PRE = "chunk int, h long, ending int, n long, docs long, doc_id long, held_out boolean, places binary"


def _width(words: int) -> int:
    """Bytes that tell so many words apart."""
    return max(1, -(-(words - 1).bit_length() // 8))


def _report(docs: pa.Table) -> pa.Table:
    """Distinct words of a chunk in the order of their hashes, with their counts in training texts; the row of hash 0 and ending
    -1 counts training texts.  Then a row for each document, with the places of its words in that order, as ``_width`` bytes each."""
    texts, held = as_bytes(docs.column("text")), np.array(docs.column("held_out").to_pylist(), bool)
    h, ending, n = hashes_and_endings(texts)
    word, first, back = np.unique(h, return_index=True, return_inverse=True)
    count = np.bincount(back, weights=np.repeat(~held, n), minlength=len(word)).astype(np.int64)
    m, stop = len(word) + 1, np.cumsum(n)
    flat = back.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : _width(len(word))]
    places = [flat[a:b].tobytes() for a, b in zip((stop - n).tolist(), stop.tolist())]
    none = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
    names = [c.split()[0] for c in PRE.split(", ")]
    chunk = docs.column("chunk")[0].as_py()
    words = [pa.array(np.full(m, chunk, np.int32)), pa.array(np.r_[word, 0]), pa.array(np.r_[ending[first], -1].astype(np.int32)), pa.array(np.r_[count, 0]), pa.array(np.r_[np.zeros(m - 1, np.int64), (~held).sum()]), *(pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.binary()))]
    rows = [pa.array(np.full(len(texts), chunk, np.int32)), *none, docs.column("doc_id"), docs.column("held_out"), pa.array(places, pa.binary())]
    return pa.concat_tables([pa.table(words, names=names), pa.table(rows, names=names)])


class Vocabulary:
    """Bounded vocabulary data: head words, class masses of the tail, and corpus totals."""

    def __init__(self, head: list[tuple[int, int]], tail: dict[tuple[int, int], tuple[int, int, int]], tokens: int, types: int, docs: int):
        self.tokens, self.types, self.docs = tokens, types, docs
        self.head_hash = np.array([h for h, _ in head], np.int64)
        self.head_count = np.array([c for _, c in head], np.float64)
        self.order = np.argsort(self.head_hash)
        self.mass = np.full(TAIL, 0.5)  # add-half mass of each tail class
        once, twice = (sum(v[2] for k, v in tail.items() if k[1] == g) for g in (0, 1))
        self.unseen = (once + 1.0) / (once + 2.0 * twice + 2.0)  # Good-Turing share of unseen words beside words seen once
        for (ending, group), (types_, total, _) in tail.items():
            self.mass[group * ENDINGS + ending] = total + 0.5 * types_

    def ids(self, h: np.ndarray, c: np.ndarray, ending: np.ndarray) -> np.ndarray:
        group = np.searchsorted(np.array(COUNT_GROUPS), c, side="right") - 1
        out = HEAD + group * ENDINGS + ending
        if len(self.head_hash):
            at = np.minimum(np.searchsorted(self.head_hash, h, sorter=self.order), len(self.order) - 1)
            rank = self.order[at]
            hit = self.head_hash[rank] == h
            out[hit] = rank[hit]
        return out

    def tail_log10(self, ids: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its tail class; 0 for head words."""
        out = np.zeros(len(ids))
        tail = ids >= HEAD
        k = ids[tail] - HEAD
        once = k < ENDINGS
        share = np.where(c[tail] > 0, (c[tail] + 0.5) / self.mass[k] * np.where(once, 1 - self.unseen, 1.0), self.unseen)
        out[tail] = np.log10(share)
        return out

    def base_log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


ENCODED = "chunk int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail_score double, ids binary"


def _encoder(v: Vocabulary):
    names = ["chunk", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail_score", "ids"]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        h, c, ending = (answers.column(k).to_numpy() for k in ("h", "c", "ending"))
        order, width = np.argsort(h), _width(len(h))  # as in the report
        c, ids = c[order], v.ids(h, c, ending.astype(np.int64))[order]
        base, tail = v.base_log10(c), v.tail_log10(ids, c)
        ids, known = ids.astype(np.int16), (c > 0).astype(np.float64)
        end_base = float(v.base_log10(np.array([v.docs]))[0])
        out = []
        places, doc_ids, held = (docs.column(k).to_pylist() for k in ("places", "doc_id", "held_out"))
        chunk = docs.column("chunk")[0].as_py() if len(places) else None
        for at in range(0, len(places), 500):
            part = places[at : at + 500]
            n = np.fromiter(map(len, part), np.int64, len(part)) // width
            place = np.zeros((int(n.sum()), 8), np.uint8)
            place[:, :width] = np.frombuffer(b"".join(part), np.uint8).reshape(-1, width)
            place = place.view("<i8").ravel()
            stop = np.cumsum(n)
            sums = [_segment_sums(x[place], n) for x in (base, tail, known)]
            coded = ids[place]
            for k, (a, b) in enumerate(zip((stop - n).tolist(), stop.tolist())):
                out.append((chunk, doc_ids[at + k], held[at + k], int(n[k]) + 1, int(sums[2][k]) + (v.docs > 0), float(sums[0][k]) + end_base, float(sums[1][k]), coded[a:b].tobytes()))
        types = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, types)], names=names)

    return run


def _segment_sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of lengths ``n`` (zero where empty)."""
    out = np.zeros(len(n))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(n) - n)[some])
    return out


class Run(NamedTuple):
    """A window's states (steps + 1, hidden + a row of ones, streams), inverse gates z and r and the candidate's recurrent part
    (steps, 3 * hidden, streams), and candidates."""

    states: np.ndarray
    pre: np.ndarray
    ns: np.ndarray


class Model:
    """GRU over token classes; all weights in one float32 vector."""

    SHAPES = {"gx": (START_ID + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wh": (HEAD_CLASSES, HIDDEN, CLASS_WORDS), "bh": (HEAD_CLASSES, CLASS_WORDS)}
    ENDS = np.cumsum([math.prod(s) for s in SHAPES.values()]).tolist()
    PLACES = [(name, shape, slice(end - math.prod(shape), end)) for (name, shape), end in zip(SHAPES.items(), ENDS)]
    #: Class weights and, as one more row, their biases.
    OUT = slice(ENDS[1], ENDS[3])

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        for name, shape, place in self.PLACES:
            setattr(self, name, weights[place].reshape(shape))
        self.out = weights[self.OUT].reshape(HIDDEN + 1, CLASSES)

    @classmethod
    def fresh(cls, v: Vocabulary) -> Model:
        """Random state weights, and output biases that make the class unigram."""
        rng = np.random.default_rng(5)
        m = cls(np.zeros(cls.ENDS[-1], np.float32))
        m.gx[:] = rng.normal(0, 0.3, m.gx.shape)
        m.u[:] = rng.normal(0, 0.2, m.u.shape)
        head = np.zeros(HEAD)
        head[: len(v.head_count)] = v.head_count
        by_class = head.reshape(HEAD_CLASSES, CLASS_WORDS)
        m.bh[:] = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -30)
        m.bh -= np.log(np.exp(m.bh).sum(1, keepdims=True))
        mass = np.r_[by_class.sum(1) + 1e-3, v.mass, v.docs + 0.5]
        m.bc[:] = np.log(mass / mass.sum())
        return m

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, gates) of one token for each stream; states are rows."""
        run = self.run(x[None], h.T)
        return run.states[1, :HIDDEN].T, 1 / run.pre[0, : 2 * HIDDEN]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates, those of z and r negated; the last axis is that of streams."""
        a = np.take(self.gx, x, axis=0).swapaxes(-1, -2)
        return np.multiply(a, _SIGN[:, None].astype(a.dtype), out=np.empty(a.shape, a.dtype))

    def run(self, x: np.ndarray, h: np.ndarray, keep: bool = True) -> Run:
        """A window (steps, streams) from the states ``h``, with a column for each stream; without ``keep``, states alone are of use."""
        steps, streams = x.shape
        kind = self.weights.dtype
        states, pre, ns = (np.empty((n, m, streams), kind) for n, m in ((steps + 1, HIDDEN + 1), (steps if keep else 1, 3 * HIDDEN), (steps if keep else 1, HIDDEN)))
        states[0, :HIDDEN] = h
        states[:, HIDDEN] = 1
        # gates' parts are negated before the steps; scoring's many streams take a step's at a time, what stays in a core's cache
        a = self.inputs(x) if keep else None
        pairs = zip(a[:, : 2 * HIDDEN], a[:, 2 * HIDDEN :]) if keep else ((b[: 2 * HIDDEN], b[2 * HIDDEN :]) for b in map(self.inputs, x))
        ut = np.multiply(self.u.T, _SIGN[:, None].astype(kind), order="C")
        zr, z, r, hn = (pre[:, i * HIDDEN : j * HIDDEN] for i, j in ((0, 2), (0, 1), (1, 2), (2, 3)))
        own = states[:, :HIDDEN]
        dot, add, exp, divide, tanh, subtract = np.dot, np.add, np.exp, np.divide, np.tanh, np.subtract
        for old, new, pre_t, zr_t, z_t, r_t, hn_t, n, (a_zr, a_n) in zip(own, own[1:], *map(cycle, (pre, zr, z, r, hn, ns)), pairs):
            dot(ut, old, pre_t)
            add(zr_t, a_zr, zr_t)
            exp(zr_t, zr_t)
            add(zr_t, 1, zr_t)
            divide(hn_t, r_t, n)
            add(n, a_n, n)
            tanh(n, n)
            subtract(old, n, new)
            divide(new, z_t, new)
            add(new, n, new)
        return Run(states, pre, ns)

    def words(self) -> np.ndarray:
        """Weights of words by class with their biases as one more row."""
        return np.concatenate([self.wh, self.bh[:, None]], 1)

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target's class and, for head words, of the word in it; states are rows."""
        return self._log_probs(np.concatenate([states, np.ones((len(states), 1), states.dtype)], 1), target, self.words())

    def _log_probs(self, rows: np.ndarray, target: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The same from states with a one at their end and the weights of ``words``."""
        if len(target) > AT_ONCE:  # what stays in a core's cache
            return np.concatenate([self._log_probs(rows[i : i + AT_ONCE], target[i : i + AT_ONCE], words) for i in range(0, len(target), AT_ONCE)])
        order, cuts, m = _by_target(target)
        mine, goal = np.take(rows, order, axis=0), target[order]
        logit = _in_range(np.dot(mine, self.out))
        got = logit.ravel()[_CLASS_OF[goal] + np.arange(len(goal)) * CLASSES]
        got -= np.log(_powers(logit))
        if m:
            inner = np.empty((m, CLASS_WORDS), logit.dtype)
            for c, i, j in cuts:
                np.dot(mine[i:j], words[c], inner[i:j])
            got[:m] += _in_range(inner).ravel()[goal[:m] % CLASS_WORDS + np.arange(m) * CLASS_WORDS]
            got[:m] -= np.log(_powers(inner))
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradient(self, x: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient vector, last state) of a window: arrays (steps, streams).

        Places that are not live don't count.  They come last in their stream, so nothing of them flows back, and the last
        state of a stream that ends with one is of no use.
        """
        g = Model(np.zeros_like(self.weights))
        ids, of_ids, last = self._gradient(x, target, live, h.T, g)
        g.gx[ids] = of_ids
        return g.weights, last.T

    def _gradient(self, x: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray, g: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens read, gradients of their input rows, last state); the other gradients are left in ``g``.  States are columns."""
        steps, streams = x.shape
        kind = self.weights.dtype
        whole = bool(live.all())
        states, inverse, ns = self.run(x, h)
        rows = np.ascontiguousarray(states.transpose(0, 2, 1))
        order, cuts, m = _by_target(target.ravel() if whole else np.where(live, target, END_ID).ravel())
        mine, goal = np.take(rows[1:].reshape(-1, HIDDEN + 1), order, axis=0), target.ravel()[order]
        p = _in_range(np.dot(mine, self.out))
        total = _powers(p)
        p.ravel()[_CLASS_OF[goal] + np.arange(len(goal)) * CLASSES] -= total
        share = np.reciprocal(total)
        if not whole:
            share *= live.ravel()[order]
        share = share[:, None]
        g.out[:] = np.dot(p.T, mine * share).T
        d_rows = np.dot(p, self.wc.T)
        d_rows *= share
        g.wh[:], g.bh[:] = 0, 0
        if m:
            words, part = self.words(), np.empty((HIDDEN + 1, CLASS_WORDS), kind)
            q, back = np.empty((m, CLASS_WORDS), kind), np.empty((m, HIDDEN), kind)
            for c, i, j in cuts:
                np.dot(mine[i:j], words[c], q[i:j])
            q *= np.reciprocal(_powers(_in_range(q)))[:, None]
            q.ravel()[goal[:m] % CLASS_WORDS + np.arange(m) * CLASS_WORDS] -= 1
            for c, i, j in cuts:
                np.dot(mine[i:j].T, q[i:j], part)
                g.wh[c], g.bh[c] = part[:HIDDEN], part[HIDDEN]
                np.dot(q[i:j], self.wh[c].T, back[i:j])
            d_rows[:m] += back
        unsorted = np.empty_like(d_rows)
        unsorted[order] = d_rows
        d_state = np.ascontiguousarray(unsorted.reshape(steps, streams, HIDDEN).transpose(0, 2, 1))  # takes what later steps send back
        gates = np.reciprocal(inverse[:, : 2 * HIDDEN])
        zs, rs, befores = gates[:, :HIDDEN], gates[:, HIDDEN:], states[:-1, :HIDDEN]
        by = np.empty((steps, 3, HIDDEN, streams), kind)  # of all three parts, so that a step multiplies once
        by_z, by_r, by_h = by[:, 0], by[:, 1], by[:, 2]
        on = 1 - zs
        by_n = ns * ns
        np.subtract(1, by_n, out=by_n)
        by_n *= on
        on *= zs
        np.subtract(befores, ns, out=by_z)
        by_z *= on
        np.multiply(by_n, rs, out=by_h)
        np.subtract(1, rs, out=rs)
        rs *= inverse[:, 2 * HIDDEN :]
        np.multiply(by_h, rs, out=by_r)
        pre = np.empty((steps, 3 * HIDDEN, streams), kind)
        back, kept, u = np.zeros((HIDDEN, streams), kind), np.empty((HIDDEN, streams), kind), self.u
        dot, add, multiply = np.dot, np.add, np.multiply
        for dh, by_t, parts, pre_t, z_t in zip(d_state[::-1], by[::-1], pre.reshape(by.shape)[::-1], pre[::-1], zs[::-1]):
            add(dh, back, dh)
            multiply(dh, by_t, parts)
            dot(u, pre_t, back)
            multiply(dh, z_t, kept)
            add(back, kept, back)
        by_place = np.ascontiguousarray(pre.transpose(0, 2, 1)).reshape(-1, 3 * HIDDEN)
        g.u[:] = np.dot(by_place.T, rows[:-1].reshape(-1, HIDDEN + 1)).T[:HIDDEN]
        d_state *= by_n
        by_place.reshape(steps, streams, -1)[:, :, 2 * HIDDEN :] = d_state.transpose(0, 2, 1)
        flat = x.ravel().astype(np.int16)
        order = np.argsort(flat, kind="stable")
        ids = flat[order]
        begin = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        pairs = np.take(by_place, order, axis=0).view(np.result_type(kind, np.complex64))  # two numbers are summed as one
        return ids[begin], np.add.reduceat(pairs, begin, axis=0).view(kind), states[-1, :HIDDEN]


def _by_target(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
    """Order of places by target, (class, begin, end) of each head class there, and the number of head words."""
    order = np.argsort(target.astype(np.int16), kind="stable")
    cuts = np.searchsorted(target[order], _CLASS_BEGINS).tolist()
    return order, [(c, i, j) for c, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j], cuts[-1]


def _in_range(logit: np.ndarray) -> np.ndarray:
    """Logits, from which each row's greatest is taken off in place if exponentials or their sums might leave the range of floats."""
    if not (logit.max() < 57 and logit[:, 0].min() > -57):
        logit -= logit.max(1, keepdims=True)
    return logit


def _powers(logit: np.ndarray) -> np.ndarray:
    """Sums by row of the exponentials, which take the place of the logits."""
    return np.dot(np.exp(logit, logit), np.ones(logit.shape[1], logit.dtype))


def train(model: Model, docs: list[np.ndarray]) -> Model:
    """One pass of truncated backpropagation: ``STREAMS`` documents side by side, each slot taking the next when done."""
    w = model.weights.copy()
    model, g = Model(w), Model(np.zeros_like(w))
    rest = slice(Model.ENDS[0], None)  # all but the rows of input tokens, of which a window reads few
    first, second, root, own, n = *(Model(np.zeros_like(w)) for _ in range(3)), np.empty_like(w), 0
    grown, grown2 = 1.0, 1.0  # sums are held times these powers of 1 / 0.9 and 1 / 0.99, so that a row without gradient stays as it is
    if not docs:
        return model
    flat = np.concatenate(docs)
    stops = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))
    starts = np.r_[0, stops[:-1]]
    taken = min(STREAMS, len(docs))
    place, end = starts[:taken].copy(), stops[:taken].copy()
    h = np.zeros((HIDDEN, taken), w.dtype)
    ahead = np.arange(WINDOW + 1)[:, None]
    while len(place):
        at = place + ahead
        ids = flat[np.minimum(at, len(flat) - 1)]
        live = at[1:] < end
        rows, of_rows, h = model._gradient(ids[:-1], np.where(live, ids[1:], END_ID), live, h, g)
        of_rest, count = g.weights[rest], max(1, int(live.sum()))
        length = math.sqrt(float(np.vdot(of_rows, of_rows)) + float(of_rest @ of_rest)) / count
        scale = min(1.0, 1.0 / (length + 1e-9)) / count
        n += 1
        grown, grown2 = grown / 0.9, grown2 / 0.99
        if n % 64 == 0:
            first.weights *= 1 / grown
            second.weights *= 1 / grown2
            root.weights *= 1 / math.sqrt(grown2)
            grown = grown2 = 1.0
        for part, mine, to, to2, of2 in ((of_rows, rows, first.gx, second.gx, root.gx), (of_rest, slice(None), first.weights[rest], second.weights[rest], root.weights[rest])):
            part *= scale * math.sqrt(grown2)
            squares = to2[mine] + part * part
            to2[mine], of2[mine] = squares, np.sqrt(squares)
            part *= grown / math.sqrt(grown2)
            to[mine] += part
        spread = math.sqrt(0.01 / (1 - 0.99**n))  # the factors 0.1 and 0.01 of the sums are held by the constants
        np.add(root.weights, 1e-6 / spread * math.sqrt(grown2), out=own)
        np.divide(first.weights, own, out=own)
        own *= RATE * 0.1 / (1 - 0.9**n) / spread * math.sqrt(grown2) / grown
        w -= own
        place += WINDOW
        done = np.flatnonzero(place >= end - 1)
        if len(done):
            more = done[: len(docs) - taken]
            place[more], end[more] = starts[taken : taken + len(more)], stops[taken : taken + len(more)]
            h[:, more] = 0
            taken += len(more)
            if len(more) < len(done):
                place, end, h = (np.delete(v, done[len(more) :], -1) for v in (place, end, h))
    return model


_START, _END = (np.int16(i).tobytes() for i in (START_ID, END_ID))


def _sequence(ids: bytes) -> np.ndarray:
    return np.frombuffer(b"".join((_START, ids, _END)), np.int16).astype(np.int64)


WEIGHTS = "chunk int, tokens long, weights binary"


def _weights(chunk: int, tokens: int, weights: np.ndarray) -> pa.Table:
    return pa.table([pa.array([chunk], pa.int32()), pa.array([tokens]), pa.array([weights.tobytes()], pa.binary())], names=["chunk", "tokens", "weights"])


def _trainer(weights: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        """Weights after one pass over a chunk's documents, in the order of their ids and contents."""
        keyed = zip((c is not None for c in rows.column("doc_id").to_pylist()), (c or 0 for c in rows.column("doc_id").to_pylist()), rows.column("ids").to_pylist())
        docs = [_sequence(x) for _, _, x in sorted(keyed)]
        return _weights(rows.column("chunk")[0].as_py(), sum(len(d) - 1 for d in docs), train(Model(weights), docs).weights)

    return run


def _mean(chunks: list[int], tokens: list[int], weights: list[bytes]) -> np.ndarray:
    """Mean of weights by tokens, summed in the order of the chunks."""
    w = np.zeros(len(weights[0]) // 4)
    for _, k, x in sorted(zip(chunks, tokens, weights)):
        w += k * np.frombuffer(x, np.float32).astype(np.float64)
    return (w / sum(tokens)).astype(np.float32)


def _averaged(of: int):
    def run(rows: pa.Table) -> pa.Table:
        cols = [rows.column(c).to_pylist() for c in ("chunk", "tokens", "weights")]
        return _weights(cols[0][0] % of, sum(cols[1]), _mean(*cols))

    return run


def of_round(encoded: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """Training documents of round ``k``; every training document is in exactly one round."""
    return encoded.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds)) == k))


def trained(encoded: DataFrame, vocabulary: Vocabulary, chunks: int, rounds: int = ROUNDS) -> Model:
    """Weights after ``rounds`` rounds; the rounds share all training documents out between them.

    A round trains every chunk from the same weights and averages the results in a tree of fan-in ``FAN_IN``.
    """
    model = Model.fresh(vocabulary)
    for k in range(rounds):
        mine = of_round(encoded, k, rounds).select("chunk", "doc_id", "ids").repartitionById(chunks, F.col("chunk"))
        level, n = mine.groupBy("chunk").applyInArrow(_trainer(model.weights), WEIGHTS), chunks
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            level = level.repartition(n, F.col("chunk") % n).groupBy((F.col("chunk") % n).alias("part")).applyInArrow(_averaged(n), WEIGHTS)
        means = [r for r in level.collect() if r["tokens"]]  # at most FAN_IN rows
        if means:
            model = Model(_mean(*([r[c] for r in means] for c in ("chunk", "tokens", "weights"))))
    return model


def log10_of(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Sum of log10-probabilities of each document's classes and head words, state carried through the whole document."""
    length = np.fromiter((len(d) - 1 for d in docs), np.int64, len(docs))
    order = np.argsort(-length, kind="stable")
    out = np.zeros(len(docs))
    words, ahead = model.words(), np.arange(WINDOW + 1)[:, None]
    for at in range(0, len(order), SCORE_STREAMS):
        mine = order[at : at + SCORE_STREAMS]
        flat = np.concatenate([docs[i] for i in mine])
        left = length[mine]  # falling
        place = np.cumsum(left + 1) - left - 1
        h = np.zeros((HIDDEN, len(mine)), model.weights.dtype)
        total = np.zeros(len(mine))
        while (n := int(np.searchsorted(-left, 0))) > 0:
            h, place, left = h[:, :n], place[:n], left[:n]
            steps = min(WINDOW, int(left[0]))
            ids = flat[np.minimum(place + ahead[: steps + 1], len(flat) - 1)]
            states = model.run(ids[:-1], h, keep=False).states
            h = states[-1, :HIDDEN]
            at_live = np.flatnonzero(ahead[:steps] < left)
            rows = np.ascontiguousarray(states[1:].transpose(0, 2, 1)).reshape(-1, HIDDEN + 1)
            if len(at_live) < len(rows):
                rows = np.take(rows, at_live, axis=0)
            got = model._log_probs(rows, ids[1:].ravel()[at_live], words)
            total[:n] += np.bincount(at_live % n, weights=got, minlength=n)
            place, left = place + WINDOW, left - WINDOW
        out[mine] = total / np.log(10.0)
    return out


def _scorer(weights: np.ndarray, train_tokens: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights)
        for b in it:
            score = log10_of(model, [_sequence(x) for x in b.column(6).to_pylist()]) + b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(b.num_rows, train_tokens)), b.column(4), pa.array(score)], names=names)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-int(total) // CHUNK_BYTES))  # of the data alone, so that scores are the same on any cluster
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk")
    held = (crc32_mod(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), FOLDS) == HELD_OUT).alias("held_out")
    placed = rows.select(chunk, "doc_id", held, "text")
    pre = stored(placed.repartitionById(n, F.col("chunk")).groupBy("chunk").applyInArrow(_report, PRE), "chunk-words")
    release(spark)

    totals = pre.agg(F.sum("n").alias("words"), F.sum("docs").alias("docs")).first()
    counts = stored(pre.where("ending >= 0 AND n > 0").groupBy("h").agg(F.sum("n").alias("c"), F.min("ending").alias("ending")), "word-counts")
    head = [(r["h"], r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(HEAD).collect()]
    least = head[-1] if len(head) == HEAD else (0, 0)
    in_tail = F.lit(False) if not head or len(head) < HEAD else (F.col("c") < least[1]) | ((F.col("c") == least[1]) & (F.col("h") > least[0]))
    group = F.when(F.col("c") >= COUNT_GROUPS[2], 2).when(F.col("c") >= COUNT_GROUPS[1], 1).otherwise(0)
    tail_rows = counts.where(in_tail).groupBy("ending", group.alias("grp")).agg(F.count("*").alias("types"), F.sum("c").alias("total"), F.count_if(F.col("c") <= 2).alias("rare")).collect()  # at most TAIL rows
    tail = {(r["ending"], r["grp"]): (r["types"], r["total"], r["rare"]) for r in tail_rows}
    docs_seen = totals["docs"] or 0
    tokens = (totals["words"] or 0) + docs_seen
    vocabulary = Vocabulary(head, tail, tokens, counts.count() + (docs_seen > 0), docs_seen)

    asked = pre.where("ending >= 0").select("chunk", "h", "ending")
    answers = asked.join(counts.select("h", "c"), "h", "left").select("chunk", "h", F.coalesce("c", F.lit(0)).alias("c"), "ending")
    texts = pre.where("places IS NOT NULL").select(F.col("chunk").alias("chunk"), "doc_id", "held_out", "places")  # a column of its own beside that of the answers
    encoded = stored(texts.repartition(2 * n, "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_encoder(vocabulary), ENCODED), "encoded")
    unstore(pre, counts)
    release(spark)
    model = trained(encoded, vocabulary, n, rounds)
    columns = encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail_score", "ids")
    return columns.mapInArrow(_scorer(model.weights, tokens), SCORES)
