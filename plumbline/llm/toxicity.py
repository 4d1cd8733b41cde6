"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters the network as a learned vector of the word beside the elementwise maximum of learned vectors of
its character n-grams. Texts are cut into overlapping windows of words; a text scores as its worst window.
Training is multiple-instance: a toxic text teaches by its worst window, a clean one by its own worst.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, mapped, mix64, split_words

WORD_SLOTS, GRAM_SLOTS, GRAMS = 1 << 16, 1 << 18, (3, 4, 5)
WORD_DIMS, GRAM_DIMS, HIDDEN = 4, 4, 8
#: Every passage of up to WINDOW - STRIDE words lies whole in some window.
WINDOW, STRIDE = 48, 24
#: Words and n-grams of fewer training texts than this get no vector of their own.
LEAST_TEXTS = 4
_EDGE = b" .,;:!?\"'()[]{}|*$%&#<>=+-_/~"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def features(words: list[bytes], at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each word; slots of all its character n-grams (bytes, with an edge sign at both ends), and where
    each word's begin. A word without letters has the n-grams of its signs."""
    parts = [_features(words[a : a + at_once]) for a in range(0, max(1, len(words)), at_once)]
    shift = np.cumsum([0, *[len(gram) for _, gram, _ in parts]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + k for p, k in zip(parts, shift)])


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bare = [w.strip(_EDGE) or w for w in words]
    framed = [b"^" + w + b"$" for w in bare]
    sizes = np.array([len(w) for w in framed], dtype=np.int64)
    raw = np.frombuffer(b"".join(framed), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(raw))  # bytes from here to the word's end
    slots, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rolled = np.zeros(len(raw), dtype=np.uint64)
    for n in range(1, min(max(GRAMS), len(raw)) + 1):
        rolled[: len(raw) - n + 1] = rolled[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            good = np.flatnonzero(left >= n)
            slots.append((mix64(rolled[good] + np.uint64(n << 56)) % np.uint64(GRAM_SLOTS)).astype(np.int64))
            owner.append(own[good])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    weights = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(raw)) - np.repeat(starts, sizes)).astype(np.uint64)
    word = np.add.reduceat(mix64(raw + np.uint64(7)) * weights, starts) if len(raw) else np.empty(0, np.uint64)
    n_of = np.bincount(owner, minlength=len(words))
    return (mix64(word) % np.uint64(WORD_SLOTS)).astype(np.int32), slots[order].astype(np.int32), np.cumsum(n_of) - n_of


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of overlapping windows that cover texts of `sizes` words, given one after the other;
    one empty window for a text without words."""
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(sizes)), n)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    begin = (np.cumsum(sizes) - sizes)[owner]
    return begin + within, begin + np.minimum(within + WINDOW, sizes[owner]), owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Parameters in self.p; a window is a row of indices into a table of word inputs, -1 where it has ended."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIMS + GRAM_DIMS, HIDDEN
        f = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"word": f(WORD_SLOTS, WORD_DIMS) * 0.1, "gram": f(GRAM_SLOTS, GRAM_DIMS) * 0.1, "att": f(2 * h, h), "att_v": f(h), "out": f(2 * h), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": f(d, 3 * h), f"u{way}": f(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32), f"n{way}": np.zeros(h, np.float32)}

    def inputs(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        word, gram, start = found
        if not len(word):
            return np.zeros((0, WORD_DIMS + GRAM_DIMS), np.float32)
        return np.concatenate([self.p["word"][word], np.maximum.reduceat(self.p["gram"][gram], start, axis=0)], axis=1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The share of the gates that comes from the words; a last row stands for no word."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return {way: x @ self.p[f"w{way}"] + self.p[f"c{way}"] for way in "fb"}

    def forward(self, at: np.ndarray, gates: dict[str, np.ndarray], trace: dict | None = None) -> np.ndarray:
        """Log-odds of each window; at: windows x steps."""
        b, t = at.shape
        h = HIDDEN
        states = np.zeros((t, b, 2 * h), np.float32)
        live = (at >= 0).astype(np.float32)
        for k, way in enumerate("fb"):
            u, rest, now = self.p[f"u{way}"], self.p[f"n{way}"], np.zeros((b, h), np.float32)
            for s in range(t) if way == "f" else range(t - 1, -1, -1):
                given, own = gates[way][at[:, s]], now @ u
                zr = sigmoid(given[:, : 2 * h] + own[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                inner = own[:, 2 * h :] + rest
                new = np.tanh(given[:, 2 * h :] + r * inner)
                m = live[:, s : s + 1]
                if trace is not None:
                    trace[way, s] = (now, z, r, inner, new)
                now = now + m * (1 - z) * (new - now)
                states[s, :, k * h : (k + 1) * h] = now
        key = np.tanh(states @ self.p["att"])
        weight = np.where(live.T > 0, key @ self.p["att_v"], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * live.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if trace is not None:
            trace["all"] = (states, key, weight, pooled, live)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, at: np.ndarray, d_out: np.ndarray, trace: dict, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters, and of the word inputs x."""
        h, (states, key, weight, pooled, live) = HIDDEN, trace["all"]
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        g["out"], g["bias"] = d_out @ pooled, np.array([d_out.sum()], np.float32)
        d_pooled = d_out[:, None] * p["out"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tb,tbh->h", d_score, key)
        d_key = d_score[:, :, None] * p["att_v"] * (1 - key**2)
        g["att"] = np.einsum("tbi,tbh->ih", states, d_key)
        d_states = weight[:, :, None] * d_pooled + d_key @ p["att"].T
        d_x, padded = np.zeros((len(x) + 1, x.shape[1]), np.float32), np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        t = at.shape[1]
        for k, way in enumerate("fb"):
            u, d_now = p[f"u{way}"], np.zeros((len(at), h), np.float32)
            for s in range(t - 1, -1, -1) if way == "f" else range(t):
                before, z, r, inner, new = trace[way, s]
                d_now = d_now + d_states[s, :, k * h : (k + 1) * h]
                m = live[:, s : s + 1]
                d_new = d_now * m * (1 - z) * (1 - new**2)
                d_z = d_now * m * (before - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_given = np.concatenate([d_z, d_r, d_new], axis=1)
                d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"n{way}"] += (d_new * r).sum(axis=0)
                g[f"c{way}"] += d_given.sum(axis=0)
                g[f"u{way}"] += before.T @ d_own
                g[f"w{way}"] += padded[at[:, s]].T @ d_given
                np.add.at(d_x, at[:, s], d_given @ p[f"w{way}"].T)
                d_now = d_now * (1 - m * (1 - z)) + d_own @ u.T
        return g, d_x[:-1]


def _windows(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts given as word indices: indices padded with -1, and the text of each."""
    start, end, owner = windows_of(sizes)
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < end[:, None], np.append(words, -1)[np.minimum(place, len(words))], -1), owner


def calibrated(net: BiGRU, texts: list[str], labels: np.ndarray, at: float = 0.7) -> BiGRU:
    """Moves the bias so that the best cut between texts that weren't learned from comes to score `at`."""
    if len(texts) and labels.min() != labels.max():
        p = np.clip(Scorer(net).score(texts), 1e-7, 1 - 1e-7)
        logit = np.log(p / (1 - p))
        order = np.sort(logit)
        cuts = (order[1:] + order[:-1]) / 2
        right = np.array([(logit[labels == 1] >= c).mean() + 3 * (logit[labels == 0] < c).mean() for c in cuts])  # a clean text counts three times
        best = np.flatnonzero(right >= right.max() - 1e-12)
        net.p["bias"][0] += np.log(at / (1 - at)) - cuts[best].mean()
    return net


def fit_network(texts: list[str], labels: np.ndarray, rounds: int = 9, batch: int = 64, rate: float = 0.01, seed: int = 1) -> BiGRU:
    """Vectors start at the smoothed log-odds that a text with the word or n-gram is toxic; then Adam."""
    net, rng = BiGRU(seed), np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    coded = [[index.setdefault(w, len(index)) for w in words_of(t)] for t in texts]
    if not len(texts) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["bias"][0] = 0 if not len(texts) else (3 if labels[0] else -3)
        return net
    word, gram, start = found = features(list(index))
    n_of = np.diff(np.r_[start, len(gram)])
    ones, zeros = int(labels.sum()), int((1 - labels).sum())
    known: dict[str, np.ndarray] = {}
    for name in ("word", "gram"):
        seen = np.zeros((2, len(net.p[name])))
        for words, y in zip(coded, labels):
            own = sorted(set(words))
            if own:
                slots = word[own] if name == "word" else np.concatenate([gram[start[w] : start[w] + n_of[w]] for w in own])
                seen[int(y)][np.unique(slots)] += 1
        odds = np.log((seen[1] + 2) / (ones + 4)) - np.log((seen[0] + 2) / (zeros + 4))
        net.p[name][:, 0] = (odds / 2).astype(np.float32)
        known[name] = (seen.sum(axis=0) >= LEAST_TEXTS).astype(np.float32)
        net.p[name] *= known[name][:, None]  # what few texts have stands for nothing, in training as in scoring
    for way in "fb":
        net.p[f"w{way}"][0] += 0.5
        net.p[f"w{way}"][WORD_DIMS] += 0.5
    at, owner = _windows(np.array([w for words in coded for w in words], dtype=np.int64), np.array([len(words) for words in coded], dtype=np.int64))
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    evidence = np.r_[net.inputs(found)[:, [0, WORD_DIMS]].sum(axis=1), -9]
    worst = np.where(at >= 0, evidence[at], -9).max(axis=1)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    size = np.diff(np.r_[first, len(owner)])
    for turn in range(rounds):
        if turn > 1:
            gates = net.project(net.inputs(found))
            worst = np.concatenate([net.forward(at[a : a + 4096], gates) for a in range(0, len(at), 4096)])
        ranked = np.lexsort((-worst, owner))
        chosen = ranked[first]  # the worst window of each text
        other = first + rng.integers(0, size)
        other = other[labels[owner[other]] == 0]  # and any window of a clean one
        picked = rng.permutation(np.unique(np.concatenate([chosen, other])))
        weight = np.where(labels == 1, 0.5 / ones, 0.5 / zeros) * len(labels)
        for a in range(0, len(picked), batch):
            rows = picked[a : a + batch]
            used, local = np.unique(at[rows], return_inverse=True)
            local = local.reshape(at[rows].shape) - (1 if used[0] < 0 else 0)
            used = used[used >= 0]
            mine = np.concatenate([np.arange(start[w], start[w] + n_of[w]) for w in used]) if len(used) else np.empty(0, np.int64)
            part = (word[used], gram[mine], np.cumsum(n_of[used]) - n_of[used])
            x, trace = net.inputs(part), {}
            hidden = rng.random(len(x)) < 0.3  # words whose own vector isn't shown this time: their letters must do
            x[hidden, :WORD_DIMS] = 0
            y = labels[owner[rows]].astype(np.float32)
            logit = net.forward(local, net.project(x), trace)
            d = ((sigmoid(logit) - y) * weight[owner[rows]] / len(rows)).astype(np.float32)
            grads, d_x = net.backward(local, d, trace, x)
            step += 1
            for name, g in grads.items():
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                net.p[name] -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            shown = ~hidden & (known["word"][part[0]] > 0)
            np.subtract.at(net.p["word"], part[0][shown], rate * 2 * d_x[shown, :WORD_DIMS])
            if len(used):  # the n-gram that gave the maximum learns
                value = net.p["gram"][part[1]]
                of = np.repeat(np.arange(len(used)), n_of[used])
                top = (value >= x[of, WORD_DIMS:]) & (known["gram"][part[1]] > 0)[:, None]
                np.subtract.at(net.p["gram"], part[1], rate * 2 * np.where(top, d_x[of, WORD_DIMS:], 0))
    return net


class Scorer:
    """Scores texts; the gates' shares of seen words are remembered up to a bound."""

    most_words = 1 << 18

    def __init__(self, net: BiGRU):
        self.net, self.index = net, {}
        self._empty()

    def _empty(self) -> None:
        self.index.clear()
        self.table = {way: np.zeros((1024, 3 * HIDDEN), np.float32) for way in "fb"}

    def _learn(self, fresh: list[bytes]) -> None:
        gates = self.net.project(self.net.inputs(features(fresh)))
        a, b = len(self.index), len(self.index) + len(fresh)
        for way, rows in gates.items():
            if b + 1 > len(self.table[way]):
                self.table[way] = np.concatenate([self.table[way], np.zeros((max(b, len(self.table[way])), 3 * HIDDEN), np.float32)])
            self.table[way][a:b] = rows[:-1]
            self.table[way][-1] = rows[-1]  # index -1: no word
        self.index.update(zip(fresh, range(a, b)))

    def score(self, texts: list[str]) -> np.ndarray:
        """The worst window's probability, per text; a text without words has one window without words."""
        if len(self.index) > self.most_words:
            self._empty()
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
        starts, ends = split_words(data)
        sizes = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in raw])), prepend=0)
        letters = np.zeros(len(data) + 1, dtype=np.int8)
        letters[starts], letters[ends] = 1, -1
        packed = data[np.cumsum(letters[:-1], dtype=np.int8) > 0].tobytes()
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        told = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        kinds = told.dictionary.to_pylist()
        fresh = [w for w in kinds if w not in self.index]
        if fresh or not self.index:
            self._learn(fresh)
        coded = np.array([self.index[w] for w in kinds], dtype=np.int64)[told.indices.to_numpy()]
        out = np.full(len(texts), -np.inf)
        at, owner = _windows(coded, sizes)
        for a in range(0, len(at), 2048):
            np.maximum.at(out, owner[a : a + 2048], self.net.forward(at[a : a + 2048], self.table))
        return sigmoid(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, most_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> BiGRU:
    """Fits on at most most_rows labelled documents of each class (a bounded, reproducible sample; see labelled_sample)."""
    rows = sorted(labelled_sample(docs, labels, label, most_rows, train, id_col, text_col).collect())
    texts, y = [r.text for r in rows], np.array([r.label for r in rows], dtype=np.int64)
    aside = np.arange(len(rows)) % 4 == 3  # for the calibration
    return calibrated(fit_network([t for t, a in zip(texts, aside) if not a], y[~aside]), [t for t, a in zip(texts, aside) if a], y[aside])


def toxicity_scores(docs: DataFrame, model: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col and score (0 to 1, higher: toxic likelier) of the whole text.

    Windows of WINDOW words, one begun every STRIDE words, cover the whole text and are scored; a passage of more than
    WINDOW - STRIDE words may be cut by all of them, but half a window of it is always whole. Null and empty texts have the score of a window without words; repeated and null ids stay, one row each. The model's size is fixed. One pass, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scorer" not in state:
            state["scorer"] = Scorer(held.value)
        score = state["scorer"].score([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.astype(np.float64))], names=[id_col, "score"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return mapped(picked, work, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, score double", 4 << 20)
