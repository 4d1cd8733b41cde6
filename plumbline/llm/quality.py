"""Quality: gradient-boosted trees over document statistics.

Statistics are counted from the bytes of whole texts. Trees grow on histograms of binned statistics and are
flattened into arrays, so that a batch walks every tree with a few numpy gathers per level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, labelled_sample, mapped, text_bytes

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "stop": b".,;:",
    "loud": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*+<>=@^~_/\\",
    "quote": b"\"'()[]{}-`",
    "wide": bytes(range(128, 256)),
}
STATISTICS = [*CLASSES, "entropy", "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "commonest_word", "repeats", "log_lines", "line_words", "distinct_lines"]


def document_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.zeros((n, 256))
    step = 64  # texts at once: their histograms stay in cache
    for a in range(0, n, step):
        raw = np.frombuffer(b"".join(texts[a : a + step]), dtype=np.uint8)
        own = np.repeat(np.arange(min(step, n - a), dtype=np.int32) * 256, sizes[a : a + step])
        counts[a : a + step] = np.bincount(own + raw, minlength=256 * min(step, n - a)).reshape(-1, 256)
    share = counts / np.maximum(sizes, 1)[:, None]
    out = np.zeros((n, len(STATISTICS)))
    for k, members in enumerate(CLASSES.values()):
        out[:, k] = share[:, list(members)].sum(axis=1)
    k = len(CLASSES)
    out[:, k] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    out[:, k + 1] = np.log1p(sizes)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        tally = Counter(words)
        lines = text.split(b"\n")
        m = len(words)
        out[i, k + 2 :] = (np.log(m + 1), sum(map(len, words)) / m, max(map(len, tally)), len(tally) / m, max(tally.values()) / m, sum(map(eq, words, words[1:])) / m, np.log(len(lines)), m / len(lines), len(set(lines)) / len(lines))
    return out


@dataclass
class Forest:
    """Trees as arrays: node k of a tree sends rows with column feature[k] <= threshold[k] to left[k], others
    to left[k] + 1; a leaf leads to itself and adds value[k]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_right = x[rows, self.feature[node]] > self.threshold[node]
                inner = self.left[node] != node
                node = self.left[node] + (goes_right & inner)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 3.0, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss. Without rows of both classes every score is the share of label 1, or 0.5."""
    rate_of_ones = float(y.mean()) if len(y) else 0.5
    base = float(np.log((rate_of_ones + 1e-3) / (1 - rate_of_ones + 1e-3)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if len(y) and 0 < rate_of_ones < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(feature))
            feature, threshold, left, value = [*feature, 0], [*threshold, 0.0], [*left, len(feature)], [*value, 0.0]
            level = [(roots[-1], np.arange(len(y)))]
            for at_depth in range(depth + 1):
                following = []
                for node, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    best = (1e-6, None)
                    if at_depth < depth and len(rows) >= 2:
                        for f, cut in enumerate(cuts):
                            if not len(cut):
                                continue
                            b = binned[rows, f]
                            gl = np.cumsum(np.bincount(b, weights=grad[rows], minlength=len(cut) + 1))[:-1]
                            hl = np.cumsum(np.bincount(b, weights=hess[rows], minlength=len(cut) + 1))[:-1]
                            nl = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                            gain[(nl < least) | (len(rows) - nl < least)] = 0
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (gain[k], (f, k))
                    if best[1] is None:
                        value[node] = float(-rate * g / (h + ridge))
                        raw[rows] += value[node]
                        continue
                    f, k = best[1]
                    feature[node], threshold[node], left[node] = f, float(cuts[f][k]), len(feature)
                    for side in (rows[binned[rows, f] <= k], rows[binned[rows, f] > k]):
                        following.append((len(feature), side))
                        feature, threshold, left, value = [*feature, 0], [*threshold, 0.0], [*left, len(feature)], [*value, 0.0]
                level = following
    return Forest(base, np.array(feature, dtype=np.int64), np.array(threshold), np.array(left, dtype=np.int64), np.array(value), np.array(roots, dtype=np.int64), depth)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, most_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fits on at most most_rows labelled documents of each class (a bounded, reproducible sample; see labelled_sample)."""
    sample = labelled_sample(docs, labels, label, most_rows, train, id_col, text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = document_statistics(text_bytes(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = mapped(sample, work, "x array<double>, label int").collect()
    rows.sort()  # the order in which tasks end doesn't matter
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_forest(x, np.array([r.label for r in rows], dtype=np.float64))


def quality_scores(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: id_col, score (0 to 1, higher: label 1 likelier), and the columns named in keep.

    Null and empty texts are scored as a text without words; repeated and null ids stay, one row each. The
    model is a few thousand numbers, whatever the corpus. One pass, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([id_col, *(keep or []), text_col]))
    wanted = [n for n in names if n != text_col or text_col in (keep or [])]
    picked = docs.select(*[F.col(f"`{n}`") for n in names])
    at = names.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = held.value.score(document_statistics(text_bytes(batch.column(at))))
        return pa.RecordBatch.from_arrays([*[batch.column(names.index(n)) for n in wanted], pa.array(score)], names=[*wanted, "score"])

    kinds = ", ".join(f"`{n}` {picked.schema[n].dataType.simpleString()}" for n in wanted)
    return mapped(picked, work, f"{kinds}, score double")


def keep_quality(docs: DataFrame, model: Forest, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least `least`; columns stay as they are. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, lambda texts: (held.value.score(document_statistics(text_bytes(texts))) >= least).tolist())
