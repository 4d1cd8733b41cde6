"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

A window counts as the item's if the weighted similarity of their word shingles reaches the threshold. Only
windows that hold enough of some item's shingles can, so only those are fingerprinted; this loses nothing. A window's
fingerprint is looked up in tables, one per block of bits, of which at least one must find every item within the
radius; what they find is verified exactly, on shingles weighted by their counts. Each table lists values within four
of a block's 16 bits, one in 26, so a window looks at about a seventh of the items. At the default radius of 19 a
window of similarity 0.8 lies outside it about once in 2,000 (64 bits that differ with a chance of 0.15 each), one of
0.85 about once in 100,000.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, filter_rows, mapped, mix64

BITS, BLOCKS = 64, 4
BLOCK_BITS = BITS // BLOCKS
_WORDS = re.compile(r"\w+")
_SIGNS = 1 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)  # a 1 bit counts -1


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def shingles_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of k words, in order; of fewer words one of them all."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(k, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        out = mix64(out ^ hashes[j : n - size + 1 + j]) + np.uint64(size)
    return out


def bit_votes(shingles: np.ndarray) -> np.ndarray:
    """What each shingle adds to each bit of a SimHash: rows of BITS values 1 or -1."""
    raw = mix64(shingles).astype(">u8").view(np.uint8).reshape(-1, 8)
    return _SIGNS[raw].reshape(len(shingles), BITS)


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """SimHash of summed votes: bit set where they are negative."""
    return np.packbits(votes < 0, axis=1).view(">u8").astype(np.uint64).ravel()


def _ball(reach: int) -> np.ndarray:
    """All values of a block with at most `reach` bits set."""
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    return values[np.bitwise_count(values) <= reach]


class HammingIndex:
    """All fingerprints within `radius` of a query: in one of BLOCKS blocks they differ by at most radius // BLOCKS
    bits. A table per block names the items of each value; of few items also those of each near value, else near
    values are tried one by one."""

    spread = 4096  # items up to which tables name near values

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        ball = _ball(radius // BLOCKS)
        self.tries = ball if len(prints) > self.spread else np.zeros(1, dtype=np.uint64)
        self.looked_at = 0  # items that lookups have named so far
        self.tables = []
        for k in range(BLOCKS):
            own = self._block(prints, k)
            value, item = own, np.arange(len(prints))
            if len(prints) <= self.spread:
                value, item = (own[:, None] ^ ball[None, :]).ravel(), np.repeat(item, len(ball))
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64)), item[order].astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius, each once."""
        pairs = [np.empty(0, np.int64)]
        step = max(1, (1 << 20) // len(self.tries))
        for k, (start, items) in enumerate(self.tables):
            for a in range(0, len(queries), step):
                part = self._block(queries[a : a + step], k)
                at = (part[:, None] ^ self.tries[None, :]).astype(np.int64).ravel()
                n = start[at + 1] - start[at]
                query = np.repeat(a + np.arange(len(part)), n.reshape(len(part), -1).sum(axis=1))
                item = items[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(query))]
                self.looked_at += len(item)
                close = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
                pairs.append(query[close] * np.int64(len(self.prints)) + item[close])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


@dataclass
class Items:
    """Benchmark items, prepared on the driver and broadcast."""

    ids: list[int | None]
    shingles: list[np.ndarray]
    known: np.ndarray  # all their shingles, sorted
    sizes: np.ndarray  # shingles in each
    print_items: np.ndarray  # items that have a fingerprint of their own, the others being their copies
    index: HammingIndex
    filter: np.ndarray  # which low 20 bits any of their shingles has
    postings: tuple[np.ndarray, np.ndarray]  # per known shingle, where its items' sizes begin; item sizes
    short: dict[int, dict[int, list[int | None]]]  # by number of words, fewer than a shingle's: ids by hash; not among the others


def prepare_items(rows: list[tuple[int | None, str]], shingle: int, radius: int) -> Items:
    words = WordHashes()
    kept, short = [], {}
    for i, t in rows:
        hashes = words.of([w.encode() for w in words_of(t or "")])
        s = shingles_of(hashes, shingle)
        if len(hashes) >= shingle:
            kept.append((i, s))
        elif len(s):
            short.setdefault(len(hashes), {}).setdefault(int(s[0]), []).append(i)
    sizes = np.array([len(s) for _, s in kept], dtype=np.int64)
    all_of = np.concatenate([s for _, s in kept]) if kept else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(kept)), sizes)
    known = np.unique(all_of)
    low = np.zeros(1 << 20, dtype=bool)
    low[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    pair = np.unique(np.stack([np.searchsorted(known, all_of), sizes[owner]], axis=1), axis=0) if len(known) else np.empty((0, 2), np.int64)
    postings = (np.searchsorted(pair[:, 0], np.arange(len(known) + 1)), pair[:, 1])
    prints = np.array([fingerprints(bit_votes(s).sum(axis=0, keepdims=True))[0] for _, s in kept], dtype=np.uint64)
    return Items([i for i, _ in kept], [s for _, s in kept], known, sizes, np.arange(len(kept)), HammingIndex(prints, radius), low, postings, short)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over joint shingles, each counted as often as it stands in both or in either."""
    both = np.concatenate([a, b])
    kinds, of = np.unique(both, return_inverse=True)
    x, y = (np.bincount(p, minlength=len(kinds)) for p in (of[: len(a)], of[len(a) :]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def find_short(hashes: np.ndarray, items: Items) -> list[tuple[int | None, int, int, int, float]]:
    """As find_items, of items shorter than a shingle: a window of as many words is the item or shares nothing with it."""
    out = []
    for n, ids in items.short.items():
        if len(hashes) >= n:
            s = shingles_of(hashes, n)
            kinds, first = np.unique(s, return_index=True)
            at = np.flatnonzero(np.isin(kinds, np.fromiter(ids, dtype=np.uint64, count=len(ids))))
            out += [(i, f, n, 0, 1.0) for x, f in zip(kinds[at].tolist(), first[at].tolist()) for i in ids[x]]
    return out


def find_items(hashes: np.ndarray, items: Items, shingle: int, threshold: float) -> list[tuple[int | None, int, int, int, float]]:
    """(item id, first word, number of words, Hamming distance, similarity): each item's best window in a text."""
    return find_short(hashes, items) + find_long(hashes, items, shingle, threshold)


def find_long(hashes: np.ndarray, items: Items, shingle: int, threshold: float) -> list[tuple[int | None, int, int, int, float]]:
    """As find_items, of items of a shingle's words or more."""
    s = shingles_of(hashes, shingle)
    if not len(s) or not len(items.known):
        return []
    maybe = np.flatnonzero(items.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.known, s[maybe]), len(items.known) - 1)
    sure = items.known[at] == s[maybe]
    hit, at = maybe[sure], at[sure]
    if not len(hit):
        return []
    # windows of an item's size (in shingles) that hold one of its shingles; short texts are one window
    start, of_size = items.postings
    n = start[at + 1] - start[at]
    size = of_size[np.repeat(start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    place = np.repeat(hit, n)
    key = np.unique(size * np.int64(len(s)) + place)  # by size, then place
    size, place = key // len(s), key % len(s)
    # a window that reaches the threshold holds at least that share of the item's size in item shingles
    windows = []
    for one in np.unique(size).tolist():
        places = place[size == one]
        width = min(one, len(s))
        first = np.unique((np.maximum(places[:, None] - np.arange(width)[None, :], 0)).ravel())
        first = first[first <= len(s) - width]
        inside = np.searchsorted(places, first + width) - np.searchsorted(places, first)
        first = first[inside >= threshold * one * 0.999 - 1e-9]
        if len(first):
            windows.append(np.stack([first, np.full(len(first), width)], axis=1))
    if not windows:
        return []
    windows = np.unique(np.concatenate(windows), axis=0)
    low, high = int(windows[:, 0].min()), int((windows[:, 0] + windows[:, 1]).max())
    best: dict[int, tuple] = {}
    step = max(1, min(1 << 14, (1 << 22) // max(1, len(items.shingles))))
    for a in range(0, len(windows), step):  # bounded memory for texts of any length
        part = windows[a : a + step]
        low, high = int(part[:, 0].min()), int((part[:, 0] + part[:, 1]).max())
        covered = np.zeros(high - low + 1, dtype=np.int32)
        np.add.at(covered, part[:, 0] - low, 1)
        np.add.at(covered, part[:, 0] + part[:, 1] - low, -1)
        need = np.flatnonzero(np.cumsum(covered[:-1]) > 0)  # only covered shingles vote
        spot = np.zeros(high - low + 1, dtype=np.int64)
        spot[need + 1] = 1
        spot = np.cumsum(spot)
        sums = np.zeros((len(need) + 1, BITS), dtype=np.int32)
        np.cumsum(bit_votes(s[low + need]), axis=0, out=sums[1:])
        prints = fingerprints(sums[spot[part[:, 0] + part[:, 1] - low]] - sums[spot[part[:, 0] - low]])
        query, item = items.index.near(prints)
        for q, k in zip(query.tolist(), item.tolist()):
            first, width = part[q].tolist()
            own = items.shingles[k]
            if min(width, len(own)) < threshold * max(width, len(own)):
                continue
            similarity = weighted_similarity(s[first : first + width], own)
            if similarity >= threshold:
                distance = int(np.bitwise_count(prints[q] ^ items.index.prints[k]))
                found = (-similarity, distance, first, width)
                if k not in best or found < best[k]:
                    best[k] = found
    return [(items.ids[k], f, w + min(shingle, len(hashes)) - 1, d, -x) for k, (x, d, f, w) in sorted(best.items())]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 19, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item of which it holds a window: id_col, item_id, first_word, n_words,
    hamming, similarity (of the best window; of equals the nearest, then the first).

    Words are runs of letters, digits and _, in small letters. Documents and items without words have no hits;
    an item of fewer words than a shingle is one shingle of its own number of words, found in texts of any length;
    rows with null ids count like others; copies of rows have copies of hits. Of the benchmark, most_bytes of text at
    most are held at a time: a larger one is dealt into parts, each of them one more pass over documents. No shuffle.
    """
    out = None
    for held in held_items(docs, benchmark, shingle, radius, most_bytes, item_col, item_text_col):
        one = _hits(docs, held, shingle, threshold, id_col, text_col)
        out = one if out is None else out.unionByName(one)
    return out


def _hits(docs: DataFrame, held, shingle: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["words"] = TextWordHashes()
        ids, found = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for hit in find_items(state["words"].of(words_of(text)), held.value, shingle, threshold) if text else []:
                ids.append(k)
                found.append(hit)
        columns = [pa.array([f[j] for f in found], pa.float64() if j == 4 else pa.int64()) for j in range(5)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=[id_col, "item_id", "first_word", "n_words", "hamming", "similarity"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return mapped(picked, work, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, item_id long, first_word long, n_words long, hamming long, similarity double", 8 << 20)


class TextWordHashes(WordHashes):
    """The same hashes, by words as text."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return out


def held_items(docs: DataFrame, benchmark: DataFrame, shingle: int, radius: int, most_bytes: int, item_col: str, item_text_col: str) -> Iterator:
    """The prepared benchmark as broadcast variables of at most about most_bytes of text each, one at least."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n_parts = 1 if total <= most_bytes else -(-2 * total // most_bytes)
    for k in range(n_parts):
        part = rows if n_parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_parts)) == k)
        known = sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        yield docs.sparkSession.sparkContext.broadcast(prepare_items(known, shingle, radius))


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 19, most_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a window of a benchmark item; columns stay as they are. Null and
    empty texts stay. See benchmark_hits. One pass over what is left for each part of the benchmark, no shuffle."""
    for held in held_items(docs, benchmark, shingle, radius, most_bytes, item_col, item_text_col):
        docs = filter_rows(docs, text_col, _clean(held, shingle, threshold))
    return docs


def _clean(held, shingle: int, threshold: float) -> Callable[[pa.Array], list[bool]]:
    state: dict = {}

    def clean(texts: pa.Array) -> list[bool]:
        if not state:
            state["words"] = TextWordHashes()
        return [not (t and find_items(state["words"].of(words_of(t)), held.value, shingle, threshold)) for t in texts.to_pylist()]

    return clean
