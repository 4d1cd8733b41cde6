"""Repeated passages: FM-indexes over wavelet matrices, backward search, matching statistics.

A window is WINDOW words in a row. Its minimiser is the smallest hash among its short word runs, so equal windows
have equal minimisers, and a document falls into segments: the words of consecutive windows with one minimiser.

1. Minimisers are counted over the corpus. Those that occur once hold no repeated window. A bitmap lets the
   segments of all others through (and a few more; it only saves work); a second one names those that occur often.
2. Segments of one minimiser meet in one shard. One that occurs twice is repeated as a whole; a batch that holds it
   twice knows that by itself, and sends it on once, so no place of a passage that stands everywhere is dealt by a
   key. A shard's FM-index is searched backwards with the segments that occur once, all windows side by side: the
   matching statistic of a window end is the length of the longest match there that occurs twice, and where it
   reaches WINDOW the window is repeated.
3. Segments of a frequent minimiser are dealt by themselves instead, and those that occur once are compared window
   by window, by the windows' own hashes.
4. The intervals go back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, give_back, mapped, mix64, ship, text_bytes, word_hashes

RUN = 8  # words; a power of two
#: Bits of a bitmap for each minimiser in it, and the most bits it may have: 2 ** 30 (128 MB).
BITS_EACH, MOST_BITS = 16, 30


def run_hashes(hashes: np.ndarray) -> np.ndarray:
    out, width = hashes, 1
    while width < RUN:
        out = mix64(out[:-width] * np.uint64(0x9E3779B97F4A7C15) + out[width:])
        width *= 2
    return out


def segments(hashes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and one past the last window of each segment of some texts, given the hashes of all
    their words and the number of each text's."""
    n_windows = len(hashes) - window + 1
    if n_windows <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    least, span = run_hashes(hashes), window - RUN + 1
    # the smallest of each span and where it first stands, by doubling; equal windows choose alike
    place, width = np.arange(len(least)), 1
    runs = least
    while width < span:
        step = min(width, span - width)
        smaller = least[step:] < least[:-step]
        place = np.where(smaller, place[step:], place[:-step])
        least = np.where(smaller, least[step:], least[:-step])
        width += step
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[:n_windows] == owner[window - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    first = np.flatnonzero(begins)
    return runs[place[first]], first, np.flatnonzero(ends) + 1


class SpanHashes:
    """Hashes of spans of words: polynomials modulo 2 ** 64 in an odd number, from sums up to each word."""

    step = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, hashes: np.ndarray, seed: int):
        n = len(hashes)
        self.down = np.concatenate([np.ones(1, np.uint64), np.full(n, self.back)])
        np.multiply.accumulate(self.down, out=self.down)
        up = np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), self.step)])[:n]
        np.multiply.accumulate(up, out=up)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes + np.uint64(seed)) * up, dtype=np.uint64)])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64)).view(np.int64)


def span_ids(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each span of words."""
    return SpanHashes(hashes, 0x5851F42D4C957F2D).of(first, end), SpanHashes(hashes, 0x14057B7EF767814F).of(first, end)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class WaveletMatrix:
    """Ranks over a sequence of numbers below 2 ** levels; bits are packed, with a count before every 64th."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.packed, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            raw = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view("<u8")
            self.packed.append(raw)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(raw))].astype(np.int64))
            self.zeros.append(int((~bit).sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.start = self.descend(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.packed[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before position at."""
        return self.descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Of several segments of words (numbers from 1), each followed by an end of its own."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, sigma: int):
        """text: words, and 0 at each position in ends."""
        n = len(text)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # ends sort before words, each differently: suffixes differ within a segment
        _, rank = np.unique(rank, return_inverse=True)
        width = 1
        while True:
            following = np.zeros(n, dtype=np.int64)
            following[: n - width] = rank[width:] + 1
            key = rank * np.int64(n + 1) + following
            order = np.argsort(key)
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
            rank, width = new, width * 2
            if rank[order[-1]] == n - 1 or width >= n:
                break
        self.sa = order
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))].astype(np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with symbol and go on as those of [low, high) do."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def matching_statistics(self, text: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """For each position `at` of a text, the length, up to most, of the longest match that ends there and
        occurs at least twice in the index."""
        length = np.zeros(len(at), dtype=np.int64)
        live = np.arange(len(at))
        symbol = text[at]
        low, high = self.first[symbol], self.first[symbol + 1]
        for step in range(1, most + 1):
            good = high - low >= 2
            live, low, high = live[good], low[good], high[good]
            length[live] = step
            if step == most or not len(live):
                break
            symbol = np.where(at[live] >= step, text[at[live] - step], 0)
            low, high = self.extend(symbol, low, high)
            high = np.where(symbol > 0, high, low)  # no match goes past an end
        return length


def repeated_in_shard(contents: list[np.ndarray], counts: np.ndarray, window: int, at_once: int = 1 << 18) -> list[np.ndarray]:
    """For each distinct segment of a shard, which of its windows occur at least twice, segments counted as often as
    they occur."""
    out = [np.full(len(c) - window + 1, n > 1) for c, n in zip(contents, counts.tolist())]
    single = np.flatnonzero(counts == 1)
    if not len(single):
        return out
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    flat = np.concatenate(contents)
    words, number = np.unique(flat, return_inverse=True)
    text = np.zeros(len(flat) + len(contents), dtype=np.int64)
    own = np.repeat(np.arange(len(contents)), sizes)
    text[np.arange(len(flat)) + own] = number + 1
    ends = np.cumsum(sizes + 1) - 1
    index = FMIndex(text, ends, len(words) + 1)
    begin = ends - sizes
    n_windows = sizes[single] - window + 1
    which = np.repeat(single, n_windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    last = begin[which] + offset + window - 1
    found = np.concatenate([index.matching_statistics(text, last[a : a + at_once], window) >= window for a in range(0, len(last), at_once)])
    for k, part in zip(single.tolist(), np.split(found, np.cumsum(n_windows)[:-1])):
        out[k] = part
    return out


def _covered(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Intervals of words that flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(at, cut)]


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", often: int = 4096, shard_words: int = 1 << 19) -> DataFrame:
    """Per row of docs: id_col, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs of anything but ASCII white space, as they are. A word goes if some window that covers it occurs
    anywhere else as well, in the same text too; windows are judged on the input. Null, empty and short texts keep
    all words; null ids count like others; equal rows are occurrences of each other. Words are told apart by 64
    bits of their hash, segments by 128. A minimiser that occurs `often` times is frequent. Memory is bounded by
    shard_words, often and a text. Steps go to the session's shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, n = np.unique(segments(*word_hashes(text_bytes(batch.column(0))), window)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n, pa.int64())], names=["m", "n"])

    counted = mapped(source.select("_text"), count, "m long, n long", 8 << 20)
    repeated = scratch.keep(counted.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1"))
    scratch.tidy()

    def bitmap(of: DataFrame) -> np.ndarray:
        """The minimisers of a table as a bitmap whose size follows their number, up to a bound."""
        bits = min(MOST_BITS, max(16, (BITS_EACH * of.count()).bit_length()))
        at = F.col("m").bitwiseAND((1 << bits) - 1)
        words = of.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m & 63 as int))")).alias("b"))
        told = words.toArrow()  # 2 ** (bits - 6) rows at most
        out = np.zeros(1 << (bits - 6), dtype=np.uint64)
        out[told.column("w").to_numpy()] = told.column("b").to_numpy().view(np.uint64)
        return out

    held = spark.sparkContext.broadcast((bitmap(repeated), bitmap(repeated.where(F.col("n") >= often))))

    def marked(bits: np.ndarray, minimisers: np.ndarray) -> np.ndarray:
        at = minimisers & np.uint64(64 * len(bits) - 1)
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    id_type = to_arrow_type(source.schema["_id"].dataType)
    kind = source.schema["_id"].dataType.simpleString()
    lists = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch's different segments, dealt by key: each once, with its place if it has one place only; and the
        places of those with several, dealt evenly."""
        hashes, sizes = word_hashes(text_bytes(batch.column(2)))
        m, first, last = segments(hashes, sizes, window)
        some = marked(held.value[0], m)
        m, first, end = m[some], first[some], last[some] + window - 1
        s1, s2 = span_ids(hashes, first, end)
        order = np.lexsort((s2, s1))
        m, first, end, s1, s2 = m[order], first[order], end[order], s1[order], s2[order]
        new = np.flatnonzero(np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))) if len(m) else np.empty(0, np.int64)
        n = np.diff(np.append(new, len(m)))
        often_ = marked(held.value[1], m[new])
        several = n > 1
        doc = np.searchsorted(np.cumsum(sizes), first, side="right")
        begin = first - (np.cumsum(sizes) - sizes)[doc]
        length = (end - first)[new]
        places = [ranges(new, np.where(several, 0, 1)), ranges(new[several], n[several])]  # of the segments, then of the rest
        rows = np.concatenate(places)
        docs_of = pa.array(doc[rows], pa.int64())
        per_row = np.concatenate([np.where(several, 0, 1), n[several]])
        content = np.concatenate([length, np.zeros(int(several.sum()), dtype=np.int64)])
        both = lambda a, b: pa.array(np.concatenate([a, b]), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                both(np.where(often_, s1[new], m[new].view(np.int64)), s1[new][several] ^ first[new][several]), pa.array(np.concatenate([often_, np.zeros(int(several.sum()), dtype=bool)])),
                both(s1[new], s1[new][several]), both(s2[new], s2[new][several]), both(n, n[several]), both(length, length[several]),
                lists(content, pa.array(hashes[ranges(first[new], length)].view(np.int64))),
                lists(per_row, batch.column(0).take(docs_of)), lists(per_row, batch.column(1).take(docs_of)), lists(per_row, pa.array(begin[rows], pa.int64())),
            ],
            names=["key", "often", "s1", "s2", "n", "size", "content", "ids", "hashes", "firsts"],
        )

    emitted = mapped(source, emit, f"key long, often boolean, s1 long, s2 long, n long, size long, content array<long>, ids array<{kind}>, hashes array<long>, firsts array<long>", 8 << 20)
    names = ["_id", "_hash", "a", "b", "w1", "w2", "n"]
    kinds = f"_id {kind}, _hash long, a long, b long, w1 long, w2 long, n long"

    def search(batches):
        """Segments come sorted by key and id. Those of a minimiser are gathered, and a shard is searched when it is
        full; frequent ones go on window by window. Rows out are intervals of documents, or windows (w1, w2) with the
        interval that they cover, or without one if they are known to be repeated."""
        shard: list[list] = []
        frequent: list[list] = []
        group: list[list] = []  # of [s1, s2, occurs more than once, content, and its place: id, hash, first]
        n_words, at = 0, None

        def table(ids: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
            rest = [pa.array(c, pa.int64()) for c in columns] + [pa.nulls(len(ids), pa.int64())] * (6 - len(columns))
            return pa.RecordBatch.from_arrays([ids.cast(id_type), *rest], names=names)

        def covered(entries: list[list], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
            n = [len(x) for x in spans]
            flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 2)
            begin = np.repeat(np.array([e[6] for e in entries], dtype=np.int64), n)
            ids = pa.array([e[4] for e, k in zip(entries, n) for _ in range(k)], id_type)
            return table(ids, np.repeat(np.array([e[5] for e in entries], dtype=np.int64), n), flat[:, 0] + begin, flat[:, 1] + begin)

        def flush() -> pa.RecordBatch:
            flags = repeated_in_shard([e[3] for e in shard], np.array([1 + e[2] for e in shard], dtype=np.int64), window)
            single = [(e, _covered(f, window)) for e, f in zip(shard, flags) if not e[2]]
            return covered([e for e, _ in single], [x for _, x in single])

        def settle() -> None:
            nonlocal n_words
            if len(group) > 1 or group and group[0][2]:  # else nothing to be equal to
                shard.extend(group)
                n_words += sum(len(e[3]) for e in group)

        def windows(entries: list[list]) -> pa.RecordBatch:
            sizes = np.array([len(e[3]) for e in entries], dtype=np.int64)
            n = sizes - window + 1
            begin = ranges(np.cumsum(sizes) - sizes, n)
            w1, w2 = span_ids(np.concatenate([e[3] for e in entries]), begin, begin + window)
            place = [None if e[2] else e[6] for e in entries]
            a = pa.array([p for p, k in zip(place, n.tolist()) for _ in range(k)], pa.int64())
            a = pc.add(a, pa.array(begin - np.repeat(np.cumsum(sizes) - sizes, n)))
            ids = pa.array([e[4] for e, k in zip(entries, n.tolist()) for _ in range(k)], id_type)
            hashes = pa.array([e[5] for e, k in zip(entries, n.tolist()) for _ in range(k)], pa.int64())
            counts = np.repeat([1 + e[2] for e in entries], n)
            return pa.RecordBatch.from_arrays([ids, hashes, a, pc.add(a, window), pa.array(w1), pa.array(w2), pa.array(counts, pa.int64())], names=names)

        for batch in batches:
            of, sizes = batch.column(6), np.diff(batch.column(6).offsets.to_numpy())
            plain = [batch.column(j).to_pylist() for j in range(5)]
            length, values, offsets = batch.column(5).to_numpy(), of.values.to_numpy().view(np.uint64), of.offsets.to_numpy()
            ids, hashes, firsts = (batch.column(j) for j in (7, 8, 9))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ids.offsets.to_numpy()))
            flat_ids, flat_hashes, flat_firsts = ids.flatten(), hashes.flatten().to_numpy(), firsts.flatten().to_numpy()
            start = np.searchsorted(owner, np.arange(batch.num_rows)).tolist()
            whole = (sizes == 0)[owner] if len(owner) else np.empty(0, bool)  # which places are covered as a whole
            late: list[list] = []  # entries that turn out to occur again
            for k, (key, is_often, s1, s2, n) in enumerate(zip(*plain)):
                if not sizes[k]:
                    continue
                last = frequent[-1] if is_often and frequent else group[-1] if not is_often and group and key == at else None
                if last is not None and last[0] == s1 and last[1] == s2:
                    if not last[2]:
                        last[2] = True
                        late.append(last)
                    if n == 1:
                        whole[start[k]] = True
                    continue
                entry = [s1, s2, n > 1, values[offsets[k] : offsets[k + 1]].copy(), None, None, None]
                if n == 1:
                    p = start[k]
                    entry[4:] = [flat_ids[p].as_py(), int(flat_hashes[p]), int(flat_firsts[p])]
                if is_often:
                    if len(frequent) >= often:
                        yield windows(frequent)
                        frequent = []
                    frequent.append(entry)
                    continue
                if key != at:
                    settle()
                    group, at = [], key
                    if n_words >= shard_words:
                        yield flush()
                        shard, n_words = [], 0
                group.append(entry)
            if whole.any():
                pick = np.flatnonzero(whole)
                yield table(flat_ids.take(pa.array(pick)), flat_hashes[pick], flat_firsts[pick], flat_firsts[pick] + length[owner[pick]])
            if late:
                yield covered(late, [[(0, len(e[3]))] for e in late])
        settle()
        if frequent:
            yield windows(frequent)
        if shard:
            yield flush()
        give_back()

    dealt = emitted.repartition("key").sortWithinPartitions("key", "s1", "s2")
    found = scratch.keep(dealt.mapInArrow(search, kinds))
    scratch.tidy()
    each = found.where("w1 is not null")
    twice = scratch.keep(each.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"))  # both sides of the join come of an exchange: Spark can split windows that stand everywhere
    by_window = each.where("a is not null").join(twice, ["w1", "w2"]).select("_id", "_hash", "a", "b")
    intervals = found.where("w1 is null").select("_id", "_hash", "a", "b").unionByName(by_window)
    per_doc = intervals.groupBy(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        spans = batch.column(2)
        flat = spans.flatten()
        begin, end = (flat.field(k).to_numpy() for k in (0, 1))
        counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
        past = np.cumsum(counts)
        for k, text in enumerate(text_bytes(batch.column(1))):
            words = text.split()
            n_words.append(len(words))
            if counts[k]:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, begin[past[k] - counts[k] : past[k]], 1)
                np.add.at(change, end[past[k] - counts[k] : past[k]], -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    matched = source.join(per_doc, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    return mapped(matched.select("_id", "_text", "spans"), finish, f"`{id_col}` {kind}, n_words long, n_removed long, kept string", 8 << 20)
