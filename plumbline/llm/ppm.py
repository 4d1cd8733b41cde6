"""Language-model scores by partial matching (PPM) over byte contexts, pretrained on the whole training corpus.

The trie of byte contexts is a table of (context of ORDER bytes, next byte, count); counts of shorter contexts
are sums over it. A byte's probability is looked for in its longest context; from a context that hasn't seen the
byte the model escapes to the next shorter one, where the bytes that the longer one had seen are excluded. By escape
method D a byte that was seen c of t times has (2c - 1) / 2t, and the escape, with d different bytes seen, d / 2t.

No task holds the model. Documents are cut into chunks of bounded size; each chunk asks for its distinct contexts
(and words, for the unigram base) in sorted blocks, one per bucket of keys. Counts are summed bucket by bucket,
probabilities are worked out by shards that share the last three context bytes, with the counts of all shorter runs
(2 ** 24 at most, whatever the corpus) at hand, and the answers go back bucket by bucket, in the order in which the
chunks asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, ship, slices, text_bytes, word_hashes

ORDER = 5
#: Bytes that no UTF-8 text has: before a text, and after it.
START, END = b"\xfe" * ORDER, b"\xff"
END_TOKEN = -(1 << 63)


STEP = 1 << 19


def _look(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at], a step at a time: numpy widens whole index arrays to 64 bits."""
    out = np.empty(len(at), dtype=table.dtype)
    for a in range(0, len(at), STEP):
        out[a : a + STEP] = table[at[a : a + STEP]]
    return out


def _seen(size: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(size, dtype=bool)
    for a in range(0, len(at), STEP):
        out[at[a : a + STEP]] = True
    return out


def _counts(size: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for a in range(0, len(at), STEP):
        out += np.bincount(at[a : a + STEP], minlength=size)
    return out


class Ranks:
    """Dense numbers for the marked ones of many cells, in order; a bit a cell, and a count before every 64th."""

    def __init__(self, mark: np.ndarray):
        self.bits = np.packbits(np.pad(mark, (0, -len(mark) % 64 + 64)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits))[:-1]]).astype(np.int32)

    def of(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), dtype=np.int32)
        for a in range(0, len(at), STEP):
            part = at[a : a + STEP]
            word = part >> 6
            below = (np.uint64(1) << (part & 63).astype(np.uint64)) - np.uint64(1)
            out[a : a + STEP] = self.before[word] + np.bitwise_count(self.bits[word] & below)
        return out


class Coder:
    """Dense numbers for the runs of ORDER + 1 bytes of one chunk, without sorting its positions: pairs of bytes
    are numbered, then pairs of pairs, then runs. Sorted keys stand in where those tables would grow large."""

    most = 1 << 24

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: the texts with START and END, one after the other; ends: which positions begin no run."""
        begins = ~ends[: len(data) - ORDER]
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        kinds = _seen(1 << 16, pair)
        n_pairs = int(kinds.sum())
        self.dense = n_pairs**2 <= self.most
        if self.dense:
            of = _look((np.cumsum(kinds) - 1).astype(np.int32), pair)
            del pair
            quad = (of[: len(begins)] * np.int32(n_pairs) + of[2 : 2 + len(begins)])[begins]  # the first four bytes of each run
            del of
            seen = _seen(n_pairs**2, quad)
        if not self.dense:
            self.key, self.at = np.unique(self._keys(data)[begins], return_inverse=True)
            return
        self.at = Ranks(seen).of(quad)
        del quad
        pairs, quads = np.flatnonzero(kinds), np.flatnonzero(seen)
        self.key = pairs[quads // n_pairs].astype(np.int64) << 16 | pairs[quads % n_pairs]
        for k in range(4, ORDER + 1):  # a byte more at a time
            self.dense = len(self.key) * 256 <= 4 * self.most
            if not self.dense:
                self.key, self.at = np.unique(self._keys(data)[begins], return_inverse=True)
                return
            self.at *= 256
            self.at += data[k : len(data) - ORDER + k][begins]
            mark = _seen(len(self.key) * 256, self.at)
            used = np.flatnonzero(mark)
            self.at = Ranks(mark).of(self.at)
            self.key = self.key[used >> 8] << 8 | used & 255

    @staticmethod
    def _keys(data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) - ORDER, dtype=np.int64)
        for k in range(ORDER + 1):
            out = out << 8 | data[k : len(data) - ORDER + k]
        return out


def runs_of(texts: list[bytes]) -> tuple[Coder, np.ndarray]:
    """The coded runs of a chunk, one per byte and one per end, text after text; and the number in each text."""
    data = np.frombuffer(b"".join([START + t + END for t in texts]), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    none = np.zeros(len(data), dtype=bool)  # positions whose run would reach into the next text
    for k in range(ORDER):
        none[starts + sizes + k] = True
    return Coder(data, none), sizes


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words (negative numbers, from 63 bits of their hash), text after text, and the number in each."""
    hashes, sizes = word_hashes(texts, lower=True)
    return -(hashes >> np.uint64(1)).astype(np.int64) - 1, sizes


def in_planes(values: np.ndarray) -> bytes:
    """Numbers of 64 bits, all their lowest bytes first: bytes that are alike compress well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return in_planes(np.diff(keys, prepend=0))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.int64))


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)).astype(np.int64) % n


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    kinds, of = np.unique(np.concatenate(keys), return_inverse=True)
    return kinds, np.bincount(of, weights=np.concatenate(counts), minlength=len(kinds)).astype(np.int64)


class Short:
    """Counts of runs of up to three bytes, from those of three: (run, count), each run once and in order."""

    def __init__(self, run: np.ndarray, count: np.ndarray):
        self.run, self.count = run, count.astype(np.float64)
        pair = np.bincount(run & 0xFFFF, weights=self.count, minlength=1 << 16)
        self.one = pair.reshape(256, 256)
        self.zero = self.one.sum(axis=0)
        sums = lambda w: np.bincount(run >> 8, weights=w, minlength=1 << 16)
        # per context of two bytes: its count, its different bytes, and how often these follow the second alone
        self.total, self.distinct, self.mass = sums(self.count), sums(self.count > 0), sums(np.where(self.count > 0, pair[run & 0xFFFF], 0))

    def of(self, run: np.ndarray) -> np.ndarray:
        if not len(self.run):
            return np.zeros(len(run))
        at = np.minimum(np.searchsorted(self.run, run), len(self.run) - 1)
        return np.where(self.run[at] == run, self.count[at], 0)


def log_probabilities(key: np.ndarray, n: np.ndarray, short: Short) -> np.ndarray:
    """log10 of the probability of each run's last byte after its context.

    key, n: all runs of some shards (contexts that end in the same three bytes), with their counts, 0 for those only
    asked for."""
    one, zero = short.one, short.zero
    seen_zero = zero > 0
    out, open_ = np.zeros(len(key)), np.ones(len(key), dtype=bool)
    longer_distinct, longer_mass = np.zeros(len(key)), np.zeros(len(key))  # of the level above: what is excluded here

    def level(count: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> None:
        nonlocal open_
        t, d = total - longer_mass, distinct - longer_distinct
        live = open_ & (t > 0)
        found = live & (count > 0)
        out[found] += np.log10((2 * count[found] - 1) / (2 * t[found]))
        escaped = live & ~found
        out[escaped] += np.log10(d[escaped] / (2 * t[escaped]))
        open_ = open_ & ~found

    counts = {}
    for k in range(ORDER, 2, -1):
        run, of = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        counts[k] = (run, of, np.bincount(of, weights=n, minlength=len(run)))
    for k in range(ORDER, 2, -1):
        run, of, count = counts[k]
        context, in_context = np.unique(run >> 8, return_inverse=True)
        total, distinct = np.bincount(in_context, weights=count), np.bincount(in_context, weights=count > 0)
        level(count[of], total[in_context][of], distinct[in_context][of])
        if k > 3:
            below_run, _, below_count = counts[k - 1]
            below = below_count[np.searchsorted(below_run, run & ((1 << 8 * k) - 1))]
        else:
            below = short.of(run & 0xFFFFFF)
        mass = np.bincount(in_context, weights=np.where(count > 0, below, 0))
        longer_distinct, longer_mass = distinct[in_context][of], mass[in_context][of]
    two, last, symbol = key >> 8 & 0xFFFF, key >> 8 & 255, key & 255
    level(short.of(key & 0xFFFFFF), short.total[two], short.distinct[two])
    longer_distinct, longer_mass = short.distinct[two], short.mass[two]
    level(one[last, symbol], one.sum(axis=1)[last], (one > 0).sum(axis=1)[last])
    longer_distinct, longer_mass = (one > 0).sum(axis=1)[last], ((one > 0) * zero).sum(axis=1)[last]
    level(zero[symbol], np.full(len(key), zero.sum()), np.full(len(key), seen_zero.sum()))
    out[open_] -= np.log10(max(1, 256 - int(seen_zero.sum())))
    return out


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, most_buckets: int = 4096, shard_keys: int = 1 << 20) -> DataFrame:
    """Per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    train: a condition on id_col; the rows for which it holds are learned from. score is the model's log10
    probability of the text's bytes and its end; base_score that of its words (runs of anything but ASCII white
    space, A-Z lower-cased) and its end under add-half unigrams of the training rows. Words are told apart by 63
    bits of their hash. A null text is empty: only its end is scored. Without training rows all bytes are equally
    likely. Repeated and null ids stay, one row each. Steps are written to the session's shared folder. A task holds
    a chunk, a bucket's different keys, or shards of shard_keys runs (one shard, if that has more).
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ppm")
    kind = docs.select(id_col).schema[id_col].dataType.simpleString()

    def pack(batches):
        """Chunks of about chunk_bytes, and of one text at least; batches may be smaller."""
        at, parts, held = TaskContext.get().partitionId() << 24, [], 0

        def chunk():
            columns = [pa.chunked_array([p.column(k) for p in parts]).combine_chunks() for k in range(3)]
            columns[2] = pa.array(text_bytes(columns[2]), pa.binary())
            offsets = pa.array([0, len(columns[0])], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], names=["chunk", "ids", "train", "texts"])

        for batch in batches:
            for part in slices(batch, chunk_bytes // 2):
                parts.append(part)
                held += part.nbytes
                if held >= chunk_bytes:
                    yield chunk()
                    at, parts, held = at + 1, [], 0
        if parts:
            yield chunk()
        give_back()

    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(text_col).alias("_text"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n_buckets = min(n_parts, most_buckets)  # rows of blocks are chunks times buckets
    # chunks are used only as they were written: a second reading of docs might cut them elsewhere
    packed = picked.mapInArrow(pack, f"chunk long, ids array<{kind}>, train array<boolean>, texts array<binary>")
    chunks = scratch.keep_bucketed(packed, "chunk", n_parts)

    def blocks(chunk: int | None, keys: np.ndarray, other: np.ndarray) -> list[pa.Array]:
        """A row per bucket: its number, the chunk, and its part of the keys and of the other numbers, packed, in the
        order of the keys."""
        bucket = buckets_of(keys, n_buckets)
        order = np.argsort(bucket, kind="stable")
        kinds, first = np.unique(bucket[order], return_index=True)
        parts = [[pack(x) for x in np.split(of[order], first[1:])] for pack, of in ((pack_keys, keys), (in_planes, other))]
        return [pa.array(kinds, pa.int32()), pa.array([chunk] * len(kinds), pa.int64()), *(pa.array(x, pa.binary()) for x in parts)]

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                learn = np.array(batch.column(1)[k].as_py(), dtype=bool)
                texts = batch.column(2)[k].as_py()
                runs, sizes = runs_of(texts)
                counts = _counts(len(runs.key), runs.at[np.repeat(learn, sizes)])
                words, in_text = word_keys(texts)
                word, of = np.unique(words, return_inverse=True)
                word_counts = np.bincount(of[np.repeat(learn, in_text)], minlength=len(word))
                key = np.concatenate([runs.key, word, np.array([END_TOKEN])])
                n = np.concatenate([counts, word_counts, np.array([learn.sum()])]).astype(np.int64)
                del runs, texts
                yield pa.RecordBatch.from_arrays(blocks(batch.column(0)[k].as_py(), key, n), names=["bucket", "chunk", "keys", "n"])
        give_back()

    def total(batches):
        """Sums each bucket's counts by key; the rows of a bucket come together."""
        keys, counts, held, at = [], [], 0, None

        def out():
            kinds, n = summed(keys, counts)
            for a in range(0, len(kinds), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(kinds[a : a + (1 << 17)]), pa.array(n[a : a + (1 << 17)])], names=["key", "n"])

        for batch in batches:
            for k, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != at and keys:
                    yield from out()
                    keys, counts, held = [], [], 0
                at = bucket
                keys.append(unpack_keys(batch.column(1)[k].as_py()))
                counts.append(from_planes(batch.column(2)[k].as_py(), np.int64))
                held += len(keys[-1])
                if held > 1 << 22 and held > 2 * len(keys[0]):
                    (keys[:], counts[:]) = ([x] for x in summed(keys, counts))
                    held = len(keys[0])
        if keys:
            yield from out()
        give_back()

    # asked twice of the same chunks, which costs less than what was asked would take on disk
    asked = chunks.select("chunk", "train", "texts").mapInArrow(ask, "bucket int, chunk long, keys binary, n binary")
    totals = scratch.keep(asked.select("bucket", "keys", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "key long, n long"))
    scratch.tidy()
    base = totals.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)).alias("v")).first()
    runs = totals.where("key >= 0")
    shortest = runs.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("run")).agg(F.sum("n").alias("n")).toArrow().sort_by("run")  # 2 ** 24 rows at most
    held = spark.sparkContext.broadcast(Short(shortest.column("run").to_numpy(), shortest.column("n").to_numpy()))
    value_kind = "bucket int, chunk long, keys binary, value binary"

    def answer(batches):
        """Probabilities of the runs, which come sorted by shard; whole shards are worked out together."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def out(some):
            key, n = (np.concatenate(x) for x in zip(*some))
            value = log_probabilities(key, n.astype(np.float64), held.value)
            for a in range(0, len(key), 1 << 20):
                yield pa.RecordBatch.from_arrays(blocks(None, key[a : a + (1 << 20)], value[a : a + (1 << 20)]), names=["bucket", "chunk", "keys", "value"])

        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if n_held >= shard_keys:  # up to the last shard that is sure to be whole
                shard = key >> 8 & 0xFFFFFF
                last = parts[-1][0][-1] >> 8 & 0xFFFFFF
                cut = len(key) if (shard == last).all() else int(np.argmax(shard != last))
                if cut < len(key):
                    yield from out([*parts, (key[:cut], n[:cut])])
                    parts, n_held, key, n = [], 0, key[cut:], n[cut:]
            parts.append((key.copy(), n.copy()))
            n_held += len(key)
        if n_held:
            yield from out(parts)
        give_back()

    def word_values(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(blocks(None, batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float64)), names=["bucket", "chunk", "keys", "value"])
        give_back()

    def reply(batches):
        """Per bucket, first the values of its keys, then the chunks' blocks: each gets its values."""
        keys, values, at, known = [], [], None, None
        for batch in batches:
            for k, (bucket, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if bucket != at:
                    keys, values, at, known = [], [], bucket, None
                wanted = unpack_keys(batch.column(2)[k].as_py())
                if chunk is None:
                    keys.append(wanted)
                    values.append(from_planes(batch.column(3)[k].as_py(), np.float64))
                    continue
                if known is None:
                    order = np.argsort(flat := np.concatenate(keys))
                    known, value = flat[order], np.concatenate(values)[order]
                    keys, values = [], []
                found = in_planes(value[np.searchsorted(known, wanted)])
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([found], pa.binary())], names=["chunk", "bucket", "value"])
        give_back()

    shard = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFFFF)
    values = runs.repartition(shard).sortWithinPartitions(shard).mapInArrow(answer, value_kind).unionByName(totals.where("key < 0").mapInArrow(word_values, value_kind))
    both = values.unionByName(asked.select("bucket", "chunk", "keys", F.lit(None).cast("binary").alias("value")))
    answers = both.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first()).mapInArrow(reply, "chunk long, bucket int, value binary")
    per_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "value")).alias("told"))
    denominator = float(np.log10(base.n + 0.5 * (base.v + 1)))
    train_tokens = int(base.n)

    def score(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                texts = batch.column(1)[k].as_py()
                coded, sizes = runs_of(texts)
                words, in_text = word_keys(texts)
                word, of = np.unique(words, return_inverse=True)
                key = np.concatenate([coded.key, word, np.array([END_TOKEN])])
                told = batch.column(2)[k].values
                parts, order = told.field(1), np.argsort(buckets_of(key, n_buckets), kind="stable")
                value = np.empty(len(key))
                value[order] = np.concatenate([from_planes(parts[j].as_py(), np.float64) for j in np.argsort(told.field(0).to_numpy()).tolist()])
                past = np.cumsum(sizes)
                logs, a = np.empty(len(texts)), 0
                while a < len(texts):  # some texts at a time
                    b = max(a + 1, int(np.searchsorted(past, (past[a - 1] if a else 0) + STEP, side="right")))
                    begin = past[a] - sizes[a]
                    logs[a:b] = np.add.reduceat(value[coded.at[begin : past[b - 1]]], past[a:b] - sizes[a:b] - begin)
                    a = b
                owner = np.repeat(np.arange(len(texts)), in_text)
                count, end = value[len(coded.key) + of], value[-1]
                tokens = in_text + 1
                known = np.bincount(owner, weights=count > 0, minlength=len(texts)) + (end > 0)
                base_log = np.bincount(owner, weights=np.log10(count + 0.5), minlength=len(texts)) + np.log10(end + 0.5) - tokens * denominator
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(np.full(len(texts), train_tokens)), pa.array(base_log), pa.array(logs)],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
        give_back()

    ready = chunks.select("chunk", "ids", "texts").join(per_chunk, "chunk")
    return ready.select("ids", "texts", "told").mapInArrow(score, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
