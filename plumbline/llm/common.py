"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker, where the session sets none: 10,000 long texts at once would not fit.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once per Spark context, so that they need not have it installed, and
    bounds the bytes of a batch of rows in this session, unless it has a bound of its own."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="plumbline-ship-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._plumbline_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store that Spark reads will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or, only where
    that is unset (local tests), a new temporary folder which is then set as the checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what all queries have written to the shared folder; their results can't be read after that, unless
    they have been written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/plumbline")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder while one query is planned; they cut lineage, and a lost
    executor costs only a re-read. drop() removes those that no later step reads."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_scratch_path"] = path
        return out

    def keep_bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """Like keep, dealt into buckets by a column: a later join on it by as many partitions needs no shuffle. Rows
        aren't shuffled for it, so it suits tables of which each task writes few different values."""
        path, name = f"{self.root}/{self.n}", f"plumbline_{uuid.uuid4().hex}"
        self.n += 1
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name, format="parquet")
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the plan knows the files by now; those stay, as the folder was given
        return out

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of finished steps: its cleaner looks for plans that nothing refers to."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df.__dict__["_scratch_path"])


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def id_bucket_py(value: object, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def by_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], most_bytes: int = 16 << 20) -> Callable:
    """For mapInArrow: work on slices of batches whose data take at most about most_bytes (one row at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return run


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: object, most_bytes: int = 16 << 20) -> DataFrame:
    """df with work done on slices of its batches; this package goes along."""
    ship(df.sparkSession)
    return df.mapInArrow(by_batch(work, most_bytes), schema)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and those of later stages stand beside them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    each = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            each += np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
        else:
            each += 8
    at = np.cumsum(each) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def filter_rows(docs: DataFrame, text_col: str, stays: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of docs whose text stays; all columns as they are, whatever their names and types."""
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(stays(batch.column(at)), pa.bool_()))

    return mapped(docs, work, docs.schema, 8 << 20)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that aren't ASCII white space begin and end."""
    space = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    return edge[::2], edge[1::2]


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time; very long words one by one."""
    import xxhash

    size = ends - starts
    whole = np.zeros(len(data) // 8 + 2, dtype=np.uint64)
    whole.view(np.uint8)[: len(data)] = data

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        place, bits = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return (whole[place] >> bits | whole[place + 1] << np.uint64(1) << (np.uint64(63) - bits)) & _KEEP[np.minimum(left, 8)]

    out = mix64(eight(starts, size) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    done, more = 8, np.flatnonzero(size > 8)
    while len(more) and done < 64:
        out[more] = mix64(out[more] ^ eight(starts[more] + done, size[more] - done)) + np.uint64(done)
        done += 8
        more = more[size[more] > done]
    for k in more.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but ASCII white space) of all texts, one after the other, and the number
    of each text's. lower: with A-Z as small letters."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if lower:
        data = np.where(data - np.uint8(65) < 26, data | 32, data)
    starts, ends = split_words(data)
    past = np.cumsum([len(t) + 1 for t in texts])
    return hash_words(data, starts, ends), np.diff(np.searchsorted(starts, past), prepend=0)


class WordHashes(dict):
    """64-bit hash of each word, remembered; emptied at a bound, so memory doesn't follow the vocabulary."""

    most = 1 << 19

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label 0/1) of at most `most` labelled documents of each class, the same on every run: those of the
    smallest hash of their id. Only labels with an id and a value count; of several for one id the largest.
    train: a condition on id_col that says which ids may be learned from."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    if train is not None:
        ids = labels.where(train).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    ids = ids.groupBy("_id").agg(F.max("_y").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = ids.where("_y = 0").orderBy(*order).limit(most).unionByName(ids.where("_y = 1").orderBy(*order).limit(most))
    one = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # 2 * most rows at most
    return one.groupBy("_id").agg(F.min(F.coalesce("_text", F.lit(""))).alias("text"), F.max("_y").alias("label")).orderBy("_id").select("text", "label")
