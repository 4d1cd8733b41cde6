"""Near-duplicate groups: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

1. Each text becomes the set of its word k-grams as 64-bit hashes; equal sets collapse to one representative.
2. One hash per shingle fills the bins of a one-permutation sketch; an empty bin takes the value of the first
   full bin in its own fixed random order (optimal densification). Runs of bins are the band keys.
3. In large buckets a representative stays only if shingles that another candidate shares make up enough of its
   set; otherwise nothing can be similar enough to it, which loses no link.
4. Within a bucket candidates are a star around one member. Links are confirmed on full sets and merged into
   components. Buckets that still hold several components get another star; what can then remain between
   components is found exactly, by the rarest shingles of each set, so the star shape loses no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_name, mapped, mix64, text_bytes, word_hashes

BINS = 256


def bands_for(percent: int) -> tuple[int, int]:
    """(rows, bands) within BINS: the most rows with which a pair at the threshold is missed less than once in 10^8."""
    for rows in range(16, 0, -1):
        bands = BINS // rows
        if (1 - (percent / 100) ** rows) ** bands < 1e-8:
            return rows, bands
    return 1, BINS


def shingle_sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the distinct hashes of its runs of k words, A-Z lower-cased, in order; of fewer words the whole run."""
    hashes, sizes = word_hashes(texts, lower=True)
    runs = np.zeros(max(len(hashes) - k + 1, 0), dtype=np.uint64)  # those that reach into the next text aren't used
    for j in range(k):
        runs = mix64(runs ^ hashes[j : j + len(runs)]) + np.uint64(k)
    out, begin = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(runs[begin : begin + n - k + 1]))
        else:
            whole = np.zeros(min(n, 1), dtype=np.uint64)
            for j in range(n):
                whole = mix64(whole ^ hashes[begin + j]) + np.uint64(n)
            out.append(whole)
        begin += n
    return out


_EMPTY = np.iinfo(np.uint64).max


class OnePermutation:
    """Sketches of BINS bins. order[b] is the fixed order in which an empty bin b looks for a full one."""

    def __init__(self, rows: int, bands: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.order = rng.random((BINS, BINS)).argsort(axis=1).argsort(axis=1).astype(np.int16)  # rank of bin j for bin b
        self.rows, self.bands = rows, bands

    def sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of BINS values per set; sets aren't empty."""
        mixed = mix64(np.concatenate(sets) + np.uint64(0x5BD1E995))
        owner = np.repeat(np.arange(len(sets)) * BINS, [len(s) for s in sets])
        out = np.full(len(sets) * BINS, _EMPTY, dtype=np.uint64)
        np.minimum.at(out, owner + (mixed >> np.uint64(56)).astype(np.int64), mixed & np.uint64((1 << 56) - 1))
        out = out.reshape(len(sets), BINS)
        empty = out == _EMPTY
        for k in np.flatnonzero(empty.any(axis=1)).tolist():
            full, lacking = np.flatnonzero(~empty[k]), np.flatnonzero(empty[k])
            out[k, lacking] = out[k, full[self.order[np.ix_(lacking, full)].argmin(axis=1)]]
        return out

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """One key per set and band; the band's number is part of it."""
        rows = self.sketches(sets)[:, : self.rows * self.bands].reshape(len(sets), self.bands, self.rows)
        key = np.tile(np.arange(self.bands, dtype=np.uint64), (len(sets), 1))
        for j in range(self.rows):
            key = mix64(key ^ rows[:, :, j]) + np.uint64(0x9E3779B97F4A7C15)
        return key


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """_id, n (set size), a and b (a 128-bit hash of the set), keys (of the bands)."""
    rows, bands = bands_for(percent)
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["sketch"] = OnePermutation(rows, bands)
        sets = shingle_sets_of(text_bytes(batch.column(1)), shingle)
        live = [s for s in sets if len(s)]
        told = iter(state["sketch"].keys(live) if live else ())
        keys = [next(told) if len(s) else s for s in sets]
        both = [[int(mix64(s ^ seed).sum(dtype=np.uint64).view(np.int64)) for s in sets] for seed in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in both), _longs(keys)], names=["_id", "n", "a", "b", "keys"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return mapped(picked, work, f"_id {picked.schema['_id'].dataType.simpleString()}, n long, a long, b long, keys array<long>", 4 << 20)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """rep, n, s: the full sets of (rep, _text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets_of(text_bytes(batch.column(1)), shingle)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _longs(sets)], names=["rep", "n", "s"])

    return mapped(docs.select("rep", "_text"), work, f"rep {docs.schema['rep'].dataType.simpleString()}, n long, s array<long>", 4 << 20)


def components(links: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) of the linked nodes, comp the smallest node reachable; links: (a, b). Labels spread along links
    and are looked up through each other, so rounds grow with the logarithm of the longest chain."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    if known is not None:
        both = both.union(known.where("node <> comp").select(F.col("node"), F.col("comp"))).union(known.where("node <> comp").select(F.col("comp"), F.col("node")))
    both = scratch.keep(both.distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")).select("node", "comp"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        better = labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        root = labels.select(F.col("node").alias("r"), F.col("comp").alias("rc"))
        hopped = scratch.keep(better.join(root, better.comp == root.r, "left").select("node", F.least("comp", F.coalesce("rc", "comp")).alias("comp"), "old"))
        done = hopped.where("comp <> old").isEmpty()
        scratch.drop(labels)
        labels = hopped
        if done:
            scratch.drop(both)
            return labels.select("node", "comp")


def remaining_pairs(full: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of members (rep, comp) of different components that can reach the similarity.

    A set's shingles are taken from the rarest to the commonest among the members. Two sets that reach it share
    one of the first n - ceil(n * percent / 100) + 1, and from the first one they share enough are left in both
    sets for the intersection that their sizes call for. Members that share a shingle and are of its commonest
    component are not paired with each other, so a large component costs as many rows as it has members.
    """
    told = scratch.keep(full.join(members, "rep").select("rep", "n", "comp", F.explode("s").alias("h")))
    # the smaller side of each of these joins is written first: both come of an exchange then, and Spark can split a
    # shingle, bucket or set that very many rows have
    common = scratch.keep(told.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("c > 1"))
    shared = told.join(common, "h").groupBy("rep", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("c", "h", F.expr("lo <> hi").alias("mixed")))).alias("x"))
    # those of no other member come first; then the shared ones in order
    place = shared.select("rep", "n", "comp", F.size("x").alias("m"), F.posexplode("x").alias("k", "t"))
    place = place.withColumn("left", F.col("m") - F.col("k")).where(f"t.mixed and 100 * left >= {percent} * n")
    place = scratch.keep(place.select(F.col("t.h").alias("h"), "rep", "n", "comp", "left"))
    per_comp = place.groupBy("h", "comp").agg(F.count("*").alias("c"))
    main = scratch.keep(per_comp.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("comps")).where("comps > 1").select("h", F.col("x.comp").alias("c0")))
    open_ = place.join(main, "h")
    few = open_.where("comp <> c0").select("h", F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("comp").alias("c1"), F.col("left").alias("left1"))
    all_ = open_.select("h", F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("comp").alias("c2"), F.col("left").alias("left2"))
    enough = F.expr(f"{100 + percent} * least(left1, left2) >= {percent} * (n1 + n2)")
    both = (few["h"] == all_["h"]) & (F.col("c1") != F.col("c2")) & enough
    return few.join(all_, both).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", large_bucket: int = 12, stars: int = 2) -> DataFrame:
    """Groups of documents linked by Jaccard similarity >= percent / 100 of their sets of `shingle` words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Returns one row per row of docs: id_col,
    n_shingles, component_id (the smallest id reachable over links), kept (id_col = component_id). A null or
    empty text has no shingles and no links; a null id counts as not linked and is kept; rows with the same id
    count as one document that has the sets of all of them. Written steps go to the session's shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    signed = scratch.keep(sketches(docs, shingle, percent, id_col, text_col))
    live = signed.where("_id is not null and n > 0")
    classes = scratch.keep(live.groupBy("n", "a", "b").agg(F.min("_id").alias("rep")))
    member = live.select("_id", "n", "a", "b").join(classes, ["n", "a", "b"]).select("_id", "rep")
    copies = member.where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b")).distinct()

    reps = live.groupBy("n", "a", "b").agg(F.min(F.struct("_id", "keys")).alias("x")).select("n", F.col("x._id").alias("rep"), F.explode("x.keys").alias("key"))
    sizes = scratch.keep(reps.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    in_buckets = scratch.keep(reps.join(sizes, "key").select("key", "rep", "n", "size"))
    wanted = in_buckets.select(F.col("rep").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id")
    full = scratch.keep(shingle_sets(texts.select(F.col("_id").alias("rep"), "_text"), shingle).select("rep", "n", "s"))

    # candidates in large buckets must share enough of their set with other candidates
    crowded = in_buckets.where(F.col("size") > large_bucket).select("rep").distinct()
    told = full.join(crowded, "rep").select("rep", "n", F.explode("s").alias("h"))
    common = scratch.keep(told.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    shared = told.join(common, "h").groupBy("rep", "n").agg(F.count("*").alias("shared"))
    central = scratch.keep(shared.where(f"100 * shared >= {percent} * n").select("rep", (F.col("shared") / F.col("n")).alias("share")))
    small = in_buckets.where(F.col("size") <= large_bucket).select("key", "rep", "n", F.lit(1.0).alias("share"))
    large = in_buckets.where(F.col("size") > large_bucket).join(central, "rep").select("key", "rep", "n", "share")
    bucket = scratch.keep(small.unionByName(large))
    scratch.tidy()

    fits = F.expr(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = full.select(F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("s").alias("s1"))
        b = full.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        both = F.size(F.array_intersect("s1", "s2"))
        return pairs.select("a", "b").join(a, "a").join(b, "b").where(100 * both >= percent * (F.col("n1") + F.col("n2") - both)).select("a", "b")

    def now_labelled(of: DataFrame) -> DataFrame:
        if labels is None:
            return of.withColumn("comp", F.col("rep"))
        return of.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    links, tried, labels = None, None, None
    for turn in range(stars + 1):
        now = now_labelled(bucket)
        spread = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("hi")).where("c0 <> hi").select("key", "c0")
        now = scratch.keep(now.join(spread, "key").select("key", "rep", "n", "share", "comp", "c0"))
        if turn < stars:
            # first the member that shares most; then that of the members not linked to the smallest component
            rank = F.struct((-F.col("share")).alias("r"), F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("comp").alias("c1"))
            centre = (now.where("comp <> c0") if turn else now).groupBy("key").agg(F.min(rank).alias("x"))
            centre = scratch.keep(centre)
            pairs = now.join(centre, "key").selectExpr("x.a as a", "x.n1 as n1", "x.c1 as c1", "rep as b", "n as n2", "comp as c2").where("c1 <> c2").where(fits)
        else:
            pairs = remaining_pairs(full, now_labelled(now.select("rep").distinct()), percent, scratch)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        scratch.drop(now)
        scratch.tidy()
        if pairs.isEmpty():
            continue
        found = scratch.keep(confirmed(pairs))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = scratch.keep(components(links, scratch))

    # labels name the smallest representative, which is the smallest id of its component
    grouped = member.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left") if labels is not None else member.withColumn("comp", F.lit(None).cast(member.schema["rep"].dataType))
    by_id = grouped.select("_id", F.coalesce("comp", "rep").alias("component_id"))
    if signed.groupBy("_id").count().where("_id is not null and count > 1").isEmpty():
        settled = by_id
    else:  # an id that several rows have joins the groups of all its rows
        settled = components(by_id.select(F.col("_id").alias("a"), F.col("component_id").alias("b")), scratch).select(F.col("node").alias("_id"), F.col("comp").alias("component_id"))
    out = signed.select("_id", "n").join(settled, "_id", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))
    scratch.drop(in_buckets, full, bucket, central)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest id; columns stay as they are. Rows
    with a null id stay; of several rows with the same id one stays (the one with the smallest text hash)."""
    scratch = Scratch(docs.sparkSession, "dropped")
    dropped, rank_in_id = fresh_name(docs, "_dropped"), fresh_name(docs, "_rank_in_id")
    found = scratch.keep(near_duplicates(docs, shingle, percent, id_col, text_col).select(F.col(id_col).alias(dropped), "kept"))
    gone = found.where("not kept").select(dropped).distinct()
    out = docs.join(gone, F.col(id_col) == F.col(dropped), "left_anti")
    if found.where(F.col(dropped).isNotNull()).groupBy(dropped).count().where("count > 1").isEmpty():
        return out
    rank = Window.partitionBy(F.col(id_col)).orderBy(F.sha2(F.col(text_col), 256))
    ranked = out.where(F.col(id_col).isNotNull()).withColumn(rank_in_id, F.row_number().over(rank)).where(F.col(rank_in_id) == 1).drop(rank_in_id)
    return ranked.unionByName(out.where(F.col(id_col).isNull()))
