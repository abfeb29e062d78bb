"""Near-duplicate groups by SimHash and a Gray-order hierarchical index (operator 7).

Only distinct fingerprints enter the index. Each goes to three trees, one for each third of its bits; two
fingerprints within two bits agree in one third at least, which is the pattern of one upper node of that tree
(a bucket). In a bucket the fingerprints are sorted by Gray rank, so neighbours share most bits; runs of 16
become nodes that keep the bits all their members share (mask and pattern), runs of 16 nodes become nodes
above, and so on. The join walks pairs of nodes from the top: the differences within both masks can only grow
on the way down, and a pair beyond two is dropped with everything below it.

A bucket with too many members is dealt again by thirds of its remaining bits, which is as exact, down to
buckets that the number of remaining bits bounds. Links of a bucket are reduced to one row a fingerprint before
they leave the task; components are found by star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, fresh, lean, materialize
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Members of a bucket that one task joins; a larger bucket is dealt again.
MAX_BUCKET = 8192
FAN_OUT = 16
#: Pairs of nodes looked at together.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
    counts = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[s : s + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """row_id, doc_id, fp (the fingerprint's bits as a long) of each row."""
    rows = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row_id"), column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(fps.view(np.int64))], names=["row_id", "doc_id", "fp"])

    return rows.mapInArrow(lean(apply), rows.select("row_id", "doc_id", F.lit(0).cast("long").alias("fp")).schema)


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the reflected Gray sequence (as the bits of a long)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def thirds(mask: int, distance: int = DISTANCE) -> list[int]:
    """The bits of mask in distance + 1 parts of nearly the same size."""
    bits = [b for b in range(63, -1, -1) if mask >> b & 1]
    n, k = len(bits), distance + 1
    return [sum(1 << b for b in bits[n * i // k : n * (i + 1) // k]) for i in range(k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree_links(x: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of Gray-ordered distinct fingerprints within the distance, by a walk over pairs of nodes."""
    levels = [(x, np.full(len(x), ~np.uint64(0)))]  # pattern and mask of each node, leaves first
    while len(levels[-1][0]) > FAN_OUT:
        p, m = levels[-1]
        at = np.arange(0, len(p), FAN_OUT)
        both, some = np.bitwise_and.reduceat(p, at), np.bitwise_or.reduceat(p, at)
        shared = np.bitwise_and.reduceat(m, at) & ~(both ^ some)
        levels.append((both & shared, shared))
    n = len(levels[-1][0])
    i, j = np.triu_indices(n)
    work, out = [(len(levels) - 1, i, j)], []
    while work:
        level, i, j = work.pop()
        p, m = levels[level]
        near = np.bitwise_count((p[i] ^ p[j]) & m[i] & m[j]) <= distance
        i, j = i[near], j[near]
        if level == 0:
            out.append((i[i < j], j[i < j]))
            continue
        size = len(levels[level - 1][0])
        step = max(1, FRONTIER // FAN_OUT**2)
        a, b = (g.ravel() for g in np.meshgrid(np.arange(FAN_OUT), np.arange(FAN_OUT), indexing="ij"))
        for s in range(0, len(i), step):
            ci = (i[s : s + step, None] * FAN_OUT + a).ravel()
            cj = (j[s : s + step, None] * FAN_OUT + b).ravel()
            ok = (ci < size) & (cj < size) & (ci <= cj)
            work.append((level - 1, ci[ok], cj[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least element of each element's component under the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        root = new
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by path, value and Gray rank: links (a, b) that join each bucket's near fingerprints."""

    def links(path: np.ndarray, value: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (value[1:] != value[:-1])])
        bucket = np.cumsum(new) - 1
        starts = np.append(np.flatnonzero(new), len(x))
        sizes = np.diff(starts)
        left, right = [], []
        own = np.where(sizes[bucket] <= FAN_OUT, sizes[bucket], 0)
        for s in range(1, FAN_OUT):  # buckets of one node: its members against each other
            i = np.flatnonzero(own > s)
            i = i[i + s < len(x)]
            i = i[bucket[i] == bucket[i + s]]
            i = i[np.bitwise_count(x[i] ^ x[i + s]) <= DISTANCE]
            left.append(i)
            right.append(i + s)
        for b in np.flatnonzero(sizes > FAN_OUT):
            i, j = tree_links(x[starts[b] : starts[b + 1]])
            r = roots(int(sizes[b]), i, j)
            k = np.flatnonzero(r != np.arange(len(r)))
            left.append(r[k] + starts[b])
            right.append(k + starts[b])
        r = roots(len(x), np.concatenate(left), np.concatenate(right))
        k = np.flatnonzero(r != np.arange(len(r)))
        return pa.RecordBatch.from_pydict({"a": pa.array(x[k].view(np.int64)), "b": pa.array(x[r[k]].view(np.int64))})

    rest: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column("path").to_numpy(), b.column("value").to_numpy(), b.column("fp").to_numpy().view(np.uint64)]
        if rest is not None:
            now = [np.concatenate(c) for c in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = len(same) - int(same.sum())  # the last bucket may go on in the next batch
        if cut:
            yield links(*(c[:cut] for c in now))
        rest = [c[cut:] for c in now]
    if rest is not None:
        yield links(*rest)


def near_links(points: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """points: written table of distinct fp. Links (a, b) whose components are those of all pairs within two bits."""
    open_ = {(): (0, (1 << 64) - 1)}  # path of parts taken: the bits fixed by it, the bits that remain
    rows, found = points.select("fp"), None
    paths, level = {(): 0}, 0
    rows = rows.withColumn("path", F.lit(0))
    while True:
        options, next_open = [], {}
        for path, (fixed, free) in open_.items():
            for k, part in enumerate(thirds(free)):
                child = (*path, k)
                paths[child] = len(paths)
                next_open[child] = (fixed | part, free & ~part)
                options.append((paths[path], paths[child], fixed | part))
        dealt = None
        by_path: dict[int, list] = {}
        for parent, child, fixed in options:
            by_path.setdefault(parent, []).append(F.struct(F.lit(child).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(fixed))).alias("value")))
        for parent, structs in by_path.items():
            one = rows.where(F.col("path") == parent).select("fp", F.explode(F.array(*structs)).alias("s")).select("fp", "s.path", "s.value")
            dealt = one if dealt is None else dealt.unionByName(one)
        level += 1
        bits = max(bin(free).count("1") for _, free in next_open.values())
        if 1 << bits <= max_bucket:
            big = None
        else:
            big = materialize(dealt.groupBy("path", "value").count().where(F.col("count") > max_bucket).select("path", "value"), "big-buckets")
            if big.isEmpty():
                big = None
        here = dealt if big is None else dealt.join(big, ["path", "value"], "left_anti")
        ordered = here.repartition("path", "value").sortWithinPartitions("path", "value", gray_rank(F.col("fp")))
        links = ordered.select("path", "value", "fp").mapInArrow(lean(bucket_links), "a long, b long")
        found = links if found is None else found.union(links)
        if big is None:
            return found
        rows = materialize(dealt.join(big, ["path", "value"], "left_semi").select("fp", "path").distinct(), "dealt-again")
        open_ = next_open


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: row_id, doc_id, fingerprint (16 hex digits), component_id, kept.

    Texts link at 2 or fewer differing bits; component_id is the smallest doc_id that links reach (null if every
    doc_id of the group is null). Texts without words have fingerprint zero and link like any other. kept: the row
    with the smallest doc_id of its group (null last), the first read among repeated rows; exactly one of a group.
    An empty table gives an empty result; other columns are not read. row_col: a column that identifies rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, column(row_col) if row_col else None), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")
    points = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "points")
    linked = components(materialize(near_links(points), "near"))
    rooted = points.join(linked.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = materialize(rooted.join(heads, "root").select("fp", "head"), "named")
    out = rows.join(named, "fp")
    return out.select(
        "row_id", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head.doc_id").alias("component_id"), (F.col("row_id") == F.col("head.row_id")).alias("kept")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each near-duplicate group, with all their columns."""
    row = fresh(docs, "row_id")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    gone = materialize(near_groups(keyed, id_col, text_col, row).where("not kept").select(F.col("row_id").alias(row)), "gone")
    return keyed.join(gone, row, "left_anti").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", "fingerprint", "component_id")
