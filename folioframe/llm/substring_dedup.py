"""Substring deduplication by seed and extend (operator 9).

Seeds: of the 16-word grams in each window of 35 words, the one with the smallest hash is an anchor (winnowing),
so equal windows have equal anchors at equal places. Anchors that stand once in the corpus lead nowhere. From
each place of the others the match is extended both ways, to the windows that have it as their anchor; a window
found once among them is no repeat, any other one is. Hash equality of a window is of 96 bits. Windows are
counted with a combine on the map side, so a passage in a third of all documents is a few rows for each task,
and no pairs are formed. Neighbouring repeated windows merge to maximal repeats, whose words are removed.

That this finds what extending each pair of matches word by word finds: an extension from a shared anchor reaches every
window of words in which both places agree, one step of a word at a time; such a window has its least gram at the same offset
in both places, so it is among those tried around some shared anchor, and equal ones meet in one group, whichever
the pair. A window tried that is alone in its group differs from every other place within its 35 words, where each pair's
extension stops short of it. What remains is the union of all pairs' extensions over the length threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, column, discard, lean, materialize, release
from .language_id import mix64
from .tokens import blocks

WINDOW, GRAM = 35, 16
#: Odd multipliers of the two rolling hashes.
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each word of the texts in turn (2 x words), and where each text's words start (texts + 1)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    coded = words.filter(full).dictionary_encode()
    raw = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist())
    table = np.frombuffer(raw, np.uint64).reshape(-1, 2).T
    return table[:, coded.indices.to_numpy(zero_copy_only=False)], upto[offsets - offsets[0]]


def rolling(h: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """For each place the hash of the n words from there on (to the end of h)."""
    with np.errstate(over="ignore"):
        count = max(0, len(h) - n + 1)
        powers = lambda m: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(h), m, np.uint64)]))
        up, down = powers(multiplier), powers(pow(multiplier, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
        return mix64((sums[n : n + count] - sums[:count]) * down[:count])


def slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n], for every i with n elements left; by doubling."""
    if len(x) < n:
        return x[:0]
    size, out = 1, x
    while 2 * size <= n:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


class Grams:
    """Gram hashes, least gram of each window and anchors of a block of texts; places count words of the block."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.h, self.starts = word_hashes(texts)
        n = self.h.shape[1]
        left = np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(n)  # words from here to the text's end
        self.grams = np.full(n, FREE)
        rolled = rolling(self.h[0], gram, ROLL[0])
        self.grams[: len(rolled)] = rolled
        self.grams[left < gram] = FREE
        least = slide(self.grams, self.span, np.minimum)
        self.least = np.concatenate([least, np.zeros(n - len(least), np.uint64)])
        self.valid = left >= window  # a window starts here
        self.least[~self.valid] = 0

    def anchors(self) -> np.ndarray:
        """Places of grams that are the least of a window."""
        padded = np.concatenate([np.zeros(self.span - 1, np.uint64), self.least])
        return np.flatnonzero((slide(padded, self.span, np.maximum) == self.grams) & (self.grams != FREE)) if len(self.grams) else np.zeros(0, np.int64)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Places of the windows that have their least gram at one of the places."""
        near = (at[:, None] - np.arange(self.span)[None, :]).astype(np.int64)
        own = (near >= 0) & (self.least[np.maximum(near, 0)] == self.grams[at][:, None])
        found = np.unique(near[own])
        return found[self.valid[found]]

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(rolling(h, self.window, r)[at] for h, r in zip(self.h, ROLL, strict=True)) if len(at) else (np.zeros(0, np.uint64),) * 2

    def places(self, lists: pa.Array) -> np.ndarray:
        """Block places of per-text lists of places (null: none)."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat + np.repeat(self.starts[:-1], sizes)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for b in blocks(batch.column("text")):
            yield batch.slice(done, len(b))
            done += len(b)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(keyed, marks): keyed is a written table row_id, doc_id, text of docs, in buckets of row_id; marks has, for each row with a repeated
    anchor, row_id, anchors (places of repeated anchors) and once (places of their windows that stand once)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    keyed = bucketed(rows, "row_id", F.octet_length("text"), "keyed")  # texts are shuffled once, here, and not to what is found in them
    release()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            g = Grams(b.column("text"), window, gram)
            at = g.anchors()
            row = g.rows(at)
            yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id").take(pa.array(row)), "place": pa.array((at - g.starts[row]).astype(np.int32)), "anchor": pa.array(g.grams[at].view(np.int64))})

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            g = Grams(b.column("text"), window, gram)
            at = g.windows(g.places(b.column("anchors")))
            row, (h1, h2) = g.rows(at), g.window_hashes(at)
            yield pa.RecordBatch.from_pydict({"h1": pa.array(h1.view(np.int64)), "h2": pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), "row_id": b.column("row_id").take(pa.array(row)), "place": pa.array((at - g.starts[row]).astype(np.int32))})

    seeds = materialize(keyed.select("row_id", "text").mapInArrow(lean(seed), "row_id long, place int, anchor long"), "seeds")
    again = materialize(seeds.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    release()
    found = materialize(seeds.join(again, "anchor").groupBy("row_id").agg(F.sort_array(F.collect_list("place")).alias("anchors")), "places")
    discard(seeds, again)
    matched = keyed.join(found, "row_id").select("row_id", "text", "anchors").mapInArrow(lean(extend), "h1 long, h2 int, row_id long, place int")
    # Where the count is 1, the least row and place are those of the only one.
    single = matched.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"), F.min("place").alias("place")).where("n = 1")
    once = materialize(single.select("row_id", "place"), "once")
    release()
    once = once.groupBy("row_id").agg(F.sort_array(F.collect_list("place")).alias("once"))
    marks = materialize(found.join(once, "row_id", "left"), "marks")
    discard(found)
    return keyed, marks


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, kept_sha256, spans.

    Words are runs of anything but ASCII white space; each word covered by a window of 35 words whose words also
    start elsewhere (in any row, the same one included) is removed. spans: the maximal repeats removed, as arrays
    of (start, end) in words. kept_text: the other words, joined by one space. A null text has no words. Repeated
    rows are each other's repeats. An empty table gives an empty result; other columns are not read.
    """
    keyed, marks = repeats(docs, id_col, text_col, window, gram)
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            anchors, once = b.column("anchors"), b.column("once")
            marked = pc.is_valid(anchors).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(marked)
            spans: dict[int, np.ndarray] = {}
            if len(some):
                pick = pa.array(some)
                g = Grams(b.column("text").take(pick), window, gram)
                at = np.setdiff1d(g.windows(g.places(anchors.take(pick))), g.places(once.take(pick)), assume_unique=True)
                row = g.rows(at)
                for k in np.unique(row):
                    s = at[row == k] - g.starts[k]
                    new = np.concatenate([[True], s[1:] > s[:-1] + window])  # touching repeats merge
                    first = np.flatnonzero(new)
                    spans[int(some[k])] = np.stack([s[first], s[np.append(first[1:] - 1, len(s) - 1)] + window], axis=1)
            n_words, n_removed, kept_text, digest, out_spans = [], [], [], [], []
            for i, raw in enumerate(b.column("text").cast(pa.large_binary()).to_pylist()):
                words = (raw or b"").split()
                n_words.append(len(words))
                own = spans.get(i)
                kept, removed, last = words, 0, 0
                if own is not None:
                    kept = []
                    for s, e in own.tolist():
                        kept += words[last:s]
                        removed, last = removed + e - s, e
                    kept += words[last:]
                n_removed.append(removed)
                joined = b" ".join(kept)
                kept_text.append(joined)
                digest.append(hashlib.sha256(joined).hexdigest())
                out_spans.append([{"start": s, "end": e} for s, e in own.tolist()] if own is not None else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(digest, pa.string()),
                 pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
            )

    joined = keyed.join(marks, "row_id", "left").select("doc_id", "text", "anchors", "once")
    return joined.mapInArrow(lean(remove), f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,end:long>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d))),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
c AS (SELECT w.*, coalesce(max(CASE WHEN n > 1 THEN i END) OVER (PARTITION BY w.r ORDER BY p), -99) >= p - 34 AS gone FROM w LEFT JOIN s ON s.r = w.r AND s.i = p),
k AS (SELECT r, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
