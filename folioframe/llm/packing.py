"""Lexical retrieval packing (operator 3).

Documents become token ids once; document frequencies of the token ids are summed over the whole corpus (the
vocabulary bounds them). Documents are dealt by content: each goes to the place of the leader (one of some root of the
number of documents, in an order that puts like leaders side by side) that scores highest for it, then of the second;
a place with many documents is split. Then each task packs its documents shard by shard: a shard has an inverted index with
BM25 weights, a seed document asks it for unused neighbours, and these fill the seed's window one after another.
The document that meets the window's end is cut there, and its rest seeds the next window. What is open when a
shard ends goes on into the next; what is open when a task ends is cut at powers of two. So no token is padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, lean, materialize
from .tokens import TOKENIZER, blocks, tokenizer_path, word_ids

WINDOW, END_ID = 4096, 2
#: A shard: so many ids or documents. It bounds a task's memory, and how far neighbours are sought among what deal puts side by side.
SHARD_IDS, SHARD_DOCS = 1_000_000, 8192
#: BM25's constants.
K1, B = 1.2, 0.75
#: Neighbours that a query's answer holds; when the window takes them all, the seed asks for the next ones.
ANSWER = 64
#: Tokens in over one in so many documents of a shard have rows over all its documents.
DENSE = 8


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit) of every row's whole text, end_id last. A null text is an empty one."""
    path = tokenizer_path(tokenizer)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id", F.lit(b"").alias("ids")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in batches:
            done = 0
            for part in blocks(batch.column("text")):
                ids, sizes = encoder.encode(part)
                ends = np.cumsum(sizes)
                raw = [np.append(ids[e - n : e], np.uint16(end_id)).tobytes() for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(part)), pa.array(raw, pa.binary())], names=["doc_id", "ids"])
                done += len(part)

    return rows.mapInArrow(lean(encode), schema)


def term_counts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, document, count) of each token of each document, by document and token. 16-bit ids sort in linear time."""
    ids = np.concatenate([np.sort(x, kind="stable") for x in texts])
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    at = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])]))
    return ids[at], owner[at], np.diff(np.append(at, len(ids)))


def corpus_statistics(ids: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by token id (65,536 entries), documents and mean length, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for part in blocks(batch.column("ids")):
                texts = [np.frombuffer(raw.as_buffer(), np.uint16) for raw in part]
                token, _, _ = term_counts(texts)
                df += np.bincount(token, minlength=1 << 16)
                docs, total = docs + len(texts), total + sum(map(len, texts))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.append(at, [-1, -2])), "n": pa.array(np.append(df[at], [docs, total]))})

    df = np.zeros(1 << 16, np.int64)
    docs = total = 0
    for r in ids.select("ids").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a row for each id of the vocabulary
        if r["id"] == -1:
            docs = r["n"]
        elif r["id"] == -2:
            total = r["n"]
        else:
            df[r["id"]] = r["n"]
    return df, docs, total / docs if docs else 1.0


class Shard:
    """An inverted index over a few documents: postings by token id, with BM25 weights."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(texts)
        lengths = np.array([len(x) for x in texts])
        token, doc, tf = term_counts(texts)
        weight = (idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))).astype(np.float32)
        self.by_doc = np.searchsorted(doc, np.arange(n + 1))  # tokens of a document stand together
        self.token, self.weight = token, weight
        order = np.argsort(token, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.posting = np.searchsorted(token[order], np.arange((1 << 16) + 1))
        self.count = n
        # Long postings (which take an eighth of this room as lists) are rows over all documents besides: those are added faster.
        common = np.flatnonzero(DENSE * np.diff(self.posting) > n)
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        here = self.row.take(token)
        self.rows[here[here >= 0], doc[here >= 0]] = weight[here >= 0]

    def score(self, tokens: np.ndarray) -> np.ndarray:
        """The sum of the weights of tokens for each document."""
        row = self.row.take(tokens)
        rare = tokens[row < 0].astype(np.int64)
        a = self.posting.take(rare)
        n = self.posting.take(rare + 1) - a
        at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        return np.bincount(self.docs.take(at), self.weights.take(at), minlength=self.count) + self.rows.take(row[row >= 0], axis=0).sum(axis=0)

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents by falling score (then by place), those with a shared id only; all ids of the seed count."""
        scores = self.score(self.token[self.by_doc[seed] : self.by_doc[seed + 1]])
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > ANSWER:
            found = found[np.argpartition(-scores[found], ANSWER)[:ANSWER]]
        return found[np.lexsort((found, -scores[found]))].tolist()


def retrieval_order(texts: list[np.ndarray], idf: np.ndarray, mean: float, room: int, window: int = WINDOW) -> list[int]:
    """The order in which a shard's documents are written. room: ids left in the open window."""
    shard, used, order, next_seed = Shard(texts, idf, mean), np.zeros(len(texts), bool), [], 0
    while True:
        while next_seed < len(texts) and used[next_seed]:
            next_seed += 1
        if next_seed == len(texts):
            return order
        seed = next_seed
        while seed is not None:  # windows whose last document seeds the next
            if not used[seed]:
                used[seed] = True
                order.append(seed)
                room -= len(texts[seed])
            cut = seed if room <= 0 else None
            while room > 0:
                answer = shard.neighbours(seed, used)
                if not answer:
                    break
                for d in answer:
                    used[d] = True
                    order.append(d)
                    room -= len(texts[d])
                    if room <= 0:
                        cut = d
                        break
            if room <= 0:
                room = window + room % -window if room % window else window
            seed = cut if cut is not None and cut != seed else None


def leaders(ids: DataFrame, statistics: tuple[np.ndarray, int, float]) -> list[np.ndarray]:
    """Different texts by least hash, as many as the root of the number of documents at most, like ones side by side."""
    n, mean = statistics[1:]
    count = int(np.ceil(np.sqrt(n)))
    h = F.xxhash64("ids")
    some = ids.select(h.alias("h"), "ids").where(F.pmod("h", F.lit(max(1, n // (4 * count) if count else 1))) == 0).dropDuplicates(["h"])
    texts = [np.frombuffer(r["ids"], np.uint16) for r in some.orderBy("h").limit(count).collect()]
    return [texts[i] for i in retrieval_order(texts, weights(statistics), mean, WINDOW)] if texts else []


def weights(statistics: tuple[np.ndarray, int, float]) -> np.ndarray:
    """Inverse document frequency by token id."""
    df, n, _ = statistics
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def places(ids: DataFrame, statistics: tuple[np.ndarray, int, float], chosen: list[np.ndarray]) -> DataFrame:
    """ids with place and second (numbers of the leaders of highest score) and salt (spreads documents of one place)."""
    idf, mean = weights(statistics), statistics[2]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Shard(chosen, idf, mean) if chosen else None
        for batch in batches:
            done = 0
            for part in blocks(batch.column("ids")):
                near = np.zeros((len(part), 2), np.int32)
                token, owner, _ = term_counts([np.frombuffer(raw.as_buffer(), np.uint16) for raw in part])
                upto = np.searchsorted(owner, np.arange(len(part) + 1))
                for k in range(len(part) if index else 0):
                    scores = index.score(token[upto[k] : upto[k + 1]])
                    near[k, 0] = scores.argmax()
                    scores[near[k, 0]] = -1
                    near[k, 1] = scores.argmax()
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(part)).columns, pa.array(near[:, 0]), pa.array(near[:, 1])], names=["doc_id", "ids", "place", "second"])
                done += len(part)

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(lean(find), f"doc_id {kind}, ids binary, place int, second int").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))


def deal(ids: DataFrame, statistics: tuple[np.ndarray, int, float]) -> DataFrame:
    """The rows of ids, those with like texts in a run of one task. Deletes ids, a materialized table."""
    found = materialize(places(ids, statistics, leaders(ids, statistics)), "places")
    discard(ids)
    keys = ["place", "second", "salt"]
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")


def pack(ids: DataFrame, statistics: tuple[np.ndarray, int, float], window: int = WINDOW, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ids: what token_ids returns."""
    idf, mean = weights(statistics), statistics[2]
    kind = ids.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        filled = 0  # ids in the open window
        tail: list[list] = []  # its pieces: (doc, start, ids, doc_tokens)
        rows: list[tuple] = []

        def close(pieces: list[list]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, x, total in pieces:
                rows.append((doc, start, len(x), zlib.crc32(x.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(x)
            sequence += 1

        def shard_rows(docs: list, texts: list[np.ndarray]) -> None:
            nonlocal filled, tail
            for d in retrieval_order(texts, idf, mean, window - filled, window):
                x, start = texts[d], 0
                while start < len(x):
                    part = x[start : start + window - filled]
                    tail.append([docs[d], start, part, len(x)])
                    start, filled = start + len(part), filled + len(part)
                    if filled == window:
                        close(tail)
                        tail, filled = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows, strict=True))
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        docs, texts, held, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = np.frombuffer(raw.as_py(), np.uint16)
                docs.append(doc)
                texts.append(x)
                held += len(x)
                if held >= shard_ids or len(docs) >= shard_docs:
                    shard_rows(docs, texts)
                    docs, texts, held = [], [], 0
                    yield from flush()
        if docs:
            shard_rows(docs, texts)
        while filled:  # the last window, cut at powers of two
            size, piece_list = 1 << (filled.bit_length() - 1), []
            left = size
            while left:
                doc, start, x, total = tail[0]
                piece_list.append([doc, start, x[:left], total])
                if len(x) <= left:
                    tail.pop(0)
                else:
                    tail[0] = [doc, start + left, x[left:], total]
                left -= len(piece_list[-1][2])
            close(piece_list)
            filled -= size
        yield from flush()

    return ids.mapInArrow(lean(write), f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in names[1:]))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All rows of docs as pieces of sequences of at most 4096 ids; see pack for the columns.

    Every id of every row lies in exactly one piece; pieces of a sequence stand in it from 0 without gaps. Sequences
    have 4096 ids, but for those that end a task, which have a power of two. A null or empty text is its end id
    alone. Repeated rows are packed as often as they stand. An empty table gives no pieces.
    """
    ids = materialize(token_ids(docs, id_col, text_col, tokenizer), "ids")
    statistics = corpus_statistics(ids)
    return pack(deal(ids, statistics), statistics)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
