"""Language identification with hyperdimensional profiles (operator 8).

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the permuted vectors of
its three letters, a text's vector bundles (adds) those of its trigrams, and a language's prototype bundles the
unit vectors of its training texts. A text gets the language whose prototype has the largest cosine with its
vector. Texts go through numpy in blocks: trigram counts (documents x distinct trigrams) times trigram vectors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, lean, materialize

DIM, SEED = 1024, 8
#: Training texts: so many for each language at most (in expectation; chosen by a hash of doc_id).
TRAIN_DOCS = 2000
#: Characters and documents that one numpy block takes. A longer text is counted in pieces.
BLOCK_CHARS, BLOCK_DOCS = 1 << 19, 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit hash (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Profiles:
    """Letter tables and vectors; the same in every process."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters = np.zeros(sys.maxunicode + 1, np.uint32)  # the lower-cased letter, 0 for anything else
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                self.letters[c] = ord(low) if len(low) == 1 else c

    def letter_vectors(self, codes: np.ndarray) -> np.ndarray:
        """+1/-1 rows for code points; row of 0 is the word boundary's."""
        words = (self.dim + 63) // 64
        with np.errstate(over="ignore"):
            seeds = codes.astype(np.uint64)[:, None] * np.uint64(1 << 16) + np.arange(words, dtype=np.uint64) + (np.uint64(self.seed) << np.uint64(48))
        bits = np.unpackbits(mix64(mix64(seeds)).view(np.uint8), axis=1)[:, : self.dim]
        return bits.astype(np.int8) * 2 - 1

    def trigram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """grams: a | b << 21 | c << 42. float32 rows of +1/-1."""
        a, b, c = (grams >> np.uint64(s) & np.uint64(0x1FFFFF) for s in (0, 21, 42))
        codes, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        v = self.letter_vectors(codes)
        n = len(grams)
        out = np.roll(v, 2, axis=1)[at[:n]] * np.roll(v, 1, axis=1)[at[n : 2 * n]] * v[at[2 * n :]]
        return out.astype(np.float32)

    def grams(self, text: str) -> np.ndarray:
        """Trigrams of letters and single word boundaries of one text; empty without a letter."""
        codes = self.letters[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not codes.any():
            return np.zeros(0, np.uint64)
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        return codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bundled vectors (float32) of the texts, and which of them have a letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        has = np.zeros(len(texts), bool)
        parts: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal parts, held
            if parts:
                rows = sorted({i for i, _ in parts})
                place = {r: k for k, r in enumerate(rows)}
                gram, at = np.unique(np.concatenate([g for _, g in parts]), return_inverse=True)
                owner = np.repeat([place[i] for i, _ in parts], [len(g) for _, g in parts])
                for s in range(0, len(gram), 4096):  # bounded memory where texts have very many trigrams
                    width = min(4096, len(gram) - s)
                    own = (at >= s) & (at < s + width)
                    counts = np.bincount(owner[own] * width + (at[own] - s), minlength=len(rows) * width).reshape(len(rows), width).astype(np.float32)
                    out[rows] += counts @ self.trigram_vectors(gram[s : s + width])
            parts, held = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            for s in range(0, len(text), BLOCK_CHARS):
                # Pieces overlap by two, so that no trigram is lost between them.
                g = self.grams(text[max(0, s - 2) : s + BLOCK_CHARS])
                if len(g):
                    has[i] = True
                    parts.append((i, g))
                    held += len(g)
                if held >= BLOCK_CHARS:
                    flush()
            if len(parts) >= BLOCK_DOCS:
                flush()
        flush()
        return out, has


_profiles: dict[tuple[int, int], Profiles] = {}


def profiles(dim: int, seed: int) -> Profiles:
    return _profiles.setdefault((dim, seed), Profiles(dim, seed))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def held_out(id_col: Column) -> Column:
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language, learned from rows that have text, lang and are not held out.

    Of each language some train_docs texts are used, chosen by a hash of doc_id and text length, so the model's
    cost doesn't grow with the corpus; the languages and their row counts are taken over all rows. The model has one
    vector for each language, which is all that reaches the driver.
    """
    rows = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = materialize(rows.groupBy("lang").count(), "languages")  # a written table's size is known, so the join moves no texts
    langs, chosen = counts.agg(F.count("*"), F.sum(F.least("count", F.lit(train_docs)))).first()
    if not langs:
        return {}
    draw = F.shiftrightunsigned(F.xxhash64("id", F.length("text")), 11).cast("double") / float(1 << 53)
    sample = rows.join(counts, "lang").where(draw < F.lit(float(train_docs)) / F.col("count")).select("lang", "text")
    tasks = max(1, min(16 * (1 + langs // 100), chosen // 250))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = profiles(dim, seed), {}
        for b in batches:
            vectors, _ = p.encode(b.column("text").to_pylist())
            vectors = unit(vectors.astype(np.float64))
            langs = np.array(b.column("lang").to_pylist(), object)
            for k in set(langs.tolist()):
                sums[k] = sums.get(k, 0) + vectors[langs == k].sum(axis=0)
        keys = sorted(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(keys, pa.string()), "v": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        vectors = sum(np.frombuffer(v.as_buffer()) for v in sorted(table["v"], key=lambda v: v.as_py()))
        return pa.table({"lang": table["lang"].slice(0, 1), "v": pa.array([vectors.tobytes()], pa.binary())})

    parts = sample.repartition(tasks).mapInArrow(lean(bundle), "lang string, v binary")
    total = {r["lang"]: np.frombuffer(r["v"]) for r in parts.groupBy("lang").applyInArrow(lambda t: add(t), parts.schema).collect()}
    return {k: unit(total[k]) for k in sorted(total) if total[k].any()}


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), dim: int = DIM, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, the columns in keep, lang_pred, score. Only the text is an input of the prediction.

    score is the cosine with the chosen prototype, cut to 0..1. A null text, one without a letter, or an empty
    model gives ``und`` and score 0; equal cosines give the first language in code point order. Repeated rows
    give repeated results, an empty table gives none; columns that aren't named are not read, whatever their names.
    """
    names, own = list(model), fresh(docs, "text")
    matrix = np.stack([model[k] for k in names]).astype(np.float32).T if names else np.zeros((dim, 0), np.float32)
    rows = docs.select(column(id_col).alias("doc_id"), *[column(c) for c in keep], column(text_col).cast("string").alias(own))
    schema = rows.drop(own).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles(dim, seed)
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                vectors, has = p.encode(b.column(own).to_pylist())
                if names:
                    cosines = unit(vectors) @ matrix
                    best = cosines.argmax(axis=1)
                    score = np.where(has, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
                    pred = [names[k] if h else "und" for k, h in zip(best, has, strict=True)]
                else:
                    score, pred = np.zeros(b.num_rows), ["und"] * b.num_rows
                kept = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != own]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], names=schema.names)

    return rows.mapInArrow(lean(predict), schema)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told, with all their columns and the predicted language where lang_col is null.

    Rejected are null texts, texts without a letter and texts whose vector points away from every prototype (score 0).
    Repeated rows stay repeated; an empty table gives an empty one; other columns pass whatever they are.
    """
    model = fit(docs, id_col, text_col, lang_col)
    names = np.array(list(model), object)
    matrix = np.stack(list(model.values())).astype(np.float32).T if model else np.zeros((DIM, 0), np.float32)
    kind = docs.schema[lang_col].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles(DIM, SEED)
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                vectors, has = p.encode(b.column(text_col).to_pylist())
                if not len(names):
                    continue
                products = vectors @ matrix
                lang = pc.coalesce(b.column(lang_col), pa.array(names[products.argmax(axis=1)], pa.string()).cast(b.schema.field(lang_col).type)) if kind == "string" else b.column(lang_col)
                yield b.set_column(b.schema.get_field_index(lang_col), b.schema.field(lang_col), lang).filter(pa.array(has & (products.max(axis=1) > 0)))

    return docs.mapInArrow(lean(keep), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
