"""Edit-aware token counts (operator 4).

A document is a sequence of pre-tokens, each with its number of characters and tokens; a segment tree over leaves of
some pre-tokens holds the sums. Documents are cut and encoded once (count_trees), and what that gave stays in a table:
text, and the characters and tokens of its pre-tokens. A batch of edits starts from that table (edited) and returns the
table for the next batch besides the counts. The pre-token pattern reads from left to right and looks one character
ahead at most, so an edit can change pre-tokens from the first one that ends less than two characters before it, up to
the place where the scan of the new text meets an old boundary again. Only that region is cut and encoded anew; leaves
are replaced, each with its part of the text, and the sums on their paths are set again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, lean, materialize
from .tokens import blocks

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose counts a process keeps before its cache starts anew.
CACHE = 250_000
#: Pre-tokens that a leaf of a new tree holds; a leaf with over twice as many is split.
LEAF = 64
#: The longest string that the pattern matches as a whole or not at all (a shortened verb), and a character ahead.
AHEAD = 4
#: Personal data that a revision of a document takes out: mail addresses, dotted addresses, phone numbers.
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\+?[0-9][0-9() -]{6,}[0-9]"
REPLACEMENT = "[removed]"


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import regex
        import tiktoken

        path = vocabulary if "/" in vocabulary else str(public_tokenizers.path(vocabulary))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding._encode_single_piece(piece.encode("utf-8", "replace")))
        return n

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known, tokens = self.known, self.tokens
        return [known.get(p) or tokens(p) for p in pieces]


class CountTree:
    """A document's pre-tokens in leaves (text, lengths, counts), and a segment tree of (characters, tokens) over the leaves."""

    def __init__(self, counter: Counter, text: str, lengths: list[int] | None = None, counts: list[int] | None = None):
        """lengths, counts: of the text's pre-tokens where they are known; else it is cut and encoded."""
        self.counter, self.encoded = counter, 0  # pre-tokens encoded so far
        if lengths is None or counts is None:
            pieces = counter.cut(text)
            lengths, counts = list(map(len, pieces)), counter.counts(pieces)
            self.encoded = len(pieces)
        self.pieces = len(lengths)
        self.leaves = self.cut(text, lengths, counts)
        self.build()

    @staticmethod
    def cut(text: str, lengths: list[int], counts: list[int]) -> list[tuple[str, list[int], list[int]]]:
        out, at = [], 0
        for i in range(0, len(lengths), LEAF):
            own = lengths[i : i + LEAF]
            end = at + sum(own)
            out.append((text[at:end], own, counts[i : i + LEAF]))
            at = end
        return out or [("", [], [])]

    @property
    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    @property
    def lengths(self) -> list[int]:
        return [n for leaf in self.leaves for n in leaf[1]]

    @property
    def counts(self) -> list[int]:
        return [n for leaf in self.leaves for n in leaf[2]]

    def __len__(self) -> int:
        return self.chars[1]

    def build(self) -> None:
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (text, _, counts) in enumerate(self.leaves):
            self.chars[self.size + i], self.sums[self.size + i] = len(text), sum(counts)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    def update(self, leaf: int) -> None:
        i = self.size + leaf
        self.chars[i], self.sums[i] = len(self.leaves[leaf][0]), sum(self.leaves[leaf][2])
        while i > 1:
            i //= 2
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """(leaf, its pre-token, where that begins) of the pre-token with character at; the end of the text is in the last leaf."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if at >= begin + self.chars[i] and i - self.size + 1 < len(self.leaves) * 2 and self.chars[i + 1] > 0:
                begin += self.chars[i]
                i += 1
        leaf = min(i - self.size, len(self.leaves) - 1)
        k = 0
        for k, n in enumerate(self.leaves[leaf][1]):
            if at < begin + n:
                return leaf, k, begin
            begin += n
        return leaf, len(self.leaves[leaf][1]), begin

    def before(self, leaf: int, k: int, begin: int) -> tuple[int, int, int] | None:
        """The pre-token before that one."""
        while k == 0:
            if leaf == 0:
                return None
            leaf -= 1
            k = len(self.leaves[leaf][1])
        return leaf, k - 1, begin - self.leaves[leaf][1][k - 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end."""
        if not 0 <= start <= end <= len(self):
            raise ValueError(f"edit {start}:{end} of a text with {len(self)} characters")
        shift = len(new) - (end - start)
        # Back to the last pre-token that ends two characters before the edit or earlier: it and those before stand.
        here = self.find(max(0, start - 1))
        while here[2] > 0 and here[2] > start - 2:
            back = self.before(*here)
            if back is None:
                break
            here = back
        first_leaf, first, begin = here
        # The new text from that leaf on, as far as it is read: old leaves are added when the scan comes near its end.
        base = begin - sum(self.leaves[first_leaf][1][:first])
        local, next_leaf, size = "", first_leaf, 0
        while next_leaf < len(self.leaves) and (size < end - base or next_leaf == first_leaf):
            local += self.leaves[next_leaf][0]
            size, next_leaf = len(local), next_leaf + 1
        local = local[: start - base] + new + local[end - base :]
        # Forward: new pre-tokens until one ends where an old one ended, behind the edit.
        old_leaf, old, old_at = first_leaf, first, begin
        at, lengths, counts = begin, [], []
        while True:
            # The old boundary at or after where the new scan stands.
            while old_leaf < len(self.leaves) and (old_at < end or old_at + shift < at):
                if old == len(self.leaves[old_leaf][1]):
                    old_leaf, old = old_leaf + 1, 0
                    continue
                old_at += self.leaves[old_leaf][1][old]
                old += 1
            if old_at >= end and old_at + shift == at and at >= start + len(new):
                break
            m = self.counter.pattern.match(local, at - base)
            while next_leaf < len(self.leaves) and (m is None or m.end() + AHEAD > len(local)):
                local += self.leaves[next_leaf][0]
                next_leaf += 1
                m = self.counter.pattern.match(local, at - base)
            if m is None:
                break
            lengths.append(len(m.group()))
            counts.append(self.counter.tokens(m.group()))
            at = base + m.end()
        self.encoded += len(lengths)
        self.replace(first_leaf, first, old_leaf, old, local[begin - base : at - base], lengths, counts)

    def replace(self, leaf: int, k: int, end_leaf: int, end_k: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Puts pre-tokens in place of those from (leaf, k) up to (end_leaf, end_k).

        A leaf is split when some LEAF pre-tokens more than it began with have come into it; the nodes above, one for LEAF
        pre-tokens, are built again then.
        """
        gone = sum(len(self.leaves[i][1]) for i in range(leaf, min(end_leaf, len(self.leaves)))) - k + (end_k if end_leaf < len(self.leaves) else 0)
        self.pieces += len(lengths) - gone
        head = self.leaves[leaf]
        tail = self.leaves[end_leaf] if end_leaf < len(self.leaves) else ("", [], [])
        own = (head[0][: sum(head[1][:k])] + text + tail[0][sum(tail[1][:end_k]) :], head[1][:k] + lengths + tail[1][end_k:], head[2][:k] + counts + tail[2][end_k:])
        last = min(end_leaf, len(self.leaves) - 1)
        if len(own[1]) <= 2 * LEAF:
            self.leaves[leaf] = own
            self.update(leaf)
            for i in range(leaf + 1, last + 1):
                self.leaves[i] = ("", [], [])
                self.update(i)
            return
        self.leaves[leaf : last + 1] = self.cut(*own)
        self.build()


_counters: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


EDITS = "array<struct<start:int,end:int,replacement:string>>"
TREE = "text string, lengths array<int>, counts array<int>"
RESULT = "n_chars long, n_pretokens long, n_tokens long, n_edits long, n_chars_after long, n_pretokens_after long, n_tokens_after long, n_reencoded long"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)))


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:e] for a, e in zip(at[:-1], at[1:], strict=True)]


def count_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, lengths, counts of each row: its whole text (null: empty), and the characters and tokens of its
    pre-tokens in order, which are the leaves of its tree. Write it, and give it to edited."""
    rows = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            done = 0
            for texts in blocks(batch.column("text")):
                pieces = [c.cut(t) for t in texts.to_pylist()]
                lengths, counts = ([np.fromiter(f(p), np.int32, len(p)) for p in pieces] for f in (lambda p: map(len, p), c.counts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), texts, lists(lengths), lists(counts)], names=["doc_id", *names(TREE)])
                done += len(texts)

    return rows.mapInArrow(lean(apply), f"doc_id {kind}, {TREE}")


def edited(trees: DataFrame, edits: Column | str, vocabulary: str = VOCABULARY, replacement: str = REPLACEMENT, counts_only: bool = False) -> DataFrame:
    """One row per row of trees: doc_id, the counts before and after its edits, and (unless counts_only) the new text, lengths
    and counts, which a next batch of edits can start from.

    edits: an array column of struct<start: int, end: int, replacement: string> over trees, in code points, where each
    edit refers to the text that the ones before it left; or a pattern whose matches are replaced. n_reencoded
    counts the pre-tokens that the edits had cut and encoded anew; nothing else is encoded. Null edits are none, a null
    replacement is empty; an edit outside its text is cut to it.
    """
    replaced = edits if isinstance(edits, str) else None
    rows = trees.select("doc_id", *names(TREE), *([] if isinstance(edits, str) else [edits.alias("edits")]))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pattern = counter(vocabulary), None if replaced is None else re.compile(replaced)
        for batch in batches:
            done = 0
            for texts in blocks(batch.column("text")):
                part = batch.slice(done, len(texts))
                done += len(texts)
                out, after = np.zeros((8, len(texts)), np.int64), []
                for i, (text, lengths, counts) in enumerate(zip(texts.to_pylist(), arrays(part.column("lengths")), arrays(part.column("counts")), strict=True)):
                    before = now = (len(text), len(lengths), int(counts.sum()))
                    if pattern is None:
                        todo = [(e["start"] or 0, e["end"] or 0, e["replacement"] or "") for e in part.column("edits")[i].as_py() or []]
                    else:  # the last match first, so that the places of the others hold
                        todo = [(m.start(), m.end(), replacement) for m in pattern.finditer(text)][::-1]
                    encoded = 0
                    if todo:
                        tree = CountTree(c, text, lengths.tolist(), counts.tolist())
                        for start, end, new in todo:
                            start = min(max(start, 0), len(tree))
                            tree.edit(start, min(max(end, start), len(tree)), new)
                        now, encoded = (len(tree), tree.pieces, tree.total), tree.encoded
                        if not counts_only:
                            text, lengths, counts = tree.text, np.array(tree.lengths, np.int32), np.array(tree.counts, np.int32)
                    out[:, i] = *before, len(todo), *now, encoded
                    after.append((text, lengths, counts))
                kept = []
                if not counts_only:
                    text, lengths, counts = zip(*after, strict=True)
                    kept = [pa.array(text, pa.string()), lists(lengths), lists(counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out), *kept], names=["doc_id", *names(schema)])

    schema = RESULT if counts_only else f"{RESULT}, {TREE}"
    return rows.mapInArrow(lean(apply), f"doc_id {kind}, {schema}")


def edit_aware_counts(docs: DataFrame, edits: Column | str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, the counts of its text, and those after its edits; see edited. The trees are written
    first, and the edits start from them.

    edits: a pattern, or a column over doc_id and text. A null text counts as empty. Repeated rows give
    repeated results, ties don't arise, an empty table gives no rows; other columns are not read.
    """
    trees = materialize(count_trees(docs, id_col, text_col, vocabulary), "count-trees")
    return edited(trees, edits, vocabulary, counts_only=True)


def query(spark, sf_dir: str) -> DataFrame:
    return edit_aware_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), PERSONAL)
