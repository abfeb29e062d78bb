"""Token ids of whole texts by a public tokenizer, in Arrow blocks, with a bounded cache of words."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Words kept in a process. A full cache forgets a block's new words behind the block; it starts anew where it knows few of them.
CACHE_WORDS = 600_000
#: Lower-case letters of Latin-1, and words of lower-case Latin letters only.
LATIN = "\u00df-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[a-z{LATIN}]+")
#: Bytes of text that are split at a time.
BLOCK_BYTES = 2 << 20


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def blocks(texts: pa.Array, size: int = BLOCK_BYTES):
    """Slices of a string array with some ``size`` bytes each (a longer text is a slice of its own)."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, base + size, side="right")))
        yield texts.slice(start, end - start)
        start = end


def lower(texts: pa.LargeStringArray, latin: bool = False) -> pa.LargeStringArray:
    """Lower-cases A-Z, byte by byte; with latin the capitals of U+00C0 to U+00DE too (in UTF-8, C3 and a byte)."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return pa.array([""] * len(texts), pa.large_string())
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    if latin:
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        capital = (low[second] >= 0x80) & (low[second] <= 0x9E) & (low[second] != 0x97)
        low[second[capital]] += np.uint8(32)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(low))


class WordIds:
    """Encodes texts with a tokenizer that drops white space, so that a text's ids are those of its words in turn.

    Each distinct word is encoded once. Lower-casing ASCII and Latin-1 letters first, and setting the ASCII marks .,!%&#$* that end
    a word after a letter apart, changes no id (both are what the tokenizer does itself) and leaves fewer words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that normalising doesn't change and that are one piece each.
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(1 << 16, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint16)
        self.used = 0

    def learn(self, words: list[str]) -> None:
        n = len(self.index)
        plain, other = [], []
        for w in words:
            (plain if PLAIN.fullmatch(w) else other).append(w)
        words = plain + other
        # A word of letters alone is one piece to the tokenizer, so many are encoded as one text and told apart by their last ids.
        joined = [e.ids for e in self.pieces.encode_batch_fast([" ".join(plain[i : i + 64]) for i in range(0, len(plain), 64)], add_special_tokens=False)]
        each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        first = np.concatenate([np.array(x, np.uint16) for x in joined] or [np.zeros(0, np.uint16)])
        ends = np.flatnonzero(self.last[first]) + 1
        sizes = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, each), np.int64, len(each))])
        if len(ends) != len(plain):
            raise ValueError("the tokenizer has no word ends where they were expected")
        flat = np.concatenate([first, np.fromiter((x for e in each for x in e), np.uint16)])
        while n + len(words) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.sizes[n : n + len(words)] = sizes
        self.starts[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint16) of all texts in turn and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # These letters compose with marks of this block only; a text with one is left to the tokenizer as it is.
        marked = pc.match_substring_regex(texts, "[̀-ͯ]")
        texts = pc.if_else(marked, texts, lower(texts, latin=True))
        texts = pc.replace_substring_regex(texts, f"([a-z{LATIN}])([.,!%&#$*]+)([\t-\r ]|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.index]
        full = len(self.index) > CACHE_WORDS
        if full and 2 * len(new) > len(words):
            self.clear()
            new, full = words, False
        used = self.used
        if new:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if full:
            for w in new:
                del self.index[w]
            self.used = used
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[offsets])


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    return _encoders.setdefault(path, WordIds(path)) if path not in _encoders else _encoders[path]
