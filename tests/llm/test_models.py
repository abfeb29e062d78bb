"""Operators 1, 3, 4, 7, 8 and 9 against plain Python, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import language_id, lm_scoring, near_dedup, packing, substring_dedup, token_counts, tokens
from folioframe.llm.common import materialize
from folioframe.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 1


def test_gradient():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300)
    net = lm_scoring.Net.initial(counts)
    net = lm_scoring.Net(net.flat.astype(np.float64), net.tree)
    context, target = rng.integers(0, 301, (40, 4)), rng.integers(0, 300, 40)
    g = net.gradient(context, target).flat
    for i in rng.choice(np.flatnonzero(g), 40):
        was, e, ends = net.flat[i], 1e-5, []
        for sign in (1, -1):
            net.flat[i] = was + sign * e
            ends.append(-net.log_probabilities(context, target).mean())
        net.flat[i] = was
        assert abs((ends[0] - ends[1]) / (2 * e) - g[i]) < 1e-4 * max(1, abs(g[i]))


def huffman_codes(counts):
    """id -> the decisions on its way as (the set of ids below, whether the id is on the heavier side), built the textbook way."""
    import heapq

    heap = [(c + 0.5, i, frozenset([i])) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    ways, n = defaultdict(list), len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for i in x | y:
            ways[i].append((x | y, i in y))
        n += 1
        heapq.heappush(heap, (a + b, n, x | y))
    return ways


def test_tree_is_a_huffman_tree():
    for counts in ([5], [3, 4], [0, 0, 0], list(range(1, 200)), [1000, *[1] * 150]):
        tree, ways = lm_scoring.Tree(np.array(counts)), huffman_codes(counts)
        sizes = tree.parts[0][1] + tree.parts[1][1]
        cost = lambda n: sum((c + 0.5) * k for c, k in zip(counts, n, strict=True))
        assert abs(cost(sizes) - cost([len(ways[i]) for i in range(len(counts))])) < 1e-6


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    for v in (1, 2, 50, 1000):
        counts = rng.integers(0, 50, v)
        net = lm_scoring.Net.initial(counts)
        context = np.repeat(rng.integers(0, v + 1, (1, 4)), v, axis=0)
        assert abs(np.exp(net.log_probabilities(context, np.arange(v))).sum() - 1) < 1e-3
        net.node[...] = 0  # the biases alone give the frequencies
        assert np.allclose(np.exp(net.log_probabilities(context, np.arange(v))), (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)


def plain_log_probability(net, context, target):
    """log p(target | context), one word, step by step in Python floats."""
    x = [float(v) for w in context for v in net.embed[w]]
    h = [np.tanh(sum(a * float(net.w[i, j]) for i, a in enumerate(x)) + float(net.b[j])) for j in range(len(net.b))]
    total = 0.0
    for starts, sizes, decision, side in net.tree.parts:
        for k in range(starts[target], starts[target] + sizes[target]):
            z = sum(a * float(b) for a, b in zip(h, net.node[decision[k]], strict=True)) + float(net.bias[decision[k]])
            total -= np.log1p(np.exp(-float(side[k]) * z))
    return total


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    texts = ["One two\tthree", None, "", "  ", "two ONE", "x" * 70_000 + " one", "\x0bthree\x0c", "n\u00e9 N\u00c9"]
    flat, starts = lm_scoring.words_in(pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts)))
    want = [words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    assert np.diff(starts).tolist() == [len(x) for x in want]
    seen = {}
    for w, h in zip([w for x in want for w in x], flat.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) == 6
    assert lm_scoring.words_in(pa.array([], pa.string()))[1].tolist() == [0]


def test_lm_scores(docs, odd, none):
    counts = materialize(lm_scoring.word_counts(docs), "counts")
    want = Counter(w for r in docs.collect() for w in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)))
    assert Counter(r.n for r in counts.collect()) == Counter(want.values())
    known, by_id = lm_scoring.vocabulary(counts)
    assert by_id.sum() == sum(want.values()) and by_id.min() >= 0
    ids = materialize(lm_scoring.to_ids(docs, known, len(by_id)), "ids")
    net = lm_scoring.fit(ids, by_id)
    got = {r.doc_id: r for r in lm_scoring.scored(ids, net).collect()}
    for r in sorted(ids.collect(), key=lambda r: len(r.ids))[:8]:  # word by word
        x = np.frombuffer(r.ids, np.uint16).astype(int).tolist()
        pad = [net.vocab] * 2 + x + [net.vocab] * 2
        total = sum(plain_log_probability(net, [pad[i], pad[i + 1], pad[i + 3], pad[i + 4]], t) for i, t in enumerate(x))
        assert abs(total - got[r.doc_id].log_likelihood) < 1e-3 * max(1, abs(total)) and got[r.doc_id].n_words == len(x)
    mean = lambda m: lm_scoring.scored(ids, m).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(net) > mean(lm_scoring.Net.initial(by_id))
    assert lm_scoring.lm_scores(none).count() == 0
    odds = lm_scoring.lm_scores(odd).collect()
    assert Counter((r.doc_id, r.n_words) for r in odds) == Counter((r.doc_id, len(words(r.text))) for r in odd.collect())
    assert all((r.mean_log_probability is None) == (r.n_words == 0) for r in odds)


# ---- 3


def check_packing(df):
    path = tokens.tokenizer_path(tokens.TOKENIZER)
    encode = tokens.WordIds(path).tokenizer.encode
    pieces, rows = packing.packed(df).collect(), df.select("doc_id", "text").collect()
    sequences, crc = defaultdict(list), Counter()
    for p in pieces:
        sequences[p.sequence_id].append(p)
        crc[p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for doc in {r.doc_id for r in rows}:
        texts = [encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows if r.doc_id == doc]
        assert sum(p.length for p in by[doc]) == sum(map(len, texts))
        for p in by[doc]:
            assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in texts)
        if len(texts) == 1:
            assert sorted((p.start, p.length) for p in by[doc])[0][0] == 0
            ends = sorted((p.start, p.start + p.length) for p in by[doc])
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_packing(docs, odd, none):
    check_packing(docs)
    check_packing(odd)
    assert packing.packed(none).count() == 0


def test_word_ids_are_the_tokenizers():
    import pyarrow as pa

    w = tokens.WordIds(tokens.tokenizer_path(tokens.TOKENIZER))
    rng = random.Random(1)
    alphabet = "aAbBsStT'’.,!?éÉ́ÀÞß \n\tİΣς0९<|endoftext|>漢̱Hẞﬁ  \x1c×÷"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)] + [None, "", "'s 't's", "foo(., x<|startoftext|>,", "ÀÉÎ. Öß, É"]
    ids, sizes = w.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    for t, e, n in zip(texts, ends, sizes, strict=True):
        assert ids[e - n : e].tolist() == w.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_shards_prefer_neighbours():
    rng = random.Random(4)
    texts = [np.array([1000 * topic + rng.randrange(300) for _ in range(400)], np.uint16) for _ in range(30) for topic in (1, 2, 3)]
    order = packing.retrieval_order(texts, np.ones(1 << 16, np.float32), 400.0, 4096)
    assert sorted(order) == list(range(90))
    topics = [i % 3 for i in order]
    assert sum(a == b for a, b in zip(topics, topics[1:], strict=False)) > 75


# ---- 4


def test_count_tree_edits():
    c, rng = token_counts.Counter(), random.Random(7)
    alphabet = ["a", "B", "é", "漢", " ", "  ", "\n", "\t", "'s", "'ll", "1", "22", ".", "!", "word", " the", "　", "'"]
    for _ in range(120):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 800])))
        tree = token_counts.CountTree(c, text)
        for _ in range(10):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 60])), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 0, 1, 2, 8, 300])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.total == len(c.encoding.encode_ordinary(text)) and tree.pieces == len(c.cut(text)) and tree.text == text
    tree = token_counts.CountTree(c, "word " * 20_000)
    tree.edit(50_000, 50_004, "other")
    assert tree.encoded - 20_001 < 10  # only the region touched


def test_edits_near_the_end_of_a_leaf():
    """A leaf's end is no end of the text: what the pattern could read on is read."""
    c = token_counts.Counter()
    for text in ("they're " * 300, "ab" * 3000 + " c", "x" + " " * 500 + "y", "'" * 400 + "ll"):
        for at in range(0, len(text), 37):
            tree = token_counts.CountTree(c, text)
            tree.edit(at, min(len(text), at + 1), "")
            tree.edit(at, at, "'")
            want = text[:at] + "'" + text[at + 1 :]
            assert tree.text == want and tree.lengths == list(map(len, c.cut(want))) and tree.total == len(c.encoding.encode_ordinary(want))


def test_edit_aware_counts(spark, docs, odd, none):
    c = token_counts.Counter()
    for df in (docs, odd):
        got = token_counts.edit_aware_counts(df, token_counts.PERSONAL).collect()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            after, n = re.subn(token_counts.PERSONAL, token_counts.REPLACEMENT, r.text or "")
            want[r.doc_id, len(c.encoding.encode_ordinary(r.text or "")), n, len(c.encoding.encode_ordinary(after))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got) == want
    assert token_counts.edit_aware_counts(none, token_counts.PERSONAL).count() == 0


def test_a_second_batch_of_edits_starts_from_the_first_ones_trees(spark, odd):
    c = token_counts.Counter()
    trees = materialize(token_counts.count_trees(odd), "trees")
    batches = [F.expr("array(named_struct('start', 2, 'end', 5, 'replacement', 'new words'), named_struct('start', 0, 'end', 0, 'replacement', null))"), F.expr("if(doc_id % 2 = 0, null, array(named_struct('start', -3, 'end', 1000000, 'replacement', 'all'), named_struct('start', 1, 'end', 1, 'replacement', 'x')))")]
    want = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    for batch in batches:
        trees = materialize(token_counts.edited(trees, batch), "trees")
        edit = lambda i, t: t[:2] + "new words" + t[5:] if batch is batches[0] else t if i is not None and i % 2 == 0 else "axll"  # noqa: E731, B023
        want = [(i, edit(i, t)) for i, t in want]
        got = trees.collect()
        assert Counter((r.doc_id, r.text, tuple(r.lengths), r.n_tokens_after) for r in got) == Counter((i, t, tuple(map(len, c.cut(t))), len(c.encoding.encode_ordinary(t))) for i, t in want)
        assert all(sum(r.counts) == r.n_tokens_after for r in got)


# ---- 7


def brute_components(ids, fps):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in zip(ids, fps, strict=True):
        for j, y in zip(ids, fps, strict=True):
            if i < j and (x ^ y).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    import xxhash

    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, odd, none):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = brute_components(list(fps), list(fps.values()))
    got = near_dedup.near_groups(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{x:016x}", want[i]) for i, x in fps.items()}
    odds = near_dedup.near_groups(odd).collect()
    assert len(odds) == odd.count() and all(r.fingerprint == f"{plain_fingerprint('one'):016x}" for r in odds if r.doc_id == 3)
    assert sum(r.kept for r in odds) == len({r.component_id for r in odds})
    assert near_dedup.near_groups(none).count() == 0
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in odds)


@pytest.mark.parametrize("max_bucket", [8192, 20])
def test_near_links_of_clusters(spark, max_bucket):
    """Buckets over the limit are dealt again without losing a link."""
    rng, points = random.Random(5), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(50):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points)
    table = materialize(spark.createDataFrame([(near_dedup.signed(x),) for x in points], "fp long"), "points")
    root = {near_dedup.signed(x): near_dedup.signed(x) for x in points}
    root |= {r.a: r.b for r in components(materialize(near_dedup.near_links(table, max_bucket), "links")).collect()}
    want, mine, brute = brute_components(range(len(points)), points), defaultdict(set), defaultdict(set)
    for k, x in enumerate(points):
        mine[root[near_dedup.signed(x)]].add(k)
        brute[want[k]].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_tree_links_are_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(60)]]))
    i, j = near_dedup.tree_links(x)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a] ^ x[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(5, 5), (7, 6)]
    got = {r.a: r.b for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 for i in range(300) if i % 100}


# ---- 8


def test_language_id(docs, odd, none, spark):
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model, keep=("lang",)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    flags = {r.doc_id: r.h for r in docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(flags[r.doc_id] == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    odds = language_id.identify(odd, language_id.fit(odd)).collect()
    assert len(odds) == odd.count() and all(0 <= r.score <= 1 for r in odds)
    assert {r.lang_pred for r in odds if r.doc_id in (0, 1, 2, 8)} == {"und"} and all(r.lang_pred != "und" for r in odds if r.doc_id in (3, 4, 9))
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identified(odd).columns == odd.columns


def plain_language(rows, dim=language_id.DIM):
    """doc_id -> (language, score) by plain Python: trigrams one by one, cosines one by one."""
    p, vectors = language_id.Profiles(dim), {}

    def vector(text):
        out, letters = np.zeros(dim), [0]
        for ch in text or "":
            low = ch.lower() if len(ch.lower()) == 1 else ch
            if ch.isalpha():
                letters.append(ord(low))
            elif letters[-1]:
                letters.append(0)
        letters = letters if letters[-1] == 0 else [*letters, 0]
        for gram, n in Counter(zip(letters, letters[1:], letters[2:], strict=False)).items():
            for c in gram:
                if c not in vectors:
                    vectors[c] = p.letter_vectors(np.array([c], np.uint64))[0].astype(float)
            out += n * np.roll(vectors[gram[0]], 2) * np.roll(vectors[gram[1]], 1) * vectors[gram[2]]
        return out / (np.linalg.norm(out) or 1)

    every = [(r.doc_id, r.lang, r.text, vector(r.text)) for r in rows]
    prototypes: dict = {}
    for i, lang, text, v in every:
        if lang is not None and text is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5:
            prototypes[lang] = prototypes.get(lang, 0) + v
    names = sorted(k for k, v in prototypes.items() if v.any())
    out = []
    for i, _, text, v in every:
        cosines = [float(v @ prototypes[k] / np.linalg.norm(prototypes[k])) for k in names]
        known = any(c.isalpha() for c in text or "")
        out.append((i, names[int(np.argmax(cosines))] if known else "und", max(0.0, max(cosines)) if known else 0.0))
    return out


def test_language_id_against_plain_python(docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "lang", "text").collect()
        got = sorted(language_id.identify(df, language_id.fit(df)).collect(), key=str)
        want = plain_language(rows)
        assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter((i, k) for i, k, _ in want)
        assert np.allclose(sorted(r.score for r in got), sorted(s for *_, s in want), atol=1e-4)


def test_many_languages_are_no_error(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(3)), f"l{i % 2500}") for i in range(6000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dim=64)
    assert 2400 < len(model) <= 2500


def test_null_languages_are_filled(odd):
    want = {r.doc_id: r.lang_pred for r in language_id.identify(odd, language_id.fit(odd)).collect()}
    nulls = {r.doc_id for r in odd.where("lang is null").collect()}
    for r in language_id.identified(odd).collect():
        assert r.lang is not None and (r.doc_id not in nulls or r.lang == want[r.doc_id])


def test_bundles_are_sums_of_bound_trigrams():
    p = language_id.Profiles(128, 3)
    text = "Ab, cab! ab"
    got, has = p.encode([text, None, "12"])
    letters = [0, *[ord(c) for c in "ab"], 0, *[ord(c) for c in "cab"], 0, *[ord(c) for c in "ab"], 0]
    v = {c: p.letter_vectors(np.array([c], np.uint64))[0].astype(int) for c in set(letters)}
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))
    assert (got[0] == want).all() and has.tolist() == [True, False, False] and not got[1:].any()
    long = "abc déf " * 1000
    small = language_id.BLOCK_CHARS
    language_id.BLOCK_CHARS = 100
    try:
        assert (p.encode([long])[0] == language_id.Profiles(128, 3).encode([long])[0]).all()
    finally:
        language_id.BLOCK_CHARS = small


# ---- 9


def brute_windows(texts, window=substring_dedup.WINDOW):
    """(n_words, n_removed, kept_sha256) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for ws in words:
        for i in range(len(ws) - window + 1):
            seen[tuple(ws[i : i + window])] = seen.get(tuple(ws[i : i + window]), 0) + 1
    out = []
    for ws in words:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out



def test_substring_dedup(spark, docs, odd, none):
    rng = random.Random(3)
    loops = [(i, " ".join(rng.choice("ab") if i % 2 else "a" for _ in range(rng.randint(0, 200)))) for i in range(60)] + [(900 + k, "z " * k) for k in (34, 35, 36)]
    for df in (docs.select("doc_id", "text"), odd, spark.createDataFrame(loops, "doc_id long, text string")):
        rows = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_windows([r.text for r in rows]), strict=True))
        got = substring_dedup.substring_dedup(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(none).count() == 0
