"""Operators 2, 5, 6 and 10 against plain Python, and on odd input."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioframe.llm import exact_dedup, host_rules, license_scan, mixing


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[plain(r.text)].append(r)
    return by


def check_exact(df):
    rows, got = df.select("doc_id", "text").collect(), exact_dedup.exact_groups(df).collect()
    by = groups(rows)
    assert len(got) == len(rows)
    want = Counter()
    for members in by.values():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
        want.update((m.doc_id, keep, len(members)) for m in members)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(by)


def test_exact_dedup(docs, odd, none):
    check_exact(docs)
    check_exact(odd)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups(odd.select("doc_id", "text").collect()))


def test_any_number_of_collisions_is_resolved(spark):
    """Each chunk collides with another one; recipes tell them apart."""
    texts = [("ba" if k % 2 else "da") * (300 + k // 2) for k in range(40)]
    df = spark.createDataFrame([(i, t + " " * (i % 3)) for i, t in enumerate(texts + texts)], "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_groups(df, identifier=lambda c: F.length(c).cast("long")).collect()
    assert {(r.doc_id, r.group_size) for r in got} == {(i, 2) for i in range(80)} and all(r.keep_id % 40 == r.doc_id % 40 for r in got)


def test_exact_dedup_with_colliding_identifiers(docs):
    """A bad identifier function (64 values) must not join different texts."""
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(64))
    a = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, identifier=weak).collect()}
    assert a == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}


def test_chunks_are_the_text(docs):
    rows = docs.select("text", exact_dedup.chunks_of(exact_dedup.normalized(F.col("text"))).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == plain(r.text)
        assert all(len(c) <= exact_dedup.MAX_CHUNK for c in r.c)


def brute_license(text, df, n):
    """Every column of one text by trying every alignment: a template counts where two words agree that are among the file's
    rarest, its key phrase's two rarest or a base phrase's, and the key phrase stands there. df, n: document frequencies."""
    index = license_scan.Index()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    rank = sorted(index.lexicon, key=lambda w: (-math.log((n + 1) / (df[w] + 1)), w))
    have, places = set(ws), []
    look = {w for w in rank if w in have}
    look = set([w for w in rank if w in have][: license_scan.RARE]) | (have & set(index.base_words))
    for key in index.keys:
        if set(key) <= have:
            look |= set(sorted(set(key), key=rank.index)[:2])
    for (_, _, label, is_base), words_, key, at in zip(index.rows, index.words, index.keys, index.at, strict=True):
        for d in range(-len(words_), len(ws)):
            stands = d + at >= 0 and ws[d + at : d + at + len(key)] == key
            met = sum(0 <= d + j < len(ws) and ws[d + j] == w and w in look for j, w in enumerate(words_))
            if stands and met >= (len(words_) if is_base else 2):
                share = sum(0 <= d + j < len(ws) and ws[d + j] == w for j, w in enumerate(words_)) / len(words_)
                places.append((label, d + at, is_base, share))
    own = [p for p in places if p[2]]
    starts = [p[1] for p in own]
    names = lambda ps: ",".join(sorted({p[0] for p in ps}))
    return len(ws), len(own), min(starts, default=None), max(starts, default=None), names(own), names(places), round(max([p[3] for p in places], default=0.0), 9)


def check_license(df):
    got = license_scan.license_scan(df).collect()
    rows = df.select("doc_id", "text").collect()
    seen = Counter()
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        seen.update(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)))
    want = Counter((r.doc_id, *brute_license(r.text, seen, len(rows))) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got) == want
    return got


def test_license_scan(spark, docs, odd, none):
    check_license(docs)
    check_license(odd)
    assert license_scan.license_scan(none).count() == 0
    texts = [
        "The MIT License, mit  LICENSE and Apache\nLicense; general public licenses", "GNU General Public License, version 3", "license mit", "Licensed under CC BY-NC 4.0.", "MITK license mit-license", "x " * 70_000 + "mit license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "mit license " * 300, "gnu general public license version 2 apache license version 2.0 mozilla public license eclipse public license cc by sa",
    ]
    got = {r.doc_id: r for r in check_license(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    assert got[1].labels == "gpl,gpl-3" and got[3].labels == "cc-by-nc" and got[6].labels == "bsd" and got[2].labels == ""
    assert {"gpl-2", "apache-2.0"} <= set(got[8].labels.split(","))


def measures(text):
    ws, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_host_rules(docs, odd, none):
    for df in (docs, odd):
        got = host_rules.host_rules(df).collect()
        want = Counter((r.doc_id, *measures(r.text)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept) and (r.host is not None or r.host_rate is None)
    assert host_rules.host_rules(none).count() == 0


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "buy now"
    rows = [(i, good if i % 10 else bad, "clean") for i in range(200)] + [(1000 + i, bad if i % 50 else good, "spam") for i in range(200)] + [(3000, good, "spam2")]
    got = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].kept and not got[0].kept and got[3000].kept
    assert not got[1000].base_failed and not got[1000].kept  # a good text of a bad host


def test_a_fold_keeps_mass_and_expectations(spark):
    """Every unit but one comes out whole, a fold's words stay the same, and over many folds each unit goes up as often as its share says."""
    import random

    rng = random.Random(4)
    units = [[(rng.randint(1, 50), rng.random() * 0.98 + 0.01) for _ in range(k % 9 + 1)] for k in range(9)]
    rows = [(b, f"{b}-{turn}", [("s", str(i), size, 1, hash((b, turn, i)) % (1 << 62), x) for i, (size, x) in enumerate(own)]) for b, own in enumerate(units) for turn in range(400)]
    df = spark.createDataFrame(rows, f"b int, turn string, block array<{mixing.STATE}>")
    ups, n = Counter(), Counter()
    for r in df.select("b", "block", mixing.pivot(F.col("block"), 0).alias("f")).collect():
        out = {u.unit.doc_id: float(u.up) for u in r.f.done} | {r.f.rest.doc_id: r.f.rest.x}
        assert len(out) == len(r.block) == len(r.f.done) + 1
        assert abs(sum(out[u.doc_id] * u.size for u in r.block) - sum(u.x * u.size for u in r.block)) < 1e-6
        for u in r.block:
            ups[r.b, u.doc_id] += out[u.doc_id]
            n[r.b, u.doc_id] += 1
    for (b, i), total in ups.items():
        assert abs(total / n[b, i] - units[b][int(i)][1]) < 0.12


def water_level(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, total, capped = {}, 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] >= 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, docs, odd, none):
    for df in (docs, odd):
        rows, got = df.select("doc_id", "text", "source").collect(), mixing.mix(df).collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(words(r.text))
        want, taken, largest = water_level(sizes), Counter(), Counter()
        assert Counter((r.doc_id, len(words(r.text))) for r in rows) == Counter((r.doc_id, r["size"]) for r in got)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
            assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    again = mixing.mix(docs.repartition(5))
    assert Counter((r.doc_id, r.copies) for r in again.collect()) == Counter((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mixing_of_a_hot_repeated_row(spark):
    rows = [(1, "a b c", "s")] * 500 + [(i, "a b " * (i % 7), "t") for i in range(2, 400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7


def test_mixing_is_fair(spark):
    """Documents of one source have the same chance, whatever their place in the fold."""
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    own = [r for r in got if r.source == "s1"]
    for part in range(4):
        share = [r.copies for r in own if r.doc_id % 8 // 2 == part]
        assert abs(sum(share) / len(share) - own[0].target / own[0].source_size) < 0.1
