"""Operator 1 does the whole job: a probability for every word, and every position trains."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from folioframe.llm import lm_scoring
from folioframe.llm.common import materialize


def hashed(words):
    return lm_scoring.words_in(pa.array([" ".join(words)]))[0]


def test_words_with_a_shared_id_have_their_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "known_words", lambda n: 65)
    texts = [" ".join(f"w{k}" for k in range(400) for _ in range(k % 7 + 1)), "w3 w3 w399 zz", "", None, " ".join(f"w{k % 50}" for k in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = materialize(lm_scoring.word_counts(docs), "counts")
    known, by_id = lm_scoring.vocabulary(counts)
    assert len(known) == 65 and len(by_id) == 65 + lm_scoring.HASHED
    ids = materialize(lm_scoring.to_ids(docs, known, len(by_id)), "ids")
    net = lm_scoring.Net.initial(by_id)
    plain = {r.doc_id: r for r in lm_scoring.scored(ids, net).collect()}
    whole = {r.doc_id: r for r in lm_scoring.scored(ids, net, lm_scoring.shares(ids, counts, by_id)).collect()}
    n = Counter(w for t in texts for w in (t or "").split())
    own = set(known.view(np.uint64).tolist())
    of, far, shared = {}, set(), Counter()
    for w, h in zip(n, hashed(n).tolist(), strict=True):
        of[w] = (h >> 20) % lm_scoring.HASHED
        if h not in own:
            far.add(w)
            shared[of[w]] += n[w]
    for i, t in enumerate(texts):
        want = plain[i].log_likelihood + sum(math.log(n[w] / (shared[of[w]] + 1)) for w in (t or "").split() if w in far)
        assert abs(whole[i].log_likelihood - want) < 1e-6 and whole[i].n_words == len((t or "").split())


def test_known_words_grow_with_the_corpus():
    known = [lm_scoring.known_words(n) for n in (0, 1 << 22, 1 << 26, 1 << 32)]
    assert known[0] == known[1] == lm_scoring.KNOWN and known[1] < known[2] < known[3]


def test_every_position_trains_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 40))) for i in range(300)], "doc_id long, text string").repartition(3)
    counts = materialize(lm_scoring.word_counts(docs), "counts")
    known, by_id = lm_scoring.vocabulary(counts)
    ids = materialize(lm_scoring.to_ids(docs, known, len(by_id)), "ids")
    net = lm_scoring.Net.initial(by_id)
    for rounds in (1, lm_scoring.ROUNDS, 7):
        rows = [r.row for turn in range(rounds) for r in lm_scoring.share_of(ids, turn, rounds).collect()]
        assert sorted(rows) == sorted(r.row for r in ids.collect())
        seen = sum(lm_scoring.trained(ids, net.flat, net.tree, turn, rounds).where("slice = 0").agg({"weight": "sum"}).first()[0] or 0 for turn in range(rounds))
        assert seen == by_id.sum()


def test_models_are_bound_by_positions_not_by_partitions(spark):
    docs = spark.createDataFrame([(i, f"a b w{i % 5}") for i in range(300)], "doc_id long, text string").repartition(211)
    counts = materialize(lm_scoring.word_counts(docs), "counts")
    known, by_id = lm_scoring.vocabulary(counts)
    ids = materialize(lm_scoring.to_ids(docs, known, len(by_id)), "ids")
    net = lm_scoring.Net.initial(by_id)
    assert lm_scoring.trainers(int(by_id.sum()), len(by_id), 3) == 1
    assert lm_scoring.trained(ids, net.flat, net.tree, 0).count() == lm_scoring.SLICES
    for words in (10**8, 10**12):
        v = lm_scoring.known_words(words) + lm_scoring.HASHED
        width = np.dtype(lm_scoring.id_type(v)).itemsize
        assert lm_scoring.trainers(words, v, 3) * lm_scoring.length(v) * 4 <= words / 3 * width
