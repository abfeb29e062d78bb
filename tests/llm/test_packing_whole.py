"""Operator 3 does the whole job: all ids of a seed ask, and related documents meet wherever they stand in the input."""

import numpy as np

from folioframe.llm import packing
from folioframe.llm.common import materialize


def test_all_ids_of_a_seed_ask():
    idf = np.ones(1 << 16, np.float32)
    idf[100:] = 5
    seed = np.concatenate([np.arange(100, 160), np.arange(10)]).astype(np.uint16)  # 60 ids of large weight that nobody shares
    texts = [seed, np.arange(200, 230, dtype=np.uint16), np.arange(10, dtype=np.uint16)]
    assert packing.Shard(texts, idf, 40.0).neighbours(0, np.array([True, False, False])) == [2]
    assert packing.retrieval_order(texts, idf, 40.0, 4096) == [0, 2, 1]


def test_related_documents_meet_wherever_they_stand(spark):
    rng, schema = np.random.default_rng(4), "doc_id long, ids binary"
    rows = [(k, np.append(rng.integers(300 * (k % 6) + 10, 300 * (k % 6) + 310, 120), 2).astype(np.uint16).tobytes()) for k in range(600)]
    ids = materialize(spark.createDataFrame(rows, schema).repartition(5), "ids")
    statistics = packing.corpus_statistics(ids)
    dealt = packing.deal(ids, statistics)
    runs = [r.doc_id for r in dealt.collect()]
    assert sorted(runs) == list(range(600))
    assert sum(a % 6 == b % 6 for a, b in zip(runs, runs[1:], strict=False)) > 480  # 100 by chance
