"""The pipeline's stages, each against plain Python on what the stage before kept."""

import re
from collections import Counter

import corpus_pipeline
from folioframe.llm import license_scan, registry  # noqa: F401
from folioframe.llm.common import materialize

from .test_models import brute_components, check_packing, plain_fingerprint
from .test_native import groups, water_level, words


def test_stages(spark, odd):
    docs, (language, exact, near, mix, pack) = odd, [f for _, f in corpus_pipeline.STAGES]
    one = materialize(language(spark, docs, ""), "one")
    rows = one.collect()
    assert one.columns == docs.columns
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    two = materialize(exact(spark, one, ""), "two")
    by = groups(rows)
    assert two.columns == docs.columns and two.count() == len(by)
    three = materialize(near(spark, two, ""), "three")
    ids = [(r.doc_id, plain_fingerprint(r.text)) for r in two.collect()]
    known = [(i if i is not None else 10**9, x) for i, x in ids]
    want = set(brute_components(*zip(*known, strict=True)).values())
    assert {r.doc_id if r.doc_id is not None else 10**9 for r in three.collect()} == want and three.count() == len(want)
    four = materialize(mix(spark, three, ""), "four")
    assert four.columns == docs.columns and max(Counter(r.doc_id for r in four.collect()).values()) <= 2
    before, after, largest = Counter(), Counter(), Counter()
    for r in three.collect():
        before[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    for r in four.collect():
        after[r.source] += len(words(r.text))
    target = water_level(before)
    assert all(abs(after[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in before)
    assert pack(spark, four, "").count() > 0
    check_packing(four)


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = materialize(apply(spark, docs, ""), name)
        assert docs.columns == none.columns and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_run(spark):
    """Whole: run gives what the stages give one after the other."""
    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = materialize(apply(spark, docs, d), name)
    want = Counter(r.doc_id for r in docs.collect())
    whole = Counter()
    for r in got:
        whole[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in whole} == set(want) and all(n == want[i] * size for (i, size), n in whole.items())


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
