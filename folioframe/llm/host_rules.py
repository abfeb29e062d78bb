"""Quality rules with verdicts on hosts (operator 5, native).

Each document is measured inside its row. Rule failures are summed by host, host rates are shrunk
towards the corpus by a beta prior fitted to the hosts (moments), and verdicts are joined back to
the measures. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, column, let, materialize, text_of, words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOLS, MAX_DUP_LINES = 0.1, 0.3
#: A host whose shrunk failure rate in one rule reaches this loses all its documents.
BAD_HOST = 0.8
RULES = ("short", "repeats", "symbols", "dup_lines")


def repeat_words(words: Column) -> Column:
    """How many words stand in 3-word windows that the text has twice or more.

    Windows are compared by XXH64 within one text (a 64-bit chance match inside one text is neglected).
    Sorted, equal windows are neighbours, so the work is n log n in the longest text.
    """
    starts = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def again(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"]))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(let(F.array_sort(starts), again), covered)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of each row's whole text."""
    text = text_of(text_col)
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(column(id_col).alias("doc_id"), column(host_col).cast("string").alias("host"), text.alias("text"), words_of(text).alias("words"))
    return split.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
    }


def prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """For each rule, alpha and beta of a beta distribution with the hosts' mean and their variance beyond chance. One row reaches the driver."""
    aggs = []
    for r in RULES:
        p = F.col(r) / F.col("n")
        aggs += [F.avg(p).alias(f"{r}_m"), F.var_pop(p).alias(f"{r}_v")]
    got = hosts.agg(F.avg(1 / F.col("n")).alias("inv"), *aggs).first()
    out = {}
    for r in RULES:
        m, v = got[f"{r}_m"], got[f"{r}_v"]
        if m is None:  # no host
            out[r] = (0.0, 1.0)
            continue
        m = min(max(m, 1e-6), 1 - 1e-6)
        between = max(v - m * (1 - m) * got["inv"], 1e-9)
        strength = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
        out[r] = (m * strength, (1 - m) * strength)
    return out


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", bad_host: float = BAD_HOST) -> DataFrame:
    """One row per input row: doc_id, host, the measures, base_failed, host_rate, kept.

    base_failed: under 50 words, or more than half the words in repeated 3-word windows. host_rate: the largest
    shrunk failure rate of the host over the rules. kept: neither base_failed nor of a host with host_rate >=
    bad_host. A null text has no words (and fails); a null host is no host, so its rows stand on their own
    (host_rate null). Repeated rows count and return as often as they stand. An empty table gives an empty result.
    """
    measured = materialize(measure(docs, id_col, text_col, host_col), "measures")
    fails = failures()
    hosts = materialize(measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(fails[r]).alias(r) for r in RULES]), "hosts")
    shrunk = [(F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in prior(hosts).items()]
    verdict = hosts.select("host", F.greatest(*shrunk).alias("host_rate"))
    base = fails["short"] | fails["repeats"]
    return measured.join(verdict, "host", "left").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "host_rate",
        (~base & (F.coalesce(F.col("host_rate"), F.lit(0.0)) < bad_host)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return host_rules(docs).drop("host", "host_rate")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS again FROM g),
v AS (SELECT r, i, coalesce(again, false) OR coalesce(lag(again, 1) OVER p, false) OR coalesce(lag(again, 2) OVER p, false) AS hit FROM c WINDOW p AS (PARTITION BY r ORDER BY i)),
rw AS (SELECT r, count(*) FILTER (WHERE hit) AS n_repeat_words FROM v GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN rw USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} AS f1, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS f2, n_symbols > {MAX_SYMBOLS} * word_chars AS f3, n_dup_lines > {MAX_DUP_LINES} * n_lines AS f4 FROM m),
h AS (SELECT source, k, count(*)::DOUBLE AS n, count(*) FILTER (WHERE x)::DOUBLE AS bad
      FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS x FROM f WHERE source IS NOT NULL) GROUP BY source, k),
q AS (SELECT k, least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) AS m, var_pop(bad / n) AS v, avg(1 / n) AS inv FROM h GROUP BY k),
s AS (SELECT k, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-9) - 1, 1), 1e6) AS strength FROM q),
e AS (SELECT source, max((bad + m * strength) / (n + strength)) AS rate FROM h JOIN s USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND coalesce(rate, 0) < {BAD_HOST} AS kept
FROM f LEFT JOIN e USING (source)
"""
