"""Quality rules with host verdicts.

Every whole text gets its counts and is held against five rules (:data:`RULES`); the first two are base rules, which no host
overrules. Failures of each rule are summed by host (column ``source``). A host's failure rate of a rule is shrunk with a beta prior
whose mean and strength come from all hosts by the method of moments, and its posterior decides:

* ``rejected``: the rate is significantly above the prior's mean (lower bound, ``Z`` standard deviations) and over ``max_rate``. All
  documents of the host go.
* ``trusted``: the rate is significantly below the prior's mean. Documents of the host that fail this rule stay; on such a host a failure is
  more likely a matter of form.
* else documents that fail the rule go.

Host verdicts are joined back to the documents. Null, empty or wordless texts have zero counts and fail (fewer than ``min_words``). A null source is a host of its own.
Repeated rows are kept and counted, other columns ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read_table, scratch, spare_name
from .textvec import Words, binary, mix, shingle_hashes, steps, windows

MIN_WORDS = 50
MAX_RATE = 0.5
Z = 1.645
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Name and condition of failure, in SQL of Spark and DuckDB. The first BASE are base rules.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE = 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def count_rows(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text raw[off[i]:off[i+1]]."""
    w = Words(raw, off)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[w.start] += 1  # a word may start where the row before ends with one
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    at, row = windows(w.first, 3)
    covered = np.zeros(len(w.start), bool)
    if len(at):
        h = shingle_hashes(w.hashes(None), 3)[at]
        key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    text, duplicate, n_lines = raw.tobytes(), np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        lines = [x for x in text[a:b].split(b"\n") if x.strip()]
        n_lines[i], duplicate[i] = len(lines), len(lines) - len(set(lines))
    return [np.diff(w.first), _sums(inside & ((raw & 0xC0) != 0x80), off), _sums(_SYMBOL[raw], off), duplicate, _sums(covered, w.first), n_lines]


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = binary(b.column(2))
            parts = [count_rows(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in steps(off)]
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.record_batch([b.column(0), b.column(1), *map(pa.array, cols)], names=["doc_id", "source", *COUNTS])

    source = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return map_arrow(source, run, "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def posteriors(rows: DataFrame, rules: list[str], max_rate: float = MAX_RATE, z: float = Z) -> DataFrame:
    """host (source), n and for each rule (a boolean column of rows) rate (shrunk), trusted, rejected as structs named by the rule."""
    sums = rows.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(r) for r in rules])
    hosts = scratch(sums, "quality-hosts")
    cells = [x for r in rules for x in (F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq"))]
    s = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), *cells).first()
    n, out = s["n"] or 1, []
    for r in rules:
        mean = (s[r] or 0) / n
        noise = mean * (1 - mean)
        spread = (s[f"{r}_sq"] or 0.0) / n - mean * mean - noise * (s["hosts"] or 0) / n
        strength = min(max(noise / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        rate = (F.col(r) + mean * strength) / (F.col("n") + strength)
        margin = z * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        out.append(F.struct(rate.alias("rate"), (rate + margin < mean).alias("trusted"), ((rate - margin > mean) & (rate > max_rate)).alias("rejected")).alias(r))
    return hosts.select("host", "n", *out)


def judge(rows: DataFrame, rules: list[str], max_rate: float = MAX_RATE, z: float = Z) -> DataFrame:
    """rows (a written table) with host_rejected and host_rule_failed: a rule failed that the host isn't trusted with.

    The hosts' table is written before the join, so a host with very many rows is split by the skew-join rule.
    """
    verdicts = posteriors(rows, rules, max_rate, z)
    rejected = F.greatest(*[F.col(r)["rejected"] for r in rules], F.lit(False))
    host, null = spare_name(rows, "_host"), spare_name(rows, "_no_host")
    key = lambda c: {host: F.coalesce(c, F.lit("")), null: c.isNull()}
    own = verdicts.withColumns(key(F.col("host"))).select(host, null, rejected.alias("host_rejected"), *[F.col(r)["trusted"].alias(f"_trusted_{r}") for r in rules])
    failed = F.greatest(*[F.col(r) & ~F.col(f"_trusted_{r}") for r in rules], F.lit(False))
    joined = rows.withColumns(key(F.col("source"))).join(scratch(own, "quality-verdicts"), [host, null])
    return joined.withColumn("host_rule_failed", failed).drop(host, null, *[f"_trusted_{r}" for r in rules])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, source, COUNTS, a column for each rule (failed), base_failed, host_rejected, host_rule_failed, kept."""
    rules = list(RULES)
    rows = counts(docs).withColumns({r: F.expr(x) for r, x in RULES.items()})
    base = rows.withColumn("base_failed", F.greatest(*[F.col(r) for r in rules[:BASE]]))
    judged = judge(scratch(base, "quality"), rules)
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & ~F.col("host_rule_failed")
    return judged.select("doc_id", "source", *COUNTS, *rules, "base_failed", "host_rejected", "host_rule_failed", kept.alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


_ROWS = ", ".join(f"count(*) FILTER ({x})" for x in RULES.values())
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i + 1], w[i + 2], w[i + 3]) AS n FROM p),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, d.doc_id, d.source, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup.lines, 0) AS BIGINT) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
h AS (SELECT source, n, unnest(range({len(RULES)})) AS rule, unnest(f) AS f FROM (SELECT source, count(*) AS n, [{_ROWS}] AS f FROM c GROUP BY source)),
s AS (SELECT rule, count(*) AS hosts, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) AS ff FROM h GROUP BY rule),
t AS (SELECT rule, mean, mean * (1 - mean) AS noise, ff / n - mean * mean - mean * (1 - mean) * hosts / n AS spread FROM s),
u AS (SELECT rule, mean, CASE WHEN spread > 0 THEN least(greatest(noise / spread - 1, 1), 1e6) ELSE 1e6 END AS strength FROM t),
q AS (SELECT source, rule, mean, n + strength AS m, (f + mean * strength) / (n + strength) AS rate FROM h JOIN u USING (rule)),
v AS (SELECT source, rule, rate + {Z} * sqrt(rate * (1 - rate) / (m + 1)) < mean AS trusted, rate - {Z} * sqrt(rate * (1 - rate) / (m + 1)) > mean AND rate > {MAX_RATE} AS rejected FROM q),
o AS (SELECT source, bool_or(rejected) AS rejected, list(trusted ORDER BY rule) AS trusted FROM v GROUP BY source),
b AS (SELECT *, [{", ".join(f"coalesce({x}, false)" for x in RULES.values())}] AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed[1] OR failed[2] AS base_failed,
  NOT (failed[1] OR failed[2] OR rejected OR {" OR ".join(f"(failed[{k}] AND NOT trusted[{k}])" for k in range(1, len(RULES) + 1))}) AS kept
FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source
"""
