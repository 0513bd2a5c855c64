"""Mixing sources to target weights, with DataFrame functions only.

A document's size is its number of words. Sources, by code point with null last, have the weights 5, 2 and 1 in turn and share
``share`` times the size of all documents by weight; a target stops at ``cap`` times its source's size, and what is left over
is shared again by weight among the other sources until none is above.

Documents get hash-random keys. Within a source they are range-sorted by key, prefix sums of their sizes are taken in
buckets of the key's range, and the source is cut at its exact budget: whole epochs of all its documents, then the documents in key
order up to the rest, the last of them in part (:func:`mix`) or by the nearer end (:func:`sample`).

Null or wordless texts have size 0 and are taken 0 words. A null source is a source of its own. Keys come from doc_id and text, so rows of
a null or repeated doc_id are spread over the buckets by their texts; rows that are the same in both are one row with a number of copies
until they are cut, copy by copy. Other columns are ignored by :func:`mix` and kept by :func:`sample`, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, scratch, spare_name
from .ranks import BUCKET_ROWS, digest_key, key_bucket, prefix_sums

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources (source, rows, source_size) with weight and target.

    Sources are numbered by a distributed sort; the shared level is found by sums over the sources' table, a few rounds.
    """
    numbered = scratch(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    parts = numbered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each sorted partition
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    known = scratch(numbered.join(parts, F.shiftright("_at", 33) == F.col("_part")).select("source", "rows", "source_size", weight.cast("double").alias("weight")), "mix-weights")
    whole = known.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total, level, full = share * (whole["n"] or 0), 0.0, -1
    if whole["w"]:
        level = total / whole["w"]
    while True:
        at_cap = cap * F.col("source_size") <= F.lit(level) * F.col("weight")
        s = known.agg(F.count_if(at_cap).alias("full"), F.sum(F.when(at_cap, cap * F.col("source_size"))).alias("size"), F.sum(F.when(~at_cap, F.col("weight"))).alias("w")).first()
        if s["full"] == full or not s["w"]:
            break
        full, level = s["full"], (total - (s["size"] or 0)) / s["w"]
    return known.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.lit(level) * F.col("weight")))


def _size() -> F.Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: int) -> F.Column:
    return digest_key(F.col("doc_id").cast("long"), F.lit(seed), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _placed(docs: DataFrame, seed: int, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """doc_id, source, key, size, copies, source_size, target, before (words of the source before the first copy), epochs (whole ones), left (words beyond these)."""
    every = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), _size().alias("size"), _key(seed).alias("key"))
    rows = scratch(every.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "mix-rows").withColumn("words", F.col("size") * F.col("copies"))
    by = targets(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("words").alias("source_size")), weights, share, cap)
    by = scratch(by.select(F.col("source").alias("_source"), "rows", "source_size", "target"), "mix-targets")
    most = by.agg(F.max("rows")).first()[0] or 0
    known = rows.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    known = known.withColumn("_bucket", key_bucket(F.col("key"), F.ceil(F.col("rows") / BUCKET_ROWS))).drop("rows")
    placed = prefix_sums(known, "source", "_bucket", ["key", "doc_id", "size"], "words", most // BUCKET_ROWS + 1, "before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    return placed.withColumns({"epochs": epochs, "left": left}).drop("words", "_bucket")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken of every row; the last document of a source is taken in part."""
    each = _placed(docs, seed, weights, share, cap).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    left = F.col("left") - F.col("before") - F.col("_copy") * F.col("size")
    extra = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return each.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def sample(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, small: int = 4096) -> DataFrame:
    """The mixed corpus: rows of docs, all columns, as often as the mix takes them (whole documents, key order).

    A source's cut is one key and a number of its copies: rows before it get one epoch more. So documents meet a row a source and
    their texts aren't shuffled while there are at most ``small`` sources; with more, the join is left to the optimiser. Only
    where a cut falls between copies are the rows of that key numbered.
    """
    placed = _placed(docs, seed, weights, share, cap).where("size > 0")
    # a copy goes in if the middle of it lies within what is left: that holds for the first so many
    more = F.least(F.col("copies"), F.greatest(F.lit(0), F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5))).cast("long")
    by = placed.select("source", "epochs", "key", "copies", more.alias("more")).groupBy("source")
    last = F.max(F.when(F.col("more") > 0, F.struct("key", "more", "copies")))
    names = {x: spare_name(docs, f"_{x}") for x in ("source", "none", "epochs", "cut", "more", "copies", "key", "n", "at", "copy")}
    source, none = F.col("source").cast("string"), F.col("source").isNull()
    cuts = by.agg(F.max("epochs").alias("epochs"), last.alias("last")).select(
        F.coalesce("source", F.lit("")).alias(names["source"]), none.alias(names["none"]), F.col("epochs").alias(names["epochs"]), F.col("last.key").alias(names["cut"]), F.col("last.more").alias(names["more"]), F.col("last.copies").alias(names["copies"])
    )
    cuts = scratch(cuts, "mix-cuts")
    col = lambda x: F.col(names[x])
    between = bool(cuts.where(col("more") < col("copies")).head(1))
    keyed = docs.withColumns({names["source"]: F.coalesce(source, F.lit("")), names["none"]: none, names["key"]: _key(seed), names["n"]: _size()}).where(col("n") > 0)
    joined = keyed.join(F.broadcast(cuts) if cuts.count() <= small else cuts, [names["source"], names["none"]])
    at_cut = col("key").eqNullSafe(col("cut")) & (col("more") < col("copies"))
    extra = F.when(col("key") <= col("cut"), 1).otherwise(0)
    rows = joined.withColumn(names["at"], extra)
    if between:
        number = F.row_number().over(Window.partitionBy(names["source"], names["none"], names["key"]).orderBy(names["key"]))
        split = joined.where(at_cut).withColumn(names["at"], F.when(number <= col("more"), 1).otherwise(0))
        rows = rows.where(~F.coalesce(at_cut, F.lit(False))).unionByName(split)
    return rows.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), (col("epochs") + col("at")).cast("int")))).select(docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), ''), '0', md5(coalesce(text, '')))) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, source) AS k, CAST(1.5 AS DOUBLE) * sum(n) OVER () AS t, sum(w) OVER () AS ws,
    sum(2 * n) OVER (ORDER BY 2 * n / w, source ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (ORDER BY 2 * n / w, source ROWS UNBOUNDED PRECEDING) AS cw FROM s),
l AS (SELECT CASE WHEN t / ws * min_w < min_n THEN t / ws END AS lvl FROM (SELECT any_value(t) AS t, any_value(ws) AS ws, min(2 * n / w) AS min_n, 1 AS min_w FROM r)),
m AS (SELECT coalesce((SELECT lvl FROM l), (SELECT arg_min(x, k) FROM (SELECT CAST(t - c AS DOUBLE) / nullif(ws - cw, 0) AS x, k, lead(2 * n / w) OVER (ORDER BY k) AS nxt FROM r) WHERE x < nxt),
  (SELECT max(2 * n / w) FROM s)) AS lvl),
g AS (SELECT source, CAST(n AS BIGINT) AS n, least(CAST(2 * n AS DOUBLE), lvl * w) AS target FROM s, m),
e AS (SELECT d.*, g.n AS source_size, g.target, CASE WHEN g.n > 0 THEN floor(g.target / g.n) ELSE 0 END AS e FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
SELECT doc_id, size, source_size, target, CAST(e * size + greatest(0, least(floor(target - e * source_size) - b, size)) AS BIGINT) AS taken FROM p
"""
