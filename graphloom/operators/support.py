"""Minimum-image support: the smallest number of distinct images over a pattern's vertices; also by partition, with bounds.

Domains are long rows (pattern, pos, vid), never sets in a cell: distinct rows are combined before the shuffle and counted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extend import width


def images(embeddings: DataFrame, *keep: str) -> DataFrame:
    """keep, pattern, pos, vid of every image of every embedding."""
    cells = F.array(*[F.struct(F.lit(k).alias("pos"), F.col(f"v{k}").alias("vid")) for k in range(width(embeddings))])
    pattern = ["pattern"] if "pattern" in embeddings.columns else []
    return embeddings.select(*keep, *pattern, F.inline(cells)).where("vid is not null")


def domains(embeddings: DataFrame) -> DataFrame:
    return images(embeddings).distinct()


def domain_sizes(embeddings: DataFrame) -> DataFrame:
    """(pattern,) pos, size."""
    by = [c for c in ("pattern", "pos") if c == "pos" or c in embeddings.columns]
    return domains(embeddings).groupBy(*by).agg(F.count(F.lit(1)).alias("size"))


def support(embeddings: DataFrame) -> DataFrame:
    """(pattern,) support; no row for a pattern without embeddings."""
    by = ["pattern"] if "pattern" in embeddings.columns else []
    return domain_sizes(embeddings).groupBy(*by).agg(F.min("size").alias("support"))


def largest_domain(embeddings: DataFrame) -> DataFrame:
    by = ["pattern"] if "pattern" in embeddings.columns else []
    return domain_sizes(embeddings).groupBy(*by).agg(F.max("size").alias("support"), F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("sizes"))  # an entry a pattern vertex


def mean_domain_sizes(embeddings: DataFrame) -> DataFrame:
    return domain_sizes(embeddings).groupBy("pos").agg(F.avg("size").alias("mean_size"))


def local_images(embeddings: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct part_id, (pattern,) pos, vid, own: images of the embeddings whose root image a partition owns, and whether it owns them."""
    owner = vertices.select("vid", "part_id")
    rooted = embeddings.join(owner, F.col("v0") == F.col("vid")).drop("vid")
    seen = images(rooted, "part_id").distinct()
    return seen.join(owner.withColumnRenamed("part_id", "_owner"), "vid").withColumn("own", F.col("_owner") == F.col("part_id")).drop("_owner")


def local_supports(embeddings: DataFrame, vertices: DataFrame) -> DataFrame:
    """part_id, (pattern,) pos, size, internal (owned by the partition), external."""
    by = ["part_id", *(["pattern"] if "pattern" in embeddings.columns else []), "pos"]
    return local_images(embeddings, vertices).groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.count_if("own").alias("internal"), F.count_if(~F.col("own")).alias("external"))


def bounds(embeddings: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pattern,) lower, upper: sums over partitions of internal and of all images, the least over positions.

    A vertex is internal to one partition only, so lower <= support <= upper.
    """
    by = ["pattern"] if "pattern" in embeddings.columns else []
    sums = local_supports(embeddings, vertices).groupBy(*by, "pos").agg(F.sum("internal").alias("internal"), F.sum("size").alias("size"))
    return sums.groupBy(*by).agg(F.min("internal").alias("lower"), F.min("size").alias("upper"))


def decide(embeddings: DataFrame, vertices: DataFrame, minsup: int) -> DataFrame:
    """(pattern,) lower, upper, support, verdict: 'frequent' by the lower bound, 'infrequent' by the upper, else 'counted'."""
    both = bounds(embeddings, vertices)
    s = support(embeddings)
    joined = both.join(s, "pattern") if "pattern" in embeddings.columns else both.join(s, F.lit(True))
    return joined.withColumn("verdict", F.when(F.col("lower") >= minsup, "frequent").when(F.col("upper") < minsup, "infrequent").otherwise("counted"))


def possible_in_part(embeddings: DataFrame, vertices: DataFrame, minsup: int, parts: int) -> DataFrame:
    """Patterns that some partition's largest domain admits: size >= minsup over parts (whole division)."""
    by = ["pattern"] if "pattern" in embeddings.columns else []
    largest = local_supports(embeddings, vertices).groupBy("part_id", *by).agg(F.max("size").alias("largest"))
    return largest.where(F.col("largest") >= minsup // parts).groupBy(*by).agg(F.max("largest").alias("largest"))
