"""Growth joins: embeddings of patterns against the arcs.

Embeddings are rows (pattern int, v0, v1, ... long): v_i is the image of pattern vertex i, null where a pattern has fewer
vertices. Columns instead of an array keep the joins inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dfscode


def width(embeddings: DataFrame) -> int:
    return sum(c[0] == "v" and c[1:].isdigit() for c in embeddings.columns)


def image(of: Column, n: int) -> Column:
    """v_of for a column of pattern vertices."""
    return reduce(lambda rest, i: F.when(of == i, F.col(f"v{i}")).otherwise(rest), range(n), F.lit(None).cast("long"))


def unused(dst: Column, n: int) -> Column:
    """dst is no image yet."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"v{i}") != dst, F.lit(True)) for i in range(n)])


def forward_roots(arcs: DataFrame) -> DataFrame:
    """Arcs from the end with the smaller label; both of them where labels are equal."""
    return arcs.where("src_label <= dst_label")


def by_src(arcs: DataFrame, parts: int) -> DataFrame:
    """Arcs as :func:`grow` joins them, hashed by src alone: kept like this, they aren't shuffled again at any level."""
    return arcs.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("elabel").alias("edge_label"), F.col("dst_label").alias("to_label")).repartition(parts, "_src")


def grow(embeddings: DataFrame, arcs: DataFrame, positions: DataFrame, steps: DataFrame) -> DataFrame:
    """Embeddings of the patterns that steps make of others.

    arcs: of :func:`by_src`. positions: pattern, i (a vertex that it grows at), nodes (its number of vertices). steps: pattern, child, i, j,
    edge_label, to_label, a row a candidate. An embedding meets the arcs of a position's image once, whatever the number of candidates
    there; j is the vertex whose image the arc leads to, or the next one. Candidates are looked up after that.
    """
    n = width(embeddings)
    placed = embeddings.join(positions, "pattern").withColumn("_src", image(F.col("i"), n)).join(arcs, "_src")
    met = reduce(lambda rest, k: F.when(F.col(f"v{k}") == F.col("_dst"), F.lit(k)).otherwise(rest), range(n), F.col("nodes"))
    chosen = placed.withColumn("j", met).join(steps, ["pattern", "i", "j", "edge_label", "to_label"])
    new = F.col("j") == F.col("nodes")
    cells = [F.when(new & (F.col("j") == k), F.col("_dst")).otherwise(F.col(f"v{k}")).alias(f"v{k}") for k in range(n)]
    return chosen.select(F.col("child").alias("pattern"), *cells, F.when(new & (F.col("j") == n), F.col("_dst")).alias(f"v{n}"))


def growth_bound(embeddings: DataFrame, arcs: DataFrame, positions: DataFrame, steps: DataFrame) -> int:
    """Rows that :func:`grow` makes at most, from the degrees by labels, without making them."""
    degrees = arcs.groupBy("_src", "edge_label", "to_label").agg(F.count(F.lit(1)).alias("_n"))
    images = embeddings.join(positions, "pattern").select("pattern", "i", image(F.col("i"), width(embeddings)).alias("_src")).groupBy("pattern", "i", "_src").agg(F.count(F.lit(1)).alias("_m"))
    return images.join(steps, ["pattern", "i"]).join(degrees, ["_src", "edge_label", "to_label"]).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0


def pure_forward(embeddings: DataFrame, arcs: DataFrame, code: dfscode.Code) -> DataFrame:
    """Arcs from the rightmost image to unused vertices whose label isn't below the root's: v*, dst, elabel, dst_label."""
    n, last, least = width(embeddings), dfscode.rightmost_vertices(code)[0], dfscode.labels(code)[0]
    return embeddings.join(arcs, F.col(f"v{last}") == F.col("src")).where((F.col("dst_label") >= least) & unused(F.col("dst"), n)).select(*embeddings.columns, "dst", "elabel", "dst_label")


def path_forward(embeddings: DataFrame, arcs: DataFrame, code: dfscode.Code) -> DataFrame:
    """Arcs from the images on the rightmost path above the rightmost vertex that don't precede the path's edge there: i, dst, elabel, dst_label."""
    n, least, out = width(embeddings), dfscode.labels(code)[0], None
    for k in dfscode.rightmost_path(code):
        x, _, _, e, b = code[k]
        ok = (F.col("elabel") > e) | ((F.col("elabel") == e) & (F.col("dst_label") >= b))
        part = embeddings.join(arcs, F.col(f"v{x}") == F.col("src")).where((F.col("dst_label") >= least) & ok & unused(F.col("dst"), n))
        part = part.select(*embeddings.columns, F.lit(x).alias("i"), "dst", "elabel", "dst_label")
        out = part if out is None else out.unionByName(part)
    return out


def backward(embeddings: DataFrame, arcs: DataFrame, code: dfscode.Code) -> DataFrame:
    """Arcs from the rightmost image back to images on the rightmost path, not used yet: j, elabel."""
    have, path, out = dfscode.labels(code), dfscode.rightmost_path(code), None
    last = code[path[0]][1]
    used = {(min(i, j), max(i, j), e) for i, j, _, e, _ in code}
    for k in path[1:]:
        x, y, _, e, _ = code[k]
        ok = (F.col("elabel") > e) | ((F.col("elabel") == e) & F.lit(have[y] <= have[last]))
        taken = [lab for i, j, lab in used if (i, j) == (min(x, last), max(x, last))]
        part = embeddings.join(arcs, (F.col(f"v{last}") == F.col("src")) & (F.col(f"v{x}") == F.col("dst"))).where(ok & ~F.col("elabel").isin(taken))
        part = part.select(*embeddings.columns, F.lit(x).alias("j"), "elabel")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = embeddings.where("1 = 0").select("*", F.lit(0).alias("j"), F.lit(0).alias("elabel"))
    return out


def match(arcs: DataFrame, code: dfscode.Code) -> DataFrame:
    """All embeddings of one pattern: v0, v1, ... (a left-deep chain of joins, one for each edge of the code)."""
    out, n = None, 0
    for i, j, a, e, b in dfscode.with_labels(code):
        here = arcs.where((F.col("src_label") == a) & (F.col("elabel") == e) & (F.col("dst_label") == b)).select("src", "dst")
        if out is None:
            out, n = here.select(F.col("src").alias("v0"), F.col("dst").alias("v1")), 2
        elif i < j:
            out = out.join(here, F.col(f"v{i}") == F.col("src")).where(unused(F.col("dst"), n)).drop("src").withColumnRenamed("dst", f"v{n}")
            n += 1
        else:
            out = out.join(here, (F.col(f"v{i}") == F.col("src")) & (F.col(f"v{j}") == F.col("dst")), "left_semi")
    return out


def contains(arcs: DataFrame, code: dfscode.Code) -> bool:
    """Whether the graph holds the pattern at all."""
    return bool(match(arcs, code).limit(1).count())
