"""Queries over graphs of the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dfscode, scalars, udfs
from ..operators import extend, graph, partitioned, stars, support
from ..sources import readers, writers
from . import fixtures
from .miner import frequent_arcs, mine, single_edge_codes

PATH2 = ((0, 1, 0, 0, 1), (1, 2, 1, 0, 2))
PATH3 = (*PATH2, (2, 3, 2, 0, 3))
TRIANGLE = ((0, 1, 0, 0, 1), (1, 2, 1, 0, 2), (2, 0, 2, 1, 0))
STAR3 = ((0, 1, 0, 0, 1), (0, 2, 0, 0, 2), (0, 3, 0, 1, 3))
SQUARE = ((0, 1, 0, 0, 1), (1, 2, 1, 1, 2), (2, 3, 2, 0, 3), (3, 0, 3, 1, 0))
SHAPES = {"path2": PATH2, "path3": PATH3, "triangle": TRIANGLE, "star3": STAR3, "square": SQUARE}
PARTS = 4
BOUND = 8
TEXT_CODES = [dfscode.format_code(c) for c in SHAPES.values()]


def _arcs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return graph.arcs(*fixtures.graph(spark, sf_dir, name))


def _found(spark: SparkSession, sf_dir: str, code: dfscode.Code, name: str = "skip") -> DataFrame:
    return extend.match(_arcs(spark, sf_dir, name), code)


def minsup(spark: SparkSession, sf_dir: str, share: int) -> int:
    return max(2, spark.read.parquet(f"{sf_dir}/events.parquet").count() // share)


def pattern_key(code: dfscode.Code) -> str:
    """A name of paths, stars and triangles that SQL can make too."""
    lab, edges = dfscode.to_graph(code)
    near: dict[int, list[tuple[int, int]]] = {}
    for u, v, e in edges:
        near.setdefault(u, []).append((v, e))
        near.setdefault(v, []).append((u, e))
    join = lambda xs: "-".join(map(str, xs))
    if len(lab) == len(edges):
        out = []
        for a in range(3):
            for b in range(3):
                if a != b:
                    c = 3 - a - b
                    e = {frozenset((u, v)): x for u, v, x in edges}
                    out.append(join([lab[a], e[frozenset((a, b))], lab[b], e[frozenset((b, c))], lab[c], e[frozenset((c, a))]]))
        return "T:" + min(out)
    if max(map(len, near.values())) > 2:
        centre = next(v for v, n in near.items() if len(n) > 2)
        return f"S:{lab[centre]}|" + ",".join(sorted(f"{e}.{lab[v]}" for v, e in near[centre]))
    ends = [v for v, n in near.items() if len(n) == 1]
    names = []
    for at in ends:
        seen, walk = {at}, [lab[at]]
        while step := [(v, e) for v, e in near[at] if v not in seen]:
            at, e = step[0]
            seen.add(at)
            walk += [e, lab[at]]
        names.append(join(walk))
    return "P:" + min(names)


def _mined(spark: SparkSession, sf_dir: str, share: int, levels: int, only: int = 0, name: str = "skip") -> list[tuple[dfscode.Code, int]]:
    v, e = fixtures.graph(spark, sf_dir, name)
    return [(c, n) for c, n in mine(spark, v, e, minsup(spark, sf_dir, share), max_edges=levels).patterns if not only or len(c) == only]


def _patterns(spark: SparkSession, sf_dir: str, share: int, levels: int, only: int = 0, name: str = "skip") -> DataFrame:
    return spark.createDataFrame([(pattern_key(c), len(c), n) for c, n in _mined(spark, sf_dir, share, levels, only, name)], "pattern string, n_edges int, support long")


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_graphs"
    return f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"


def _with_labels(v: DataFrame, e: DataFrame) -> DataFrame:
    part = F.col("part_id") if "part_id" in v.columns else (F.col("vid") % PARTS).cast("int")
    ends = e.join(v.select(F.col("vid").alias("src"), F.col("label").alias("src_label"), part.alias("src_part")), "src")
    return ends.join(v.select(F.col("vid").alias("dst"), F.col("label").alias("dst_label")), "dst").select("src", "dst", "elabel", "src_label", "dst_label", "src_part")


def _written(spark: SparkSession, sf_dir: str, kind: str, path: str) -> dict:
    """Writes the graph; adj and txt in several files. The reader's further arguments."""
    v, e = fixtures.graph(spark, sf_dir, "skip", PARTS)
    if kind == "ladjp":
        writers.write_ladjp(v, e, path)
    elif kind == "txt":
        writers.write_txt(v, e, path)
    else:
        writers.write_adj(v, e, path)
        if kind == "adjp":
            v.orderBy("vid").select(F.col("part_id").cast("string").alias("value")).write.text(f"{path}-parts")
            return {"partition_path": f"{path}-parts"}
    return {}


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several part files, whatever the size
        try:
            extra = _written(spark, sf_dir, kind, path)
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        return _with_labels(*readers.read_graph(spark, f"-{kind}", path, **extra))

    return run


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A METIS graph and its partition file, converted to local files and read from these."""
    path = _folder(spark)
    extra = _written(spark, sf_dir, "adjp", path)
    writers.convert_to_partitions(spark, path, extra["partition_path"], f"{path}-local")
    return _with_labels(*readers.read_graph(spark, "ladjp", f"{path}-local"))


def _sunk(with_support: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines of the pattern file."""
        path = _folder(spark)
        v, e = fixtures.graph(spark, sf_dir, "skip")
        writers.FileSink(path, with_support).put(mine(spark, v, e, minsup(spark, sf_dir, 100), max_edges=2).frame(spark))
        return spark.read.text(path).select(F.col("value").alias("line"))

    return run


def _paths_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of two edges as pattern graphs, by the SQL function of the least code."""
    a, b = _arcs(spark, sf_dir, "skip"), _arcs(spark, sf_dir, "skip")
    b = b.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("elabel").alias("e1"), F.col("dst_label").alias("l2"))
    kinds = a.join(b, F.col("dst") == F.col("mid")).where("src <> end").groupBy("src_label", "elabel", "dst_label", "e1", "l2").agg(F.count(F.lit(1)).alias("n"))
    udfs.register(spark)
    edges = "array(named_struct('u', 0, 'v', 1, 'label', elabel), named_struct('u', 1, 'v', 2, 'label', e1))"
    return kinds.selectExpr(f"min_dfs_code(array(src_label, dst_label, l2), {edges}) AS code", "n").groupBy("code").agg(F.sum("n").alias("n"))


def _code_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined codes with their places in the order of codes, and of their first edges (a few hundred rows)."""
    rows = spark.createDataFrame([(dfscode.format_code(c), dfscode.format_code(c, placeholders=False)) for c, _ in _mined(spark, sf_dir, 100, 2)], "code string, full string")
    rows = rows.withColumn("edges", scalars.code_from_text(F.col("full")))
    rank = lambda key: F.dense_rank().over(Window.orderBy(key))
    return rows.select("code", rank(scalars.code_order(F.col("edges"))).alias("place"), rank(scalars.edge_order(F.col("edges")[0])).alias("first_edge_place"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct fields of the events' properties, values and types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat_ws(" ", F.regexp_replace("props", r"[{}:,\"]", " "), F.col("value").cast("decimal(18,2)").cast("string"), "event_type", (F.col("event_id") * 1000003).cast("string"))
    return e.select(F.explode(scalars.split_fields(text)).alias("c")).distinct()


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, text = F.col("c"), lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return _fields(spark, sf_dir).select(
        "c", text(scalars.try_int(c)).alias("as_int"), text(scalars.try_long(c)).alias("as_long"), text(scalars.try_unsigned(c)).alias("as_unsigned"), F.coalesce(scalars.try_double(c), F.lit(-1.0)).alias("as_double"),
        scalars.is_int(c).alias("int"), scalars.is_double(c).alias("double"), scalars.is_na(c).alias("na"), scalars.is_symbol(c).alias("symbol"),
    )


def _false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that the upper bound admits and the support doesn't, at a threshold just above the largest support that its bound exceeds."""
    e, v = _level1(spark, sf_dir), fixtures.graph(spark, sf_dir, "skip", PARTS)[0]
    both = support.bounds(e, v).join(support.support(e), "pattern")
    n = (both.where("upper > support").agg(F.max("support")).first()[0] or 0) + 1
    exact = both.where(F.col("support") >= n).select("pattern")
    return both.where(F.col("upper") >= n).join(exact, "pattern", "left_anti").select("pattern", "upper")


def _counted(df: DataFrame, *by: str, value: str = "dst") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("n_distinct"))


def _code_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TEXT_CODES], "text string").withColumn("code", scalars.code_from_text(F.col("text")))


def _level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all one-edge patterns, numbered by their labels."""
    roots = extend.forward_roots(_arcs(spark, sf_dir, "skip"))
    return roots.select((F.col("src_label") * 100 + F.col("elabel") * 10 + F.col("dst_label")).alias("pattern"), F.col("src").alias("v0"), F.col("dst").alias("v1"))


HUB_LEAVES = [(0, 10), (0, 11), (1, 12)]


def queries() -> dict:
    skip = lambda s, d: _arcs(s, d, "skip")
    parts = lambda s, d: fixtures.graph(s, d, "skip", PARTS)
    path2 = lambda s, d: _found(s, d, PATH2)

    def triples(s, d, share=20):
        return {(r.from_label, r.edge_label, r.to_label) for r in single_edge_codes(skip(s, d)).where(F.col("support") >= minsup(s, d, share)).collect()}

    out = {
        "graph_vertices": lambda s, d: fixtures.graph(s, d, "skip")[0],
        "graph_arcs": skip,
        "edge_ids": lambda s, d: graph.edge_ids(skip(s, d)).groupBy("eid").agg(F.min("src").alias("src"), F.max("dst").alias("dst"), F.min("elabel").alias("elabel"), F.count(F.lit(1)).alias("n_arcs")).drop("eid"),
        "degree_hist": lambda s, d: graph.degrees(fixtures.graph(s, d, "skip")[0], skip(s, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("n")),
        "invalid_arcs": lambda s, d: (lambda v, e: graph.invalid_arcs(v.where("label <> 1"), e))(*fixtures.graph(s, d, "geo")),
        "dedup_edges": lambda s, d: (lambda e: graph.clean_edges(e.union(e.select("dst", "src", "elabel"))))(fixtures.graph(s, d, "trade")[1]),
        "delete_vertices": lambda s, d: (lambda v, e: graph.delete_vertices(v, e, v.where("label = 3"))[1])(*fixtures.graph(s, d, "skip")),
        "forward_root_arcs": lambda s, d: extend.forward_roots(skip(s, d)),
        "frequent_edge_filter": lambda s, d: _counted(frequent_arcs(skip(s, d), triples(s, d)), "src_label", "elabel", "dst_label"),
        "pure_forward_ext": lambda s, d: _counted(extend.pure_forward(_found(s, d, PATH2[:1]), skip(s, d), PATH2[:1]), "elabel", "dst_label"),
        "rmpath_forward_ext": lambda s, d: _counted(extend.path_forward(path2(s, d), skip(s, d), PATH2), "i", "elabel", "dst_label"),
        "backward_ext": lambda s, d: _counted(extend.backward(path2(s, d), skip(s, d), PATH2), "j", "elabel", value="v0"),
        "domain_sizes": lambda s, d: support.domain_sizes(_found(s, d, TRIANGLE)),
        "largest_domain": lambda s, d: support.largest_domain(path2(s, d)).select("support"),
        "mean_domain_sizes": lambda s, d: support.mean_domain_sizes(path2(s, d)),
        "embeddings_per_root": lambda s, d: path2(s, d).groupBy("v0").agg(F.count(F.lit(1)).alias("n")),
        "l2_frequent_patterns": lambda s, d: _patterns(s, d, 100, 2, 2),
        "l3_frequent_patterns": lambda s, d: _patterns(s, d, 250, 3, 3),
        "mine_max3_flagship": lambda s, d: _patterns(s, d, 250, 3),
        "mine_chain_max3": lambda s, d: _patterns(s, d, 250, 3, name="chain"),
        "mine_geo_max2": lambda s, d: _patterns(s, d, 2000, 2, name="geo"),
        "patterns_per_level": lambda s, d: _patterns(s, d, 250, 3).groupBy("n_edges").agg(F.count(F.lit(1)).alias("n_patterns")),
        "support_histogram": lambda s, d: _patterns(s, d, 250, 3).groupBy("support").agg(F.count(F.lit(1)).alias("n_patterns")),
        "counting_sink": lambda s, d: (lambda sink: (sink.put(_patterns(s, d, 100, 2)), s.range(1).select(F.lit(sink.count()).cast("long").alias("n_patterns")))[1])(writers.CountSink()),
        "mined_codes": lambda s, d: s.createDataFrame([(dfscode.format_code(c), n) for c, n in _mined(s, d, 100, 2)], "code string, support long"),
        "mined_codes_max3": lambda s, d: s.createDataFrame([(dfscode.format_code(c), n) for c, n in _mined(s, d, 250, 3)], "code string, support long"),
        "min_dfs_code_udf": _paths_by_code,
        "code_ranks": _code_ranks,
        "edge_partial_equality": lambda s, d: (lambda a, b: a.crossJoin(F.broadcast(b)).where(scalars.edge_partial_equal(F.col("x"), F.col("y"))).select(F.col("k").alias("k"), F.col("m").alias("m")))(
            *[_code_rows(s).select(F.posexplode("code").alias("p", c)).select(F.concat_ws(" ", *[F.col(f"{c}.{f}") for f in ("i", "j", "from_label", "edge_label", "to_label")]).alias(n), c).distinct() for c, n in (("x", "k"), ("y", "m"))]
        ),
        "file_sink_support": _sunk(True),
        "file_sink_codes": _sunk(False),
        "convert_partitions": _converted,
        "field_parsing": _parsed,
        "placement_hash": lambda s, d: fixtures.graph(s, d, "skip")[0].select(scalars.placement_hash(F.col("vid"), PARTS).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("p").between(0, PARTS - 1)).alias("in_range"), F.countDistinct("p").alias("n_parts")),
        "local_support_by_partition": lambda s, d: support.local_supports(path2(s, d), parts(s, d)[0]).select("part_id", "pos", "size"),
        "int_ext_supports": lambda s, d: support.local_supports(path2(s, d), parts(s, d)[0]).select("part_id", "pos", "internal", "external"),
        "upper_bound_support": lambda s, d: support.bounds(path2(s, d), parts(s, d)[0]).select("upper"),
        "lower_bound_support": lambda s, d: support.bounds(path2(s, d), parts(s, d)[0]).select("lower"),
        "exact_vs_bounds": lambda s, d: support.decide(path2(s, d), parts(s, d)[0], BOUND),
        "possible_in_part": lambda s, d: support.possible_in_part(path2(s, d), parts(s, d)[0], BOUND, PARTS),
        "bounds_per_pattern": lambda s, d: support.decide(_level1(s, d), parts(s, d)[0], minsup(s, d, 15)),
        "possible_per_pattern": lambda s, d: support.possible_in_part(_level1(s, d), parts(s, d)[0], minsup(s, d, 15), PARTS),
        "false_positives": _false_positives,
        "find_arcs": lambda s, d: graph.find_arcs(skip(s, d), fixtures.graph(s, d, "skip")[1].where("elabel = 1")),
        "contains_pattern": lambda s, d: s.createDataFrame([(k, extend.contains(skip(s, d), c)) for k, c in (("square", SQUARE), ("absent", ((0, 1, 99, 0, 99),)))], "pattern string, found boolean"),
        "has_ghosts": lambda s, d: s.createDataFrame([(partitioned.has_ghosts(*parts(s, d)),)], "found boolean"),
        "mni_hub_star": lambda s, d: stars.star_support(_arcs(s, d, "trade"), 0, HUB_LEAVES),
        "cut_edges": lambda s, d: partitioned.cut_edges(*parts(s, d)),
        "ghost_vertices": lambda s, d: partitioned.ghosts(*parts(s, d)),
        "ladjp_rows": lambda s, d: (lambda v, e: partitioned.local_rows(v, graph.clean_edges(e)))(*parts(s, d)).select("file", "owner", "vid", "label", F.size("adjacent").cast("long").alias("n_arcs")),
        "ghost_arcs": lambda s, d: (lambda v, a: partitioned.distinct_arcs(*[partitioned.without(a.join(v.where(f"part_id = {p}").select(F.col("vid").alias("src")), "src", "left_semi").select("src", "dst", "elabel"), v.where(f"part_id = {p}")) for p in range(PARTS)]))(parts(s, d)[0], skip(s, d)),
        "code_format": lambda s, d: _code_rows(s).select("text", scalars.code_text(F.col("code"), kinds=True).alias("formatted")),
        "code_parse": lambda s, d: _code_rows(s).select("text", F.posexplode("code").alias("k", "e")).select("text", F.col("k").cast("long").alias("k"), F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.edge_label").alias("edge_label")),
        "node_count": lambda s, d: _code_rows(s).select("text", scalars.code_node_count(F.col("code")).alias("n_nodes")),
        "code_order": lambda s, d: _code_rows(s).select(F.explode("code").alias("e")).distinct().withColumn("key", scalars.growth_order(F.col("e"))).select(
            F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.edge_label").alias("edge_label"), F.col("e.to_label").alias("to_label"), F.col("key.kind").alias("kind"), F.col("key.place").alias("place")
        ),
        "scalar_parsing": lambda s, d: s.createDataFrame([(x,) for x in ("12", " 12", "-3", "2.5", "x_1", "NA", "99999999999", "")], "c string").select(
            "c", F.coalesce(scalars.try_unsigned(F.trim("c")).cast("string"), F.lit("-")).alias("as_unsigned"), F.coalesce(scalars.try_double(F.col("c")), F.lit(-1.0)).alias("as_double"), F.size(scalars.split_fields(F.col("c"))).alias("n_fields"), scalars.is_na(F.col("c")).alias("na"), scalars.is_symbol(F.col("c")).alias("symbol")
        ),
    }
    for name in fixtures.GRAPHS:
        out[f"l1_{name}"] = lambda s, d, name=name: single_edge_codes(_arcs(s, d, name))
    out["l1_frequent_edges"] = lambda s, d: single_edge_codes(skip(s, d)).where(F.col("support") >= minsup(s, d, 20))
    for name, code in SHAPES.items():
        out[f"match_{name}"] = lambda s, d, code=code: _found(s, d, code)
        out[f"mni_{name}"] = lambda s, d, code=code: support.support(_found(s, d, code))
    for kind in readers.TYPES:
        out[f"round_trip_{kind}"] = _round_trip(kind)
    return out


def match_sql(code: dfscode.Code) -> str:
    """Embeddings as a chain of joins on arcs."""
    at, joins, where = {}, [], []
    for k, (i, j, a, e, b) in enumerate(code):
        where.append(f"a{k}.src_label = {a} AND a{k}.elabel = {e} AND a{k}.dst_label = {b}")
        if k == 0:
            at = {i: "a0.src", j: "a0.dst"}
            joins.append("arcs a0")
        elif i < j:
            joins.append(f"JOIN arcs a{k} ON a{k}.src = {at[i]}" + "".join(f" AND a{k}.dst <> {x}" for x in at.values()))
            at[j] = f"a{k}.dst"
        else:
            joins.append(f"JOIN arcs a{k} ON a{k}.src = {at[i]} AND a{k}.dst = {at[j]}")
    cols = ", ".join(f"{x} AS v{i}" for i, x in sorted(at.items()))
    return f"SELECT {cols} FROM {' '.join(joins)} WHERE {' AND '.join(where)}"


def _mine_sql(name: str, share: int, levels: int, only: int = 0) -> str:
    """Paths, stars and triangles of up to three edges by key, and the least distinct count over their vertices."""
    parts = {1: [], 2: [], 3: []}
    parts[1].append("SELECT 1 AS n_edges, 'P:' || f AS pattern, v0, v1, NULL AS v2, NULL AS v3 FROM (SELECT src AS v0, dst AS v1, concat_ws('-', src_label, elabel, dst_label) AS f, concat_ws('-', dst_label, elabel, src_label) AS r FROM arcs) WHERE f <= r")
    parts[2].append("SELECT 2, 'P:' || f, v0, v1, v2, NULL FROM (SELECT *, concat_ws('-', l0, e0, l1, e1, l2) AS f, concat_ws('-', l2, e1, l1, e0, l0) AS r FROM p2) WHERE f <= r")
    parts[3] += [
        "SELECT 3, 'P:' || f, v0, v1, v2, v3 FROM (SELECT p.*, c.dst AS v3, concat_ws('-', l0, e0, l1, e1, l2, c.elabel, c.dst_label) AS f, concat_ws('-', c.dst_label, c.elabel, l2, e1, l1, e0, l0) AS r FROM p2 p JOIN arcs c ON c.src = p.v2 AND c.dst <> p.v1 AND c.dst <> p.v0) WHERE f <= r",
        "SELECT 3, 'S:' || l || '|' || x || ',' || y || ',' || z, v0, v1, v2, v3 FROM (SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, c.dst AS v3, a.src_label AS l, a.elabel || '.' || a.dst_label AS x, b.elabel || '.' || b.dst_label AS y, c.elabel || '.' || c.dst_label AS z FROM arcs a JOIN arcs b ON a.src = b.src AND a.dst <> b.dst JOIN arcs c ON c.src = a.src AND c.dst <> a.dst AND c.dst <> b.dst) WHERE x <= y AND y <= z",
        "SELECT 3, 'T:' || t1, v0, v1, v2, NULL FROM (SELECT p.*, concat_ws('-', l0, e0, l1, e1, l2, c.elabel) AS t1, concat_ws('-', l1, e1, l2, c.elabel, l0, e0) AS t2, concat_ws('-', l2, c.elabel, l0, e0, l1, e1) AS t3, concat_ws('-', l0, c.elabel, l2, e1, l1, e0) AS t4, concat_ws('-', l2, e1, l1, e0, l0, c.elabel) AS t5, concat_ws('-', l1, e0, l0, c.elabel, l2, e1) AS t6 FROM p2 p JOIN arcs c ON c.src = p.v2 AND c.dst = p.v0) WHERE t1 <= least(t2, t3, t4, t5, t6)",
    ]
    chosen = [q for k in range(1, levels + 1) if not only or k == only for q in parts[k]]
    if only > 1:
        chosen[0] = chosen[0].replace(f"SELECT {only}, ", f"SELECT {only} AS n_edges, ", 1)
        head, tail = chosen[0].split(" FROM ", 1)
        head = head.replace(", v0,", " AS pattern, v0,", 1)
        head = head.replace(", v2, NULL", ", v2, NULL AS v3")
        chosen[0] = f"{head} FROM {tail}"
    return fixtures.graph_sql(name) + f""", p2 AS (SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, a.src_label AS l0, a.elabel AS e0, a.dst_label AS l1, b.elabel AS e1, b.dst_label AS l2 FROM arcs a JOIN arcs b ON b.src = a.dst AND b.dst <> a.src),
emb AS ({' UNION ALL '.join(chosen)}),
found AS (SELECT pattern, any_value(n_edges) AS n_edges, least(count(DISTINCT v0), count(DISTINCT v1), coalesce(nullif(count(DISTINCT v2), 0), 9223372036854775807), coalesce(nullif(count(DISTINCT v3), 0), 9223372036854775807)) AS support FROM emb GROUP BY pattern),
frequent AS (SELECT * FROM found WHERE support >= (SELECT greatest(2, count(*) // {share}) FROM events))
"""


def oracle_sql() -> dict[str, str]:
    g = fixtures.graph_sql("skip", PARTS)
    skip = lambda select: f"{g} {select}"
    one = "SELECT src_label AS from_label, elabel AS edge_label, dst_label AS to_label, least(count(DISTINCT src), count(DISTINCT dst)) AS support FROM arcs WHERE src_label <= dst_label GROUP BY 1, 2, 3"
    share = lambda n: f"(SELECT greatest(2, count(*) // {n}) FROM events)"
    p2 = f", m AS ({match_sql(PATH2)})"
    local = p2 + ", loc AS (SELECT DISTINCT r.part_id, pos, vid FROM (SELECT v0 AS root, unnest([0, 1, 2]) AS pos, unnest([v0, v1, v2]) AS vid FROM m) x JOIN vertices r ON x.root = r.vid JOIN vertices o USING (vid)" \
        .replace("SELECT DISTINCT r.part_id, pos, vid", "SELECT DISTINCT r.part_id, CAST(pos AS INT) AS pos, x.vid, o.part_id = r.part_id AS own").replace("USING (vid)", "ON x.vid = o.vid") + ")"
    sums = local + ", b AS (SELECT pos, sum(i) AS i, sum(n) AS n FROM (SELECT part_id, pos, count(*) FILTER (own) AS i, count(*) AS n FROM loc GROUP BY 1, 2) GROUP BY pos)"
    lower, upper = "(SELECT CAST(min(i) AS BIGINT) FROM b)", "(SELECT CAST(min(n) AS BIGINT) FROM b)"
    one_by = ", e1 AS (SELECT src_label * 100 + elabel * 10 + dst_label AS pattern, src AS v0, dst AS v1 FROM arcs WHERE src_label <= dst_label), l1 AS (SELECT DISTINCT r.part_id, x.pattern, x.pos, x.vid, o.part_id = r.part_id AS own FROM (SELECT pattern, v0 AS root, unnest([0, 1]) AS pos, unnest([v0, v1]) AS vid FROM e1) x JOIN vertices r ON x.root = r.vid JOIN vertices o ON x.vid = o.vid), c1 AS (SELECT part_id, pattern, pos, count(*) FILTER (own) AS i, count(*) AS n FROM l1 GROUP BY 1, 2, 3), b1 AS (SELECT pattern, CAST(min(i) AS BIGINT) AS lower, CAST(min(n) AS BIGINT) AS upper FROM (SELECT pattern, pos, sum(i) AS i, sum(n) AS n FROM c1 GROUP BY 1, 2) GROUP BY 1), s1 AS (SELECT pattern, least(count(DISTINCT v0), count(DISTINCT v1)) AS support FROM e1 GROUP BY 1)"
    bar = share(15)
    hub = " JOIN ".join(f"arcs a{k}" + (" ON " + " AND ".join([f"a{k}.src = a0.src"] + [f"a{k}.dst <> a{m}.dst" for m in range(k)]) if k else "") for k in range(len(HUB_LEAVES)))
    hub_where = " AND ".join(f"a{k}.elabel = {e} AND a{k}.dst_label = {b}" for k, (e, b) in enumerate(HUB_LEAVES))
    exact = "(SELECT least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2)) FROM m)"
    used = lambda n: "".join(f" AND a.dst <> m.v{k}" for k in range(n))
    codes = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEXT_CODES)) + ") AS c(n, text)"
    edge_rows = [(t, k, e) for t, c in zip(TEXT_CODES, SHAPES.values(), strict=True) for k, e in enumerate(dfscode.with_placeholders(c))]
    values = ", ".join(f"('{t}', {k}, {e[0]}, {e[1]}, {e[2]}, {e[3]}, {e[4]})" for t, k, e in edge_rows)
    table = f"(VALUES {values}) AS x(text, k, i, j, a, e, b)"
    coded = g + """, p AS (SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, a.src_label AS l0, a.elabel AS e0, a.dst_label AS l1, b.elabel AS e1, b.dst_label AS l2 FROM arcs a JOIN arcs b ON b.src = a.dst AND b.dst <> a.src),
o AS (SELECT *, [l0, e0, l1, 0, e1, l2] AS fwd, [l1, e0, l0, 1, e1, l2] AS star, list_sort([[l0, e0, l1, 0, e1, l2], [l2, e1, l1, 0, e0, l0], [l1, e0, l0, 1, e1, l2], [l1, e1, l2, 1, e0, l0]])[1] AS m FROM p),
t AS (SELECT *, '(0 1 ' || m[1] || ' ' || m[2] || ' ' || m[3] || ');(' || (1 - m[4]) || ' 2 -1 ' || m[5] || ' ' || m[6] || ')' AS code FROM o),
c2 AS (SELECT code, any_value(m) AS m, least(count(DISTINCT CASE WHEN m[4] = 0 THEN v0 ELSE v1 END), count(DISTINCT CASE WHEN m[4] = 0 THEN v1 ELSE v0 END), count(DISTINCT v2)) AS support FROM t WHERE m = CASE WHEN m[4] = 0 THEN fwd ELSE star END GROUP BY code),
c1 AS (SELECT '(0 1 ' || src_label || ' ' || elabel || ' ' || dst_label || ')' AS code, [src_label, elabel, dst_label] AS m, least(count(DISTINCT src), count(DISTINCT dst)) AS support FROM arcs WHERE src_label <= dst_label GROUP BY src_label, elabel, dst_label),
kept AS (SELECT * FROM (SELECT code, m, support FROM c1 UNION ALL SELECT code, m, support FROM c2) WHERE support >= """ + share(100) + ")"
    fields = r"SELECT DISTINCT c FROM (SELECT unnest(regexp_split_to_array(trim(concat_ws(' ', regexp_replace(props, '[{}:,\"]', ' ', 'g'), CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR), event_type, CAST(event_id * 1000003 AS VARCHAR))), '\s+')) AS c FROM events) WHERE c <> ''"
    number = r"regexp_matches(c, '^[+-]?[0-9]+$')"
    as_int = lambda kind, also="": f"coalesce(CAST(CASE WHEN {number}{also} THEN TRY_CAST(c AS {kind}) END AS VARCHAR), '-')"
    out = {
        "graph_vertices": skip("SELECT vid, label FROM vertices"),
        "graph_arcs": skip("SELECT * FROM arcs"),
        "edge_ids": skip("SELECT src, dst, elabel, 2::BIGINT AS n_arcs FROM edges"),
        "degree_hist": skip("SELECT degree, count(*) AS n FROM (SELECT v.vid, count(a.src) AS degree FROM vertices v LEFT JOIN arcs a ON a.src = v.vid GROUP BY v.vid) GROUP BY degree"),
        "invalid_arcs": fixtures.graph_sql("geo") + "SELECT src, dst, elabel FROM raw_edges WHERE src NOT IN (SELECT vid FROM vertices WHERE label <> 1) OR dst NOT IN (SELECT vid FROM vertices WHERE label <> 1)",
        "dedup_edges": fixtures.graph_sql("trade") + "SELECT * FROM edges",
        "delete_vertices": skip("SELECT src, dst, elabel FROM raw_edges WHERE src NOT IN (SELECT vid FROM vertices WHERE label = 3) AND dst NOT IN (SELECT vid FROM vertices WHERE label = 3)"),
        "forward_root_arcs": skip("SELECT * FROM arcs WHERE src_label <= dst_label"),
        "frequent_edge_filter": skip(f", f AS ({one}), k AS (SELECT * FROM f WHERE support >= {share(20)}) SELECT src_label, elabel, dst_label, count(*) AS n, count(DISTINCT dst) AS n_distinct FROM arcs WHERE EXISTS (SELECT 1 FROM k WHERE edge_label = elabel AND from_label = least(src_label, dst_label) AND to_label = greatest(src_label, dst_label)) GROUP BY 1, 2, 3"),
        "pure_forward_ext": skip(f", m AS ({match_sql(PATH2[:1])}) SELECT elabel, dst_label, count(*) AS n, count(DISTINCT a.dst) AS n_distinct FROM m JOIN arcs a ON a.src = m.v1 WHERE dst_label >= 0{used(2)} GROUP BY 1, 2"),
        "rmpath_forward_ext": skip(p2 + f" SELECT i, elabel, dst_label, count(*) AS n, count(DISTINCT dst) AS n_distinct FROM (SELECT 1 AS i, a.* FROM m JOIN arcs a ON a.src = m.v1 WHERE dst_label >= 0 AND (elabel > 0 OR dst_label >= 2){used(3)} UNION ALL SELECT 0, a.* FROM m JOIN arcs a ON a.src = m.v0 WHERE dst_label >= 0 AND (elabel > 0 OR dst_label >= 1){used(3)}) GROUP BY 1, 2, 3"),
        "backward_ext": skip(p2 + " SELECT 0 AS j, elabel, count(*) AS n, count(DISTINCT m.v0) AS n_distinct FROM m JOIN arcs a ON a.src = m.v2 AND a.dst = m.v0 WHERE elabel > 0 OR 1 <= 2 GROUP BY 1, 2"),
        "domain_sizes": skip(f", m AS ({match_sql(TRIANGLE)}) SELECT CAST(pos AS INT) AS pos, count(DISTINCT vid) AS size FROM (SELECT unnest([0, 1, 2]) AS pos, unnest([v0, v1, v2]) AS vid FROM m) GROUP BY pos"),
        "largest_domain": skip(p2 + " SELECT greatest(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2)) AS support FROM m"),
        "mean_domain_sizes": skip(p2 + " SELECT CAST(pos AS INT) AS pos, CAST(count(DISTINCT vid) AS DOUBLE) AS mean_size FROM (SELECT unnest([0, 1, 2]) AS pos, unnest([v0, v1, v2]) AS vid FROM m) GROUP BY pos"),
        "embeddings_per_root": skip(p2 + " SELECT v0, count(*) AS n FROM m GROUP BY v0"),
        "l2_frequent_patterns": _mine_sql("skip", 100, 2, 2) + "SELECT pattern, n_edges, support FROM frequent",
        "l3_frequent_patterns": _mine_sql("skip", 250, 3, 3) + "SELECT pattern, n_edges, support FROM frequent",
        "mine_max3_flagship": _mine_sql("skip", 250, 3) + "SELECT pattern, n_edges, support FROM frequent",
        "mine_chain_max3": _mine_sql("chain", 250, 3) + "SELECT pattern, n_edges, support FROM frequent",
        "mine_geo_max2": _mine_sql("geo", 2000, 2) + "SELECT pattern, n_edges, support FROM frequent",
        "patterns_per_level": _mine_sql("skip", 250, 3) + "SELECT n_edges, count(*) AS n_patterns FROM frequent GROUP BY 1",
        "support_histogram": _mine_sql("skip", 250, 3) + "SELECT support, count(*) AS n_patterns FROM frequent GROUP BY 1",
        "counting_sink": _mine_sql("skip", 100, 2) + "SELECT count(*) AS n_patterns FROM frequent",
        "mined_codes": coded + " SELECT code, support FROM kept",
        "min_dfs_code_udf": coded + " SELECT code, count(*) AS n FROM t GROUP BY code",
        "code_ranks": coded + ", e AS (SELECT *, [0, 1, m[1], m[2], m[3]] AS e1, CASE WHEN len(m) = 3 THEN [] WHEN m[4] = 0 THEN [1, 2, m[3], m[5], m[6]] ELSE [0, 2, m[1], m[5], m[6]] END AS e2 FROM kept) SELECT code, CAST(dense_rank() OVER (ORDER BY len(m), list_concat(e1, e2)) AS INT) AS place, CAST(dense_rank() OVER (ORDER BY e1) AS INT) AS first_edge_place FROM e",
        "edge_partial_equality": f", z AS (SELECT DISTINCT i, j, a, e, b FROM {table}) SELECT concat_ws(' ', x.i, x.j, x.a, x.e, x.b) AS k, concat_ws(' ', y.i, y.j, y.a, y.e, y.b) AS m FROM z x JOIN z y ON x.i = y.i AND x.j = y.j AND x.e = y.e AND (x.a = y.a OR x.a = -1 OR y.a = -1) AND (x.b = y.b OR x.b = -1 OR y.b = -1)".replace(", z AS", "WITH z AS", 1),
        "file_sink_support": coded + " SELECT code || ':' || support AS line FROM kept",
        "file_sink_codes": coded + " SELECT code AS line FROM kept",
        "convert_partitions": skip("SELECT h.*, v.part_id AS src_part FROM half h JOIN vertices v ON h.src = v.vid"),
        "field_parsing": f"SELECT c, {as_int('INT')} AS as_int, {as_int('BIGINT')} AS as_long, {as_int('BIGINT', ' AND TRY_CAST(c AS BIGINT) >= 0')} AS as_unsigned, coalesce(TRY_CAST(c AS DOUBLE), -1.0::DOUBLE) AS as_double, {number} AND TRY_CAST(c AS INT) IS NOT NULL AS int, TRY_CAST(c AS DOUBLE) IS NOT NULL AS double, c IN ('NA', 'na', 'N/A', 'n/a') AS na, regexp_matches(c, '^[A-Za-z_][A-Za-z0-9_]*$') AS symbol FROM ({fields})",
        "placement_hash": skip(f"SELECT count(*) AS n, true AS in_range, {PARTS}::BIGINT AS n_parts FROM vertices"),
        "local_support_by_partition": skip(local + " SELECT part_id, pos, count(*) AS size FROM loc GROUP BY 1, 2"),
        "int_ext_supports": skip(local + " SELECT part_id, pos, count(*) FILTER (own) AS internal, count(*) FILTER (NOT own) AS external FROM loc GROUP BY 1, 2"),
        "upper_bound_support": skip(sums + f" SELECT {upper} AS upper"),
        "lower_bound_support": skip(sums + f" SELECT {lower} AS lower"),
        "exact_vs_bounds": skip(sums + f" SELECT *, CASE WHEN lower >= {BOUND} THEN 'frequent' WHEN upper < {BOUND} THEN 'infrequent' ELSE 'counted' END AS verdict FROM (SELECT {lower} AS lower, {upper} AS upper, {exact} AS support)"),
        "possible_in_part": skip(local + f" SELECT max(n) AS largest FROM (SELECT part_id, max(n) AS n FROM (SELECT part_id, pos, count(*) AS n FROM loc GROUP BY 1, 2) GROUP BY 1) WHERE n >= {BOUND // PARTS}"),
        "bounds_per_pattern": skip(one_by + f" SELECT pattern, lower, upper, support, CASE WHEN lower >= {bar} THEN 'frequent' WHEN upper < {bar} THEN 'infrequent' ELSE 'counted' END AS verdict FROM b1 JOIN s1 USING (pattern)"),
        "possible_per_pattern": skip(one_by + f" SELECT pattern, max(n) AS largest FROM (SELECT pattern, part_id, max(n) AS n FROM c1 GROUP BY 1, 2) WHERE n >= {bar} // {PARTS} GROUP BY 1"),
        "false_positives": skip(one_by + " SELECT pattern, upper FROM b1 JOIN s1 USING (pattern) WHERE support <= (SELECT max(support) FROM b1 JOIN s1 USING (pattern) WHERE upper > support) AND upper > (SELECT max(support) FROM b1 JOIN s1 USING (pattern) WHERE upper > support)"),
        "find_arcs": skip("SELECT a.* FROM arcs a WHERE EXISTS (SELECT 1 FROM raw_edges e WHERE e.elabel = 1 AND e.src = a.src AND e.dst = a.dst)"),
        "contains_pattern": skip(f"SELECT 'square' AS pattern, EXISTS ({match_sql(SQUARE)}) AS found UNION ALL SELECT 'absent', false"),
        "has_ghosts": skip("SELECT EXISTS (SELECT 1 FROM arcs WHERE src % 4 <> dst % 4) AS found"),
        "mni_hub_star": fixtures.graph_sql("trade") + f"SELECT least(count(DISTINCT a0.src), {', '.join(f'count(DISTINCT a{k}.dst)' for k in range(len(HUB_LEAVES)))}) AS support FROM {hub} WHERE a0.src_label = 0 AND {hub_where}",
        "cut_edges": skip("SELECT e.src, e.dst, e.elabel, a.part_id AS src_part, b.part_id AS dst_part FROM raw_edges e JOIN vertices a ON e.src = a.vid JOIN vertices b ON e.dst = b.vid WHERE a.part_id <> b.part_id"),
        "ghost_vertices": skip("SELECT DISTINCT a.part_id, b.vid, b.label, b.part_id AS owner FROM arcs x JOIN vertices a ON x.src = a.vid JOIN vertices b ON x.dst = b.vid WHERE a.part_id <> b.part_id"),
        "ladjp_rows": skip(", p AS (SELECT a.part_id AS sp, b.part_id AS dp, x.src, x.dst FROM arcs x JOIN vertices a ON x.src = a.vid JOIN vertices b ON x.dst = b.vid) SELECT v.part_id AS file, v.part_id AS owner, v.vid, v.label, (SELECT count(*) FROM p WHERE p.src = v.vid) AS n_arcs FROM vertices v UNION ALL SELECT dp, sp, src, any_value(v.label), count(*) FROM p JOIN vertices v ON p.src = v.vid WHERE sp <> dp GROUP BY dp, sp, src"),
        "ghost_arcs": skip("SELECT DISTINCT x.src, x.dst, x.elabel FROM arcs x JOIN vertices a ON x.src = a.vid JOIN vertices b ON x.dst = b.vid WHERE a.part_id <> b.part_id"),
        "code_format": f"SELECT text, string_agg(CASE WHEN i < j THEN 'F' ELSE 'B' END || '(' || concat_ws(' ', i, j, a, e, b) || ')', ';' ORDER BY k) AS formatted FROM {table} GROUP BY text",
        "code_parse": f"SELECT text, CAST(k AS BIGINT) AS k, i, j, e AS edge_label FROM {table}",
        "node_count": f"SELECT text, CAST(list_max(list_transform(regexp_extract_all(text, '\\((\\d+) (\\d+)', 2), lambda x: CAST(x AS INT))) + 1 AS INT) AS n_nodes FROM {codes}".replace("list_max(list_transform(regexp_extract_all(text, '\\((\\d+) (\\d+)', 2), lambda x: CAST(x AS INT)))", "greatest(list_max(list_transform(regexp_extract_all(text, '\\((\\d+) (\\d+)', 2), lambda x: CAST(x AS INT))), list_max(list_transform(regexp_extract_all(text, '\\((\\d+) (\\d+)', 1), lambda x: CAST(x AS INT))))"),
        "code_order": f"SELECT DISTINCT i, j, e AS edge_label, b AS to_label, CAST(i < j AS INT) AS kind, CASE WHEN i < j THEN -i ELSE j END AS place FROM {table}",
        "scalar_parsing": "SELECT c, coalesce(CASE WHEN regexp_matches(trim(c), '^[0-9]+$') THEN trim(c) END, '-') AS as_unsigned, coalesce(TRY_CAST(c AS DOUBLE), -1.0::DOUBLE) AS as_double, CAST(len(trim(c)) > 0 AS INT) AS n_fields, c IN ('NA', 'na', 'N/A', 'n/a') AS na, regexp_matches(c, '^[A-Za-z_][A-Za-z0-9_]*$') AS symbol FROM (VALUES ('12'), (' 12'), ('-3'), ('2.5'), ('x_1'), ('NA'), ('99999999999'), ('')) AS t(c)",
        "l1_frequent_edges": skip(f", f AS ({one}) SELECT * FROM f WHERE support >= {share(20)}"),
    }
    for name in fixtures.GRAPHS:
        out[f"l1_{name}"] = fixtures.graph_sql(name) + one
    for name, code in SHAPES.items():
        m, n = match_sql(code), dfscode.node_count(code)
        out[f"match_{name}"] = skip(m)
        out[f"mni_{name}"] = skip(f", m AS ({m}) SELECT least({', '.join(f'count(DISTINCT v{k})' for k in range(n))}) AS support FROM m")
    for kind in readers.TYPES:
        out[f"round_trip_{kind}"] = skip("SELECT h.*, v.part_id AS src_part FROM half h JOIN vertices v ON h.src = v.vid")
    return out
