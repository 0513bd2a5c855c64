"""Scalar functions as Spark columns: parsing and testing of text fields, splitting, hashing, and codes held as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = ("NA", "na", "N/A", "n/a")
EDGE_TYPE = "struct<i:int,j:int,from_label:int,edge_label:int,to_label:int>"


def trim_text(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_fields(c: Column) -> Column:
    """Fields between runs of white space; none for blank text."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def try_int(c: Column) -> Column:
    return c.try_cast("int")


def try_long(c: Column) -> Column:
    return c.try_cast("bigint")


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def try_unsigned(c: Column) -> Column:
    v = c.try_cast("bigint")
    return F.when(v >= 0, v)


def is_int(c: Column) -> Column:
    return try_int(c).isNotNull()


def is_double(c: Column) -> Column:
    return try_double(c).isNotNull()


def is_na(c: Column) -> Column:
    return c.isin(*NA)


def is_symbol(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def placement_hash(c: Column, parts: int) -> Column:
    """Owner of a key among so many parts (placement only)."""
    return F.pmod(F.xxhash64(c), F.lit(parts))


def edge_is_forward(e: Column) -> Column:
    return e["i"] < e["j"]


def code_node_count(code: Column) -> Column:
    return F.array_max(F.transform(code, lambda e: F.greatest(e["i"], e["j"]))) + 1


def code_text(code: Column, kinds: bool = False) -> Column:
    def one(e: Column) -> Column:
        kind = F.when(edge_is_forward(e), "F").otherwise("B") if kinds else F.lit("")
        return F.concat(kind, F.lit("("), F.concat_ws(" ", *[e[k].cast("string") for k in ("i", "j", "from_label", "edge_label", "to_label")]), F.lit(")"))

    return F.array_join(F.transform(code, one), ";")


def code_from_text(c: Column) -> Column:
    def one(p: Column) -> Column:
        n = F.transform(F.regexp_extract_all(p, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))
        return F.struct(*[F.get(n, k).alias(name) for k, name in enumerate(("i", "j", "from_label", "edge_label", "to_label"))])

    return F.transform(F.filter(F.split(c, ";"), lambda p: F.trim(p) != ""), one)


def growth_order(e: Column) -> Column:
    """Sort key of next edges: backward by target and label, then forward from the deepest vertex."""
    fwd = edge_is_forward(e)
    return F.struct(
        fwd.cast("int").alias("kind"), F.when(fwd, -e["i"]).otherwise(e["j"]).alias("place"), e["edge_label"].alias("edge_label"), F.when(fwd, e["to_label"]).otherwise(0).alias("to_label")
    )


def edge_partial_equal(a: Column, b: Column) -> Column:
    """Same ends and edge label, and vertex labels that agree where neither is left out (-1)."""
    agree = lambda k: (a[k] == b[k]) | (a[k] == -1) | (b[k] == -1)
    return (a["i"] == b["i"]) & (a["j"] == b["j"]) & (a["edge_label"] == b["edge_label"]) & agree("from_label") & agree("to_label")


def edge_order(e: Column) -> Column:
    """Sort key of the plain order of edges: ends, then labels."""
    return F.struct(e["i"], e["j"], e["from_label"], e["edge_label"], e["to_label"])


def code_order(code: Column) -> Column:
    """Sort key of codes: shorter ones first, then edge by edge."""
    return F.struct(F.size(code), code)
