import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ("graph_arcs", "l1_trade", "l1_dialog", "rmpath_forward_ext", "backward_ext", "mni_square", "mine_max3_flagship", "mine_geo_max2", "exact_vs_bounds", "ladjp_rows", "round_trip_adjp", "code_order", "scalar_parsing", "mined_codes", "min_dfs_code_udf", "code_ranks", "edge_partial_equality", "file_sink_support", "convert_partitions", "field_parsing", "false_positives", "round_trip_adj", "edge_ids")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "events", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, duck.sql(f"SELECT {', '.join(cols)} FROM want").fetchall()))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())
