"""The driver contract, and a few graph queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_contract(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert len([q for q in found if not q.startswith("op")]) > 80 and set(sql) <= set(found)
    assert entry.entry(spark).count() == 1


NAMES = ["has_value", "max_min_local", "skip_rest", "or_unlike", "local_fold", "emit_filter", "emit_before_repeat", "v_by_ids", "merged_graphs", "quads_lookup", "io_reads_into_graph", "json_lines", "json_tree", "graphml_round_trip", "stream_degrees", "stream_hop", "three_hop_count", "filter_count_zero", "filter_or", "filter_nested", "local_topn", "local_count", "order_by_anon", "argmax_binding", "branch_option", "repeat_emit", "repeat_until", "path_by", "properties_kv", "values_multi", "property_update", "property_join", "union_dedup", "simple_path", "element_map", "limit_unordered", "bulk_walks", "bulk_mean", "bulk_in_filter", "reachable", "repeat_capped", "repeat_bindings", "filter_binding_hop", "local_binding", "hub_hop", "key_join_walks", "key_join_in_filter", "ids_by_index", "has_id_by_index", "pairs_of_table", "map_path_value", "merged_tables", "linked_tables", "built_from_tables", "io_of_tables", "folder_files", "json_documents", "rdf_turtle", "add_v", "add_e"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda x: repr(round(float(x), 6)) if isinstance(x, (float, int)) and not isinstance(x, bool) else repr(x)
    assert sorted(tuple(show(r[c]) for c in columns) for r in got) == sorted(tuple(map(show, r)) for r in cursor.fetchall())
