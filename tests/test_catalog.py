"""Every query with SQL agrees with DuckDB on the driver's smallest tables; the others hold their invariants."""

import os

import duckdb
import pytest

from orrery.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted(tuple(r) for r in df.collect())
    want = duck.sql(SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(want.columns) == sorted(df.columns)
    assert got == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_recall_of_the_index(spark, sf_dir):
    row = QUERIES["index_recall"](spark, sf_dir).first()
    assert row["n_queries"] == 25 and row["recall"] >= 0.9


@pytest.mark.parametrize("bits, most", [(1, 0.5), (2, 0.2), (4, 0.03)])
def test_reconstruction_error_falls_with_bits(spark, sf_dir, bits, most):
    row = QUERIES[f"reconstruct_error_{bits}bit"](spark, sf_dir).first()
    assert 0 < row["mean_square"] / row["residual"] < most


@pytest.mark.parametrize("name", ["bktree_leaves", "kdtree_leaves", "tptree_leaves"])
def test_every_row_has_one_leaf(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == len({r["vec_id"] for r in rows}) == 500


def test_heads_are_near_the_ratio(spark, sf_dir):
    n = QUERIES["hbc_heads"](spark, sf_dir).count()
    assert abs(n - catalog.RATIO * 500) <= 10


def test_graph_search_finds_the_nearest_heads(spark, sf_dir):
    from orrery.operators.knn import knn_join

    e = catalog.emb(spark, sf_dir)
    near = knn_join(catalog.stated(e), catalog.heads_of(e), 10)
    want = {(r["query_id"], r["vec_id"]) for r in near.collect()}
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["graph_search"](spark, sf_dir).collect()}
    assert len(want & got) >= 0.95 * len(want)


def test_pruned_edges_hold_the_rule(spark, sf_dir):
    rows = QUERIES["rng_prune"](spark, sf_dir).collect()
    assert rows and all(r["rank"] <= 8 for r in rows)
    # the nearest neighbour always stays
    assert {r["src"] for r in rows if r["rank"] == 1} == {r["src"] for r in rows}


def test_tree_graph_is_a_subset_of_all_pairs(spark, sf_dir):
    exact = {(r["src"], r["rank"]): r["dist"] for r in QUERIES["knn_graph_exact"](spark, sf_dir).collect()}
    for r in QUERIES["tree_graph"](spark, sf_dir).collect():
        assert r["src"] != r["dst"] and r["dist"] >= exact[r["src"], r["rank"]] - 1e-6


def test_settings_compare_as_they_should(spark, sf_dir):
    bits = {r["bits"]: r["recall"] for r in QUERIES["quantization_compare"](spark, sf_dir).collect()}
    assert bits[0] >= bits[4] > bits[1] and bits[4] >= 0.7
    probes = {(r["probes"], r["max_check"]): r["recall"] for r in QUERIES["probe_sweep"](spark, sf_dir).collect()}
    assert probes[16, 400] >= probes[4, 100]
    again = {r["rerank"]: r["recall"] for r in QUERIES["rerank_sweep"](spark, sf_dir).collect()}
    assert again[10] >= again[2]


def test_tree_search_finds_the_query_itself(spark, sf_dir):
    rows = QUERIES["kdtree_search"](spark, sf_dir).where("rank = 1").collect()
    assert len(rows) == 25 and all(r["query_id"] == r["vec_id"] for r in rows)
    assert QUERIES["pruned_graph"](spark, sf_dir).where("rank > 8").count() == 0
