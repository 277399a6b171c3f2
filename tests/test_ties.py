"""Means that lie on a threshold."""

import duckdb
import pytest

from assayer.plans.catalog import ORACLES, QUERIES


def lineitem(folder, rows):
    """One supplier's rows in the given order."""
    con = duckdb.connect()
    con.execute("CREATE TABLE li (l_suppkey BIGINT, l_discount DOUBLE, l_tax DOUBLE, l_quantity DOUBLE, l_extendedprice DOUBLE)")
    con.executemany("INSERT INTO li VALUES (1, ?, ?, 25, 1000)", rows)
    con.execute(f"COPY li TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("upward", [True, False])
def test_a_tax_on_the_edge_is_not_above_it(spark, tmp_path, upward):
    """Nine times 0.04 and once 0.05: the mean is 0.041, whichever comes first."""
    rows = sorted([(0.05, 0.04)] * 54 + [(0.05, 0.05)] * 6, reverse=not upward)
    got = QUERIES["C16_preregistered_verdict"](spark, lineitem(tmp_path, rows)).collect()
    assert [r.q2 for r in got] == [True]


@pytest.mark.parametrize("upward", [True, False])
def test_a_discount_on_the_floor_is_not_below_it(spark, tmp_path, upward):
    """As many at 0.04 as at 0.06: the mean is 0.05, fourteen times that not below 0.7."""
    rows = sorted([(0.04, 0.0)] * 5 + [(0.06, 0.0)] * 5, reverse=upward)
    got = QUERIES["L9_null_verdict"](spark, lineitem(tmp_path, rows)).collect()
    assert [r.verdict for r in got] == ["outside_above_floor"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_a_mean_on_the_floor_falls_where_the_sum_in_row_order_falls(spark, sf):
    """Suppliers whose mean discount is exactly 0.05, of which the SQL's sum of doubles stays short."""
    folder = f"/root/testdata/sf{sf}"
    got = {r.run: r.verdict for r in QUERIES["L9_null_verdict"](spark, folder).where("run in (2, 35, 60)").collect()}
    assert got == {"0.001": {2: "outside_below_floor"}, "0.01": {2: got.get(2), 35: "outside_below_floor", 60: "outside_below_floor"}}[sf]


def test_rows_of_a_supplier_in_many_files_are_added_in_one_order(spark, tmp_path):
    """Parts of a supplier's rows in other files and tasks: one verdict a supplier, that of the SQL over the files in order."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    source = "read_parquet('/root/testdata/sf0.01/lineitem.parquet', file_row_number = true)"
    for k in range(4):
        con.execute(f"COPY (SELECT * EXCLUDE file_row_number FROM {source} WHERE file_row_number // 15000 = {k}) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet' (FORMAT parquet)")
    got = QUERIES["L9_null_verdict"](spark, str(tmp_path)).collect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM {source}")
    assert sorted((r.run, r.verdict or "") for r in got) == sorted((k, v or "") for k, v in con.execute(ORACLES["L9_null_verdict"]).fetchall())
