"""Keyed queries where changed keys meet other orders' keys, as beyond a million orders."""

import duckdb
import pytest

from test_compare import made
from veritab.plans import catalogue

NAMES = ["keyed_diff_summary", "keyed_changed_cells", "changed_by_column", "keyed_removed", "keyed_added"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Orders around a million: 101 * 7 + 1,000,000 and others are keys of their own; 101 * 37 changes status as well."""
    where = tmp_path_factory.mktemp("orders")
    duckdb.sql(
        "copy (select k as o_orderkey, ['O', 'F', 'P'][k % 3 + 1] as o_orderstatus, ['1-URGENT', '2-HIGH'][k // 7 % 2 + 1] as o_orderpriority "
        f"from (select unnest(range(0, 8000)) as k union all select unnest(range(1000000, 1005000)))) to '{where}/orders.parquet' (format parquet)"
    )
    return str(where)


def wanted(folder, sql):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/orders.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", NAMES)
def test_met_keys_against_sql(spark, folder, name):
    names, want = wanted(folder, catalogue.oracle_sql()[name])
    assert want and sorted(repr(tuple(r[n] for n in names)) for r in catalogue.queries()[name](spark, folder).collect()) == want


def test_references_of_met_keys(spark, folder):
    """The SQL leaves open which pair of a key comes first, so keys are held against it, and references up to a key's own pairs."""
    got = catalogue.queries()["keyed_references"](spark, folder).collect()
    _, want = wanted(folder, catalogue.oracle_sql()["keyed_references"].replace("select 'key-'", "select k, 'key-'").split(" select k,")[0] + " select k from n where c")
    assert sorted(repr((r.o_orderkey,)) for r in got) == want
    _, spans = wanted(folder, catalogue.oracle_sql()["keyed_references"].split(" select 'key-'")[0] + " select k, min(n), max(n) from n group by k")
    spans = {k: (a, b) for k, a, b in map(eval, spans)}
    assert all(spans[r.o_orderkey][0] <= int(r.key_reference[4:]) <= spans[r.o_orderkey][1] for r in got) and len({r.key_reference for r in got}) == len(got)


def test_references_do_not_depend_on_where_rows_lie(spark, folder, tmp_path):
    """Pairs of one key come in the order of their right rows' own order keys, however the table is written."""
    duckdb.sql(f"copy (select * from '{folder}/orders.parquet' order by o_orderkey desc) to '{tmp_path}/orders.parquet' (format parquet)")
    sql = catalogue.oracle_sql()["keyed_references"]
    for old, new in (("<> r.s as c", "<> r.s as c, r.o"), ("as p from orders) r", "as p, o_orderkey as o from orders) r"), ("':' || k) as n", "':' || k, o) as n")):
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    _, want = wanted(folder, sql)
    for where in (folder, str(tmp_path)):
        assert sorted(repr((r.key_reference, r.o_orderkey)) for r in catalogue.queries()["keyed_references"](spark, where).collect()) == want


def test_pairs(spark):
    left, right = [("1", "a"), ("1", "b"), ("2", "c"), (None, "d")], [("1", "a"), ("1", "a"), ("3", "c"), (None, "d")]
    c = made(spark, "Id,Name", left, right, keys=["Id"], pairs=True)
    s = c.summary()
    assert {k: s["differences"][k] for k in ("added", "removed", "changed", "unchanged", "changed_cells", "duplicate_keys_left")} == {"added": 1, "removed": 1, "changed": 2, "unchanged": 3, "changed_cells": 2, "duplicate_keys_left": 0}
    assert (s["left"]["duplicate_key_count"], s["right"]["unique_key_count"], s["exit_code"]) == (1, 2, 1)
    assert [tuple(r) for r in c.duplicate_rows(1).orderBy("key_occurrence").collect()] == [("1", "a", 1, 2), ("1", "a", 2, 2)]
    assert [tuple(r) for r in c.changed_cells().collect()] == [("key-000004", "1", "Name", "b", "a"), ("key-000005", "1", "Name", "b", "a")]
