"""Queries against their SQL on rows that the small tables lack."""

import duckdb

from quietwire.plans import all_queries, driver_views


def write(spark, folder, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_flags_of_every_relationship(spark, tmp_path):
    orders = [(1, 7), (2, 8), (3, None), (4, 12), (5, 8), (None, 9)]
    lines = [(1, 2), (1, 2), (1, 42), (2, 1), (2, None), (3, 5), (3, 5), (3, None), (4, 6), (5, 11), (5, 1), (None, 3), (9, 1)]
    con = write(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_suppkey long"))
    sql = all_queries.ORACLES["p05_relationship_flags"].rpartition("\n")[2]
    relationships = driver_views.VIEWS["relationships"].format(orders="orders", lineitem="lineitem")
    wanted = sorted(con.execute(f"WITH relationships AS ({relationships}) {sql}").fetchall(), key=str)
    df = all_queries.QUERIES["p05_relationship_flags"](spark, str(tmp_path))
    assert df.columns == ["user_id", "business_id", "opted_out", "active"]
    got = sorted(map(tuple, df.collect()), key=str)
    assert (None, None, None, True) in got and got == wanted
