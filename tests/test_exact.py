"""Results that must not depend on the order in which rows are added up."""

from rulefact.plans import catalogue


def test_means_at_the_bound_count_in_any_order(spark, tmp_path):
    import duckdb

    name = "f9_top_destinations"
    rows = [(1, 1, x) for x in (0.0, 0.02, 0.09, 0.09)]  # their mean is 0.05, any sum of doubles is less
    rows += [(1, 2, 0.05), (1, 3, 0.04), (2, 4, 0.06), (2, 5, 0.08), (2, 6, 0.07), (3, 1, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall()) == [(1, 1), (1, 2), (2, 5), (2, 6)]
