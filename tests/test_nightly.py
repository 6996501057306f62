"""The whole night reads its pages once."""

import datetime as dt


def test_nightly_snapshot_reads_the_orders_once(spark, tmp_path):
    import __spark_entry__ as e

    rows = [(k, dt.date(1996, 5, 1 + k % 20)) for k in range(1, 120)]
    spark.createDataFrame(rows, "o_orderkey BIGINT, o_orderdate DATE").write.parquet(f"{tmp_path}/orders.parquet")
    found = e.queries()["nightly_snapshot"](spark, str(tmp_path))
    # the rows come from the staged batches, not from another parse of the pages
    assert found.inputFiles() and not any("orders.parquet" in f for f in found.inputFiles())
    want = {f"kaleidoscope-park-{k}" for k, _ in rows if k % 17 and k % 19}
    assert {r["id"] for r in found.collect()} == want
