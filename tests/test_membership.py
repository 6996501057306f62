import pytest

from helpers import dicts, table
from townbill.operators import membership, publish

ROWS = "id STRING, word STRING, bits BIGINT"


def stored(spark, n=4000):
    """Column names clash with the filter's own; one id occurs often, one row in fifty has none."""
    rows = [dict(id=None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i}", word=f"w{i}", bits=i) for i in range(n)]
    return table(spark, ROWS, rows)


def split(rows, wanted):
    inside = sorted(r["bits"] for r in rows if r["id"] in wanted and r["id"] is not None)
    return inside, sorted({r["bits"] for r in rows} - set(inside))


@pytest.mark.parametrize("wanted", [[], [None], ["hot"], ["hot", "hot", "s1", None, "elsewhere"], [f"s{i}" for i in range(0, 4000, 7)]])
def test_against_sets(spark, wanted):
    rows, keys = stored(spark), table(spark, "id STRING, word STRING", [dict(id=k) for k in wanted])
    inside, outside = split(dicts(rows), set(wanted))
    assert sorted(r["bits"] for r in membership.among(rows, keys).collect()) == inside
    assert sorted(r["bits"] for r in membership.not_among(rows, keys).collect()) == outside
    assert membership.among(rows, keys).columns == membership.not_among(rows, keys).columns == rows.columns


def test_empty_store_and_other_ways(spark, monkeypatch):
    keys = table(spark, "id STRING", [dict(id="hot"), dict(id="s4")])
    none = stored(spark, 0)
    assert membership.among(none, keys).collect() == membership.not_among(none, keys).collect() == []
    numbers = spark.range(10)
    some = spark.range(3).selectExpr("CAST(id AS INT) AS id")
    assert sorted(r.id for r in membership.among(numbers, some).collect()) == [0, 1, 2]
    assert sorted(r.id for r in membership.not_among(numbers, some).collect()) == list(range(3, 10))
    monkeypatch.setattr(membership, "MOST_WORDS", 0)
    inside, outside = split(dicts(stored(spark)), {"hot", "s4"})
    assert sorted(r["bits"] for r in membership.among(stored(spark), keys).collect()) == inside
    assert sorted(r["bits"] for r in membership.not_among(stored(spark), keys).collect()) == outside


def shuffled(df, over):
    """Rows that went through the exchanges of the run plan that hold at least `over` of them in all."""
    df.collect()
    plan, total, left = df._jdf.queryExecution().executedPlan(), 0, []
    left.append(plan)
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return total > over, total


@pytest.mark.parametrize("operator", [publish.purge_stale, publish.stale_rows])
def test_shuffle_follows_the_batch(spark, operator):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(0, 2_000_000, 1000).withColumnRenamed("id", "k").selectExpr("CAST(k AS STRING) AS id")
        moved = []
        for n in (100_000, 400_000):
            rows = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "id AS bits")
            moved.append(shuffled(operator(rows, keys), n // 10))
        assert not moved[0][0] and not moved[1][0], moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
