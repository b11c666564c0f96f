"""The oldest due records of every host without gathering a host in one task."""

from fleetseal.operators import outbox


def test_ready_batch_ranks_no_host_whole(spark):
    hour = 3_600_000
    rows = [(h, f"R{i:04}", i * hour // 40 if i else None, 0, None) for h in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "host string, id string, created_ms bigint, next_attempt_ms bigint, delivered_ms bigint")
    got = outbox.ready_batch(df, 10, 150)
    assert sorted(((r.host or "", r.id) for r in got.collect())) == sorted((h or "", f"R{i:04}") for h in ("a", "b", None) for i in range(150))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "__chunk" in plan and got.columns == df.columns
