"""The run log: appending again, and two writers at the same time."""

from morrow.sources import tables


def test_two_writers_with_one_run_leave_one_row(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int")
    late = spark.createDataFrame([("b", 3), ("c", 4)], "run_id string, v int")
    tables.append_runs(log, runs)
    with monkeypatch.context() as patch:
        # The other writer looked at the log before the rows above were there.
        patch.setattr(tables, "_log_rows", lambda spark, path: None)
        tables.append_runs(log, late)
    assert spark.read.parquet(log).count() == 4
    tables.append_runs(log, late)
    assert spark.read.parquet(log).count() == 4
    found = tables.read_runs(spark, log)
    assert found.columns == ["run_id", "v"]
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1), ("b", 2), ("c", 4)]
