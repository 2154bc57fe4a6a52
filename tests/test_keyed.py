"""Tables kept up to date by a stream, and commits that only one run can make."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orefold.operators import commits
from orefold.streaming import feed, keyed


def test_only_one_of_many_writers_commits(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert commits.commit_numbers(spark, folder, "a") == []
    with ThreadPoolExecutor(8) as pool:
        for number in (1, 2, 3):
            won = list(pool.map(lambda i: commits.try_commit(spark, folder, "a", number, f"w{i}"), range(8)))
            assert sum(won) == 1
            assert commits.read_commit(spark, folder, "a", number) == f"w{won.index(True)}"
    assert commits.commit_numbers(spark, folder, "a") == [1, 2, 3]
    assert commits.commit_numbers(spark, folder, "b") == []
    assert not [n for n in commits.child_names(spark, folder) if n.startswith("_draft")]


def rows_of(table, spark):
    return {row["k"]: row["v"] for row in table.read(spark).collect()}


def test_newest_rows_stay_and_files_stay_bounded(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], every=4)
    expected, files = {}, []
    for batch_id in range(20):
        rows = [(k, batch_id * 100 + k) for k in range(batch_id % 3, 12, 3)]
        rows += [(None, batch_id)] if batch_id % 5 == 0 else []
        table.add(spark.createDataFrame(rows, "k int, v int"), batch_id, "s")
        expected |= dict(rows)
        assert rows_of(table, spark) == expected
        files.append(sum(len(commits.child_names(spark, f"{table.path}/{kind}")) for kind in ("updates", "bases", "commits")))
    assert max(files[12:]) == max(files[8:12]) <= 20


def test_repeated_batches_change_nothing(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], {"v": "sum"}, every=2)
    for batch_id in (0, 1, 1, 2, 0, 2, 3, 3):
        table.add(spark.createDataFrame([(1, 10), (1, 1), (2, 5)], "k int, v bigint"), batch_id, "s")
    assert rows_of(table, spark) == {1: 44, 2: 20}
    table.add(spark.createDataFrame([], "k int, v bigint"), 4, "s")
    assert rows_of(table, spark) == {1: 44, 2: 20}
    with pytest.raises(ValueError, match="belongs to stream s"):
        table.add(spark.createDataFrame([(1, 1)], "k int, v bigint"), 5, "other")
    with pytest.raises(FileNotFoundError):
        keyed.KeyedTable(str(tmp_path / "none"), ["k"]).read(spark)


def test_a_batch_that_failed_before_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], {"v": "sum"}, every=2)
    batch = spark.createDataFrame([(1, 10)], "k int, v bigint")
    table.add(batch, 0, "s")

    def lost(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(keyed, "try_commit", lost)
        with pytest.raises(OSError):
            table.add(batch, 1, "s")
    assert rows_of(table, spark) == {1: 10}
    table.add(batch, 1, "s")
    assert rows_of(table, spark) == {1: 20}


def test_duplicates_on_a_stream_equal_those_of_the_table_and_state_shrinks(spark, tmp_path):
    folder, start = str(tmp_path / "in"), datetime(2025, 1, 1)
    days = []
    for day in range(8):
        rows = [
            (f" {day * 20 + i % 17} ", i % 3, str(start + timedelta(days=day, hours=i % 17)))
            for i in range(25)
        ]
        rows += [("hot", i % 2, str(start + timedelta(days=day))) for i in range(15)]
        rows += [("", 1, ""), (None, 1, "")]
        days.append(spark.createDataFrame(rows, "id string, v int, at string"))
    rows_table = keyed.copies_table(str(tmp_path / "rows"), "2 days", every=2)
    keys_table = keyed.copies_table(str(tmp_path / "keys"), "2 days", every=2)
    held = []
    for day in days:
        day.repartition(3).write.mode("append").csv(folder, header=True)
        stream = feed.new_files(spark, folder, day.schema, files_per_batch=2)
        keyed.keep_copies(stream, rows_table, str(tmp_path / "s1"), "at").awaitTermination()
        keyed.keep_copies(stream, keys_table, str(tmp_path / "s2"), "at", "id").awaitTermination()
        held.append(rows_table.read(spark).where("copies = 1").count())
    everything = spark.read.schema(days[0].schema).csv(folder, header=True)
    found = {row["key"]: row["copies"] for row in keyed.repeated_keys(spark, keys_table).collect()}
    wanted = everything.where("id IS NOT NULL").groupBy(F.trim("id").alias("key")).count().where("count > 1")
    assert found == {row["key"]: row["count"] for row in wanted.collect()}
    assert found["hot"] == 120
    extra = keyed.duplicate_count(spark, rows_table).first()[0]
    assert extra == everything.count() - everything.distinct().count()
    assert max(held) == max(held[:4])
