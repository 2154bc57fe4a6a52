"""Places without loss, the fingerprint tree, and increments that read what they bring."""

from __future__ import annotations

import datetime as dt
import os
import threading
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators import filetree, incremental as I
from orefold.operators.places import decode_place, encode_place
from orefold.plans import medallion as M
from orefold.session import scratch_path

MOMENT = dt.datetime(2026, 10, 25, 0, 30, 0, 123456)
PLACES = [
    ("timestamp", [MOMENT, MOMENT + dt.timedelta(microseconds=1)]),
    ("timestamp_ntz", [MOMENT, MOMENT + dt.timedelta(microseconds=1)]),
    ("date", [dt.date(2026, 1, 1), dt.date(2026, 1, 2)]),
    ("decimal(38,10)", [Decimal("12345678901234567890.0000000001"), Decimal("12345678901234567890.0000000002")]),
    ("double", [0.1, 0.1 + 2**-55]),
    ("float", [0.1, 0.2]),
    ("bigint", [2**62, 2**62 + 1]),
    ("string", ["a\"\n\\é", "a\"\n\\ê"]),
    ("binary", [b"\x00\xff", b"\x00\xff\x00"]),
    ("boolean", [False, True]),
]


@pytest.mark.parametrize("kind,values", PLACES)
def test_places_keep_every_bit(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    kinds = df.select(F.struct("k").alias("p")).schema["p"].dataType
    stored = df.select(F.struct("k").alias("p")).orderBy("k").select(encode_place(F.col("p"), kinds)).first()[0]
    last = decode_place(stored, kinds)
    assert df.where(F.col("k") == last[0]).count() == 1
    later = df.where(I.beyond(["k"], last)).collect()
    assert [row.k for row in later] == [df.agg(F.max("k")).first()[0]]


def test_places_of_other_types_are_refused(spark):
    df = spark.range(1)
    stored = df.select(encode_place(F.struct("id"), df.schema)).first()[0]
    with pytest.raises(ValueError, match="bigint"):
        decode_place(stored, df.select(F.col("id").cast("string")).schema)
    nested = df.select(F.array("id").alias("a"))
    with pytest.raises(ValueError, match="plain"):
        encode_place(F.struct("id"), nested.schema)


def test_null_places_come_first(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 0)], "a int, b int")
    assert df.where(I.beyond(["a", "b"], [None, F.lit(1)])).count() == 3
    assert df.where(I.beyond(["a", "b"], [None, None])).count() == 4
    assert df.where(I.beyond(["a", "b"], [F.lit(1), None])).count() == 1


def test_increments_by_microseconds(spark):
    rows = [(i, MOMENT + dt.timedelta(microseconds=i)) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, at timestamp").select(F.col("id").cast("string").alias("id"), "at")
    target, checkpoints = scratch_path(spark, "micro"), scratch_path(spark, "micro-checkpoints")
    run = lambda table, name: M.run_incremental(table, "s", ["at"], target, checkpoints, name)
    assert run(df.where("id < 3"), "E1")[0] == "READY"
    assert run(df.where("id < 3"), "E2")[0] == "SKIPPED_IDEMPOTENT"
    status, done = run(df.where("id < 5"), "E3")
    assert status == "READY" and spark.read.parquet(done.silver).count() == 2
    assert run(df.where("id <> 1"), "E4")[0] == "CHANGED_NOT_APPENDED"


def test_nested_times_differ_by_microseconds(spark):
    rows = [([MOMENT],), ([MOMENT + dt.timedelta(microseconds=1)],)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, f"a array<{kind}>")
        assert df.select(V.row_digest(df, ["a"])).distinct().count() == 2


def test_new_rows_count_copies(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    now = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, None), (2, "c"), (2, "c")], "k int, v string"
    )
    found = sorted(map(tuple, I.new_rows(now, before).collect()), key=repr)
    assert found == [(1, "a"), (2, "c"), (2, "c"), (None, None)]
    plan = I.new_rows(now, before)._jdf.queryExecution().optimizedPlan().toString()
    assert "Except" not in plan


def _write(folder, name, rows, header="id,amount"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(header + "\n" + "".join(f"{i},{v}\n" for i, v in rows))
    return path


def test_an_increment_reads_only_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    first = _write(folder, "2026/a.csv", [(1, 10), (2, 20)])
    _write(folder, "2026/b+ c%20.csv", [(3, 30)])
    target, checkpoints = str(tmp_path / "out"), str(tmp_path / "checkpoints")

    def run(name, **more):
        status, done, read = M.run_incremental_files(
            spark, str(folder), "s", [F.col("id").cast("int")], target, checkpoints, name, **more
        )
        ids = [] if done is None else sorted(int(r.id) for r in spark.read.parquet(done.silver).collect())
        return status, ids, sorted(path.rsplit("/", 1)[1] for path in read)

    assert run("E1") == ("READY", [1, 2, 3], ["a.csv", "b+ c%20.csv"])
    assert run("E2") == ("SKIPPED_IDEMPOTENT", [], [])
    _write(folder, "2027/c.csv", [(4, 40), (5, 50)])
    # Of equal length and time, so the listing shows no change: the file is not opened.
    known = os.stat(first)
    first.write_text(first.read_text().replace("10", "99"))
    os.utime(first, ns=(known.st_atime_ns, known.st_mtime_ns))
    assert run("E3") == ("READY", [4, 5], ["c.csv"])
    status, ids, read = run("E4", verify=True)
    assert (status, len(read)) == ("CHANGED_NOT_APPENDED", 3)
    first.write_text(first.read_text().replace("99", "10"))
    os.utime(first, ns=(known.st_atime_ns, known.st_mtime_ns))
    assert run("E5", verify=True)[0] == "SKIPPED_IDEMPOTENT"

    late = _write(folder, "2027/late.csv", [(0, 1), (6, 60)])
    assert run("E6") == ("CHANGED_NOT_APPENDED", [], ["late.csv"])
    late.unlink()
    _write(folder, "2027/c.csv", [(4, 40), (5, 50), (7, 70)])
    assert run("E8") == ("READY", [7], ["c.csv"])
    status, ids, read = run("E10", force=True)
    assert (status, ids, len(read)) == ("READY", [1, 2, 3, 4, 5, 7], 3)
    moved = _write(folder, "2028/moved.csv", [(1, 10), (2, 20), (8, 80)])
    first.unlink()
    assert run("E11") == ("READY", [8], ["moved.csv"])
    moved.unlink()
    assert run("E12") == ("CHANGED_NOT_APPENDED", [], [])


def test_the_tree_says_what_changed(spark, tmp_path):
    folder = tmp_path / "tree"
    for name in ("a/1.csv", "a/2.csv", "b/1.csv", "c/1.csv"):
        _write(folder, name, [(1, 2), (3, len(name))])
    read = lambda paths: M.read_with_ragged_flag(spark, paths, with_path=True)
    none = filetree.read_tree(spark, str(tmp_path / "none"))

    def leaves(tree):
        listing = filetree.list_files(spark, str(folder))
        return filetree.file_state(listing, tree, read, "s", ["id"])

    before = leaves(none)
    _write(folder, "a/2.csv", [(1, 2), (4, 7)])
    _write(folder, "b/1.csv", [(1, 2), (3, 70)])
    (folder / "c/1.csv").unlink()
    _write(folder, "d/1.csv", [])
    now = leaves(before.leaves)
    assert {p.split("/tree/")[1] for p in now.read_paths} == {"a/2.csv", "b/1.csv", "d/1.csv"}
    found = {
        (r.level, r.path.split("/tree/")[-1]): (r.state, r.rows_now)
        for r in filetree.tree_changes(before.leaves, now.leaves).collect()
    }
    assert found[("table", "")] == ("CHANGED", 6)
    assert found[("file", "a/1.csv")] == ("SAME", 2) and found[("folder", "a")] == ("CHANGED", 4)
    assert found[("file", "b/1.csv")][0] == "CHANGED"
    assert found[("folder", "c")] == ("REMOVED", None) and found[("file", "d/1.csv")] == ("ADDED", 0)


def test_every_path_has_its_own_run_name():
    paths = ["/in/a/b.csv", "/in/a__b.csv", "/in/a_b.csv", "/in/a_2fb.csv", "/in/a b.csv", "/in/é.csv"]
    names = [M.run_name(f"file:{path}", "/in/") for path in paths]
    assert len(set(names)) == len(paths) and not any("/" in name for name in names)


def test_of_two_racing_runs_one_counts(spark, tmp_path, monkeypatch):
    target, checkpoints = str(tmp_path / "out"), str(tmp_path / "checkpoints")
    table = spark.range(40).select("id", (F.col("id") % 4).alias("kind"))
    both, run_table = threading.Barrier(2), M.run_table

    def together(*args):
        done = run_table(*args)
        both.wait(timeout=120)
        return done

    def run(rows, name):
        return M.run_incremental(rows, "s", ["id"], target, checkpoints, name)[0]

    monkeypatch.setattr(M, "run_table", together)
    with ThreadPoolExecutor(2) as pool:
        ended = dict(zip("ab", pool.map(lambda name: run(table.limit(30), name), "ab")))
    assert sorted(ended.values()) == [I.OVERTAKEN, I.READY]
    winner = min(ended, key=lambda name: ended[name] != I.READY)
    assert I.committed_runs(spark, checkpoints, "s") == [winner]
    assert os.listdir(target) == [winner]
    monkeypatch.setattr(M, "run_table", run_table)
    assert run(table, "c") == I.READY
    assert I.committed_runs(spark, checkpoints, "s") == [winner, "c"]
    silver = spark.read.parquet(*[f"{target}/{name}/silver" for name in (winner, "c")])
    assert silver.count() == silver.select("id").distinct().count() == 40


def test_a_clock_that_is_behind_does_not_hide_a_checkpoint(spark, tmp_path):
    path, rows = str(tmp_path / "checkpoints"), spark.range(5)
    status = lambda df: I.incremental_status(
        I.source_state(df, "s", ["id"]), I.read_checkpoints(spark, path), force=True
    )
    assert I.commit_checkpoint(status(rows), "z", path, "s", 0, "2999-01-01 00:00:00.000")
    previous = I.read_checkpoints(spark, path).first()["updated_at"]
    assert previous == "2999-01-01 00:00:00.001"
    assert not I.commit_checkpoint(status(rows), "late", path, "s", 0)
    assert I.commit_checkpoint(status(spark.range(9)), "a", path, "s", I.checkpoint_number(spark, path, "s"), previous)
    newest = I.read_checkpoints(spark, path).first()
    assert (newest["execution_id"], newest["processed_row_count"]) == ("a", 9)
