"""CSV edge cases, the medallion flow, questions, incremental runs and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.operators import incremental as I
from orefold.operators import ledger as L
from orefold.operators import questions as N
from orefold.operators.profile import dimension_values
from orefold.operators.roles import ColumnRole
from orefold.operators.series import monthly_series
from orefold.plans.medallion import Gates, run_file, run_folder, run_incremental
from orefold.plans.questions import gold_query, plan_question
from orefold.session import scratch_path, shared_dir
from orefold.sources import csv as C
from orefold.sources.files import table_fingerprint
from orefold.sources.sinks import silver_layout, write_table
from orefold.streaming import feed
from tests.conftest import DATED_SALES, by


def test_ragged_rows(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text(
        'a,b,c\n1,2,3\n4,5\n6,7,8,9\n6,7,8,\n,,\n1,2,3,4,5\n1,2,3,,5\n"x,y",2,3\n"x,y",2,3,4\n'
    )
    rows = C.read_with_ragged_flag(spark, str(path)).collect()
    assert [r[C.RAGGED] for r in rows] == [
        False, False, True, True, False, True, True, False, True
    ]
    assert rows[1].c is None and rows[7].a == "x,y"


def test_byte_order_mark_quotes_and_spaces(spark, tmp_path):
    path = tmp_path / "marked.csv"
    path.write_bytes(b'\xef\xbb\xbfid,note\n1," say ""hi"" "\n')
    df = C.read_strings(spark, str(path))
    assert df.columns == ["id", "note"]
    assert tuple(df.first()) == ("1", ' say "hi" ')
    out = str(tmp_path / "out")
    write_table(df, out, format="csv", single_file=True)
    assert tuple(C.read_strings(spark, out).first()) == ("1", ' say "hi" ')


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('id,note\n1,"a\nb"\n2,c\n')
    assert [r.note for r in C.read_strings(spark, str(path), multi_line=True).collect()] == [
        "a\nb",
        "c",
    ]


def test_folder_with_different_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,x\n1,a\n")
    (tmp_path / "two.csv").write_text("id,y\n2,b\n")
    (tmp_path / "three.csv").write_text("id,x\n3,c\n")
    (tmp_path / "skip.txt").write_text("id,x\n9,z\n")
    rows = by(C.read_folder(spark, str(tmp_path)).collect(), "id")
    assert {k: (r.x, r.y, r[C.SOURCE_FILE]) for k, r in rows.items()} == {
        "1": ("a", None, "one.csv"),
        "2": (None, "b", "two.csv"),
        "3": ("c", None, "three.csv"),
    }
    with pytest.raises(FileNotFoundError):
        C.read_folder(spark, str(tmp_path), "*.tsv")


def test_layout_and_samples(spark):
    df = spark.createDataFrame([(i, str(i), i * 1.0) for i in range(9)], "z long, a string, m double")
    assert silver_layout(df, ["m", "gone", "a"]).columns == ["m", "a", "z"]
    reference = C.dataset_reference(df, ["z"], rows=2).first()
    assert reference.row_count == 9
    assert list(reference.sample_rows) == ['{"z":0,"a":"0","m":0.0}', '{"z":1,"a":"1","m":1.0}']


def test_fingerprint_ignores_order_not_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, s string")
    print_of = lambda d: tuple(table_fingerprint(d).first())
    assert print_of(df) == print_of(df.orderBy(F.desc("i")).repartition(3))
    assert print_of(df) != print_of(df.fillna("", ["s"]))


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_medallion_flow(spark, samples):
    run = run_file(spark, samples["sales"], scratch_path(spark, "run"))
    assert run.stopped_by is None and run.quality["status"] == "PASS" and run.validation["valid"]
    gold = spark.read.parquet(run.gold["analytics"])
    assert gold.count() == 9
    assert {r._reconciliation_status for r in gold.collect()} == {"PASS"}
    assert spark.read.parquet(run.gold["time_series"]).count() == 6
    assert spark.read.parquet(run.silver).columns[0] == "transaction_id"


def test_gates_stop_before_anything_is_written(spark, samples):
    strict = Gates(stop_on_quality_failure=True)
    run = run_file(spark, samples["customers"], scratch_path(spark, "run"), strict)
    assert (run.stopped_by, run.silver, run.gold) == ("QUALITY", None, {})
    first_key = Gates(stop_on_validation_failure=True, primary_only=False)
    run = run_file(spark, samples["customers"], scratch_path(spark, "run"), first_key)
    assert run.stopped_by == "VALIDATION"


def test_question_end_to_end(spark, read):
    sales = read("sales")
    query = plan_question(sales, "Compare Spade vs Rake quantity by product for each city in Garden")
    assert query.compare == ("product", ("Spade", "Rake"))
    assert (query.metric, query.mode, query.child) == ("quantity", "COMPARE", "product")
    assert query.filters == {"product": "Spade", "category": "Garden"}
    answer = gold_query(sales, query)
    assert {r.value: r.total for r in answer["comparison"].collect()} == {
        "spade": 7.0,
        "rake": 11.0,
    }
    assert {r.value for r in answer["product_breakdown"].collect()} == {"Spade", "Rake"}
    assert answer["detail_size"].first().row_count == 13
    plain = plan_question(sales, "what happened")
    assert plain.dimensions == ("product", "category", "city") and not plain.filters


@pytest.mark.parametrize("prefix", [1, 2, 8])
def test_value_links_match_brute_force(spark, prefix, monkeypatch):
    monkeypatch.setattr(N, "STRETCH", prefix)
    monkeypatch.setattr(N, "_SHORT_PIECE", 3 + prefix)
    monkeypatch.setattr(N, "_LONG_PIECE", 17)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC ") for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    names = sorted({"".join(rng.choice("ABc ") for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    names = [n for n in names if n.strip()]
    questions = spark.createDataFrame(list(enumerate(texts + [None])), "id int, q string")
    values = spark.createDataFrame([(f"d{i % 2}", n) for i, n in enumerate(names)], "dimension string, value string")
    found = N.mentioned_values(questions, "id", "q", values).collect()
    expected = {
        (i, f"d{n % 2}", name)
        for i, text in enumerate(texts)
        for n, name in enumerate(names)
        if name.lower() in text.lower()
    }
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_no_values_no_links(spark, read):
    questions = spark.createDataFrame([(0, "abc")], "id int, q string")
    values = dimension_values(read("sales").limit(0), ["city"])
    assert N.question_filters(questions, "id", "q", values).count() == 0


def test_checkpoints_keep_the_newest_state(spark):
    path = scratch_path(spark, "checkpoints")
    current = spark.createDataFrame([("a.csv", 10, "1")], "source string, row_count long, fingerprint string")
    none = spark.createDataFrame([], L.CHECKPOINT_SCHEMA)
    first = I.incremental_status(current, none)
    assert tuple(first.select("status", "start_row", "rows_to_process").first()) == ("READY", 0, 10)
    I.commit_checkpoints(first, "EXEC_1", path)
    same = I.incremental_status(current, I.read_checkpoints(spark, path))
    assert same.first().status == "SKIPPED_IDEMPOTENT"
    I.commit_checkpoints(same, "EXEC_2", path)
    summary = L.checkpoint_summary(I.read_checkpoints(spark, path)).first()
    assert (summary.checkpoints, summary.latest_source, summary.any_skipped) == (1, "a.csv", True)
    grown = current.withColumns({"row_count": F.lit(12).cast("long"), "fingerprint": F.lit("2")})
    row = I.incremental_status(grown, I.read_checkpoints(spark, path)).first()
    assert (row.status, row.start_row, row.rows_to_process) == ("READY", 10, 2)
    edited = current.withColumn("fingerprint", F.lit("3"))
    row = I.incremental_status(edited, I.read_checkpoints(spark, path)).first()
    assert (row.status, row.rows_to_process) == ("CHANGED_NOT_APPENDED", 0)
    forced = I.incremental_status(edited, I.read_checkpoints(spark, path), force=True).first()
    assert (forced.status, forced.start_row, forced.rows_to_process) == ("READY", 0, 10)


def test_no_checkpoint_yet(spark):
    row = L.checkpoint_summary(spark.createDataFrame([], L.CHECKPOINT_SCHEMA)).first()
    assert (row.checkpoints, row.latest_status, row.processed_rows) == (0, "NO CHECKPOINT", 0)


def test_feed_sees_only_new_files_and_series_match(spark, tmp_path):
    folder, lines = tmp_path / "in", DATED_SALES.splitlines()
    folder.mkdir()
    (folder / "old.csv").write_text("\n".join(lines[:1] + lines[1:5]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in lines[0].split(",")])
    stream = feed.new_files(spark, str(folder), schema)
    seen = str(tmp_path / "seen")
    feed.ignore_existing(stream, seen)
    (folder / "new.csv").write_text("\n".join(lines[:1] + lines[5:]))
    (folder / "note.txt").write_text("x")
    batches = []
    handle = lambda batch, _: batches.extend(batch.select("transaction_id", C.SOURCE_FILE).collect())
    feed.start_feed(stream, handle, seen).awaitTermination()
    assert {r[C.SOURCE_FILE] for r in batches} == {"new.csv"} and len(batches) == 9

    result = str(tmp_path / "series")
    for _ in range(2):
        series = monthly_series(stream, "transaction_date", ["amount"])
        feed.keep_result(series, result, str(tmp_path / "state")).awaitTermination()
        (folder / "late.csv").write_text(f"{lines[0]}\n99,K9,Pot,Kitchen,Faro,1,5,2025-03-31\n")
    streamed = feed.latest_result(spark, result).orderBy("period").collect()
    table = C.read_strings(spark, str(folder / "*.csv"))
    expected = monthly_series(table, "transaction_date", ["amount"]).orderBy("period").collect()
    assert [tuple(r) for r in streamed] == [tuple(r) for r in expected]
    assert streamed[0].amount_sum == 170.5


def test_finished_days_leave_a_stream(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    (folder / "a.csv").write_text("ts,v\n2026-01-01 10:00:00,1\n2026-01-02 10:00:00,2\n2026-01-09 00:00:00,3\n")
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType())])
    daily = feed.daily_series(feed.new_files(spark, str(folder), schema), "ts", ["v"])
    out = []
    query = (
        daily.writeStream.outputMode("append")
        .foreachBatch(lambda batch, _: out.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert {r.period: r.v_sum for r in out} == {"2026-01-01": 1.0, "2026-01-02": 2.0}


def test_log_lines(spark):
    lines = spark.createDataFrame(
        [
            ("[2026-01-01 10:00:00] ERROR | Agent: Gold | Message: a | b",),
            ("[2026-01-01 10:00:01] PASS | Agent: Gold | fine",),
            ("noise",),
        ],
        "value string",
    )
    rows = L.parse_log(lines).collect()
    assert [(r.level, r.agent, r.message) for r in rows] == [
        ("ERROR", "Gold", "a | b"),
        ("PASS", "Gold", "fine"),
    ]


def test_step_states(spark):
    lines = [
        "2026-01-01 10:00:00,001 | INFO | STEP START | id=E1 | step=SOURCE | attempt=1/3",
        "2026-01-01 10:00:00,001 | INFO | STEP SUCCESS | id=E1 | step=SOURCE | duration=0.0s",
        "2026-01-01 10:00:01,000 | INFO | STEP START | id=E1 | step=GOLD | attempt=1/3",
        "2026-01-01 10:00:02,000 | ERROR | STEP FAILED | id=E1 | step=GOLD | attempt=1 | error=x",
        "2026-01-01 10:00:03,000 | INFO | STEP START | id=E1 | step=GOLD | attempt=2/3",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert {r.step: r.status for r in L.step_status(df).collect()} == {
        "SOURCE": "COMPLETE",
        "GOLD": "RUNNING",
    }


def test_column_names_with_dots_and_spaces(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text(
        "order id,unit.price,home city,sale.kind,order_date\n"
        + "".join(f"{i},{i}.5,c{i % 2},k{i % 3},2026-0{i % 3 + 1}-01\n" for i in range(12))
    )
    run = run_file(spark, str(path), scratch_path(spark, "names"))
    gold = spark.read.parquet(run.gold["analytics"])
    assert gold.count() == 6
    assert gold.agg(F.sum("`unit.price_sum`")).first()[0] == sum(i + 0.5 for i in range(12))
    assert spark.read.parquet(run.gold["time_series"]).count() == 3


def test_folder_of_tables(spark, samples, tmp_path):
    folder = samples["sales"].rsplit("/", 1)[0]
    runs = run_folder(spark, folder, scratch_path(spark, "folder"))
    runs = {path.rsplit("/", 1)[1]: found.run for path, found in runs.items()}
    assert set(runs) == {f"{name}.csv" for name in samples}
    assert spark.read.parquet(runs["products.csv"].gold["analytics"]).count() == 2
    assert "time_series" not in runs["products.csv"].gold


def test_incremental_runs(spark, read):
    sales = read("sales")
    target, checkpoints = scratch_path(spark, "runs"), scratch_path(spark, "checkpoints")

    def run(table, name, **more):
        return run_incremental(
            table, "sales.csv", [F.col("transaction_id").cast("int")], target, checkpoints, name, **more
        )

    first = sales.filter("int(transaction_id) <= 8")
    status, done = run(first, "E1")
    assert status == "READY" and spark.read.parquet(done.silver).count() == 8
    assert run(first, "E2") == ("SKIPPED_IDEMPOTENT", None)
    status, done = run(sales, "E3")
    assert status == "READY"
    silver = spark.read.parquet(done.silver)
    assert {r.transaction_id for r in silver.collect()} == {9, 10, 11, 12, 13}
    edited = sales.withColumn("amount", F.lit("1"))
    for name in ("E4", "E4b"):
        assert run(edited, name)[0] == "CHANGED_NOT_APPENDED"
    status, done = run(edited, "E5", force=True)
    assert spark.read.parquet(done.silver).count() == 13


def test_late_and_edited_rows_are_never_passed_over(spark, read):
    sales = read("sales")
    number = F.col("transaction_id").cast("int")
    target, checkpoints = scratch_path(spark, "runs"), scratch_path(spark, "checkpoints")
    run = lambda table, name: run_incremental(
        table, "s", [number, "customer_id"], target, checkpoints, name
    )
    assert run(sales.where(number.isin(2, 3, 9)), "E1")[0] == "READY"
    assert run(sales.where(number.isin(1, 2, 3, 9, 10)), "E2") == ("CHANGED_NOT_APPENDED", None)
    edited = sales.withColumn("amount", F.when(number == 3, "7").otherwise(F.col("amount")))
    assert run(edited.where(number.isin(2, 3, 9, 10)), "E3")[0] == "CHANGED_NOT_APPENDED"
    status, done = run(sales.where(number.isin(2, 3, 9, 10, 11)), "E4")
    assert status == "READY"
    assert {r[0] for r in spark.read.parquet(done.silver).select("transaction_id").collect()} == {10, 11}


def test_increment_is_a_filter_that_the_scan_uses(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    last = I.high_water_values(orders, ["o_orderkey"], '{"k0":100}')
    batch = orders.where(I.beyond(["o_orderkey"], last))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,100)" in plan and "Sort" not in plan and "Exchange" not in plan


def test_folder_with_bad_and_empty_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    good = "region,amount\n" + "".join(f"r{i % 2},{i}.5\n" for i in range(8))
    (tmp_path / "in" / "a.csv").write_text(good)
    (tmp_path / "in" / "deep" / "a.csv").write_text(good.replace("r1", "r9"))
    (tmp_path / "in" / "deep" / "empty.csv").write_text("")
    (tmp_path / "in" / "bad.csv").write_text("\n\n\n")
    ledger = str(tmp_path / "ledger")
    runs = run_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), ledger=ledger)
    states = {path.split("/in/")[1]: found.state for path, found in runs.items()}
    assert states == {
        "a.csv": "SUCCESS", "deep/a.csv": "SUCCESS", "deep/empty.csv": "EMPTY", "bad.csv": "FAILED"
    }
    totals = L.folder_run_totals(L.read_reports(spark, ledger)).first()
    assert (totals.files, totals.failed_files, totals.total_rows) == (4, 2, 16)


def test_without_a_shared_folder_there_is_a_clear_error(spark, monkeypatch):
    from orefold import session

    monkeypatch.setattr(session, "FOLDER_CONFS", ("orefold.none",))
    with pytest.raises(RuntimeError, match="orefold.none"):
        session.scratch_path(spark, "x")
    spark.conf.set("orefold.none", "/shared")
    assert session.scratch_path(spark, "x").startswith("/shared/orefold/")
    spark.conf.unset("orefold.none")


def test_counters_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n1,2\n,\n2,x\n")
    (folder / "b.csv").write_text("id,v\n3,4,5\n4,\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "v")])
    columns = [ColumnRole("v", "float")]
    stream = feed.new_files(spark, str(folder), schema, files_per_batch=1, flag_ragged=True)
    path = str(tmp_path / "out")
    feed.keep_result(
        feed.quality_counts(stream, columns), path, str(tmp_path / "state")
    ).awaitTermination()
    assert tuple(feed.latest_result(spark, path).first()) == (5, 1, 3, 1, 1)
    table = C.read_with_ragged_flag(spark, str(folder))
    assert tuple(feed.quality_counts(table, columns).first()) == (5, 1, 3, 1, 1)


def test_updates_keep_the_newest_row_and_free_state(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType())])
    state, path = str(tmp_path / "state"), str(tmp_path / "daily")
    for i, lines in enumerate(("2026-01-01 10:00:00,1", "2026-01-01 11:00:00,2\n2026-01-20 00:00:00,5",
                               "2026-01-20 01:00:00,6")):
        (folder / f"{i}.csv").write_text(f"ts,v\n{lines}\n")
        daily = feed.daily_series(feed.new_files(spark, str(folder), schema), "ts", ["v"])
        query = feed.keep_updates(daily, path, state)
        query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 1
    found = {r.period: r.v_sum for r in feed.current_rows(spark, path, ["period"]).collect()}
    assert found == {"2026-01-01": 3.0, "2026-01-20": 11.0}
