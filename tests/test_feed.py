"""A feed that sets bad files aside and goes on."""

from __future__ import annotations

from pyspark.sql import types as T

from orefold.plans import medallion as M
from orefold.streaming import feed

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("region", "amount")])
GOOD = "region,amount\n" + "".join(f"r{i % 2},{i}.5\n" for i in range(6))


def outcomes(spark, target):
    return {
        row["path"].split("/in/")[1]: (row["state"], row["rows"], row["attempts"])
        for row in feed.file_outcomes(spark, target).collect()
    }


def test_a_bad_file_is_set_aside_and_the_feed_goes_on(spark, tmp_path, monkeypatch):
    folder, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "x").mkdir(parents=True)
    assert outcomes(spark, target) == {}
    (folder / "a.csv").write_text(GOOD)
    (folder / "x" / "a.csv").write_text(GOOD.replace("r1", "r7"))
    (folder / "x" / "empty.csv").write_text("")
    (folder / "faulty.csv").write_text(GOOD)
    run_file = M.run_file

    def sometimes(spark, path, target, gates):
        if "faulty" in path:
            raise RuntimeError("the disk went away\nand more")
        return run_file(spark, path, target, gates)

    monkeypatch.setattr(M, "run_file", sometimes)

    def start():
        feed.refine_new_files(spark, str(folder), SCHEMA, target, state).awaitTermination()

    start()
    first = {
        "a.csv": ("SUCCESS", 6, 1),
        "x/a.csv": ("SUCCESS", 6, 1),
        "x/empty.csv": ("EMPTY", 0, 1),
        "faulty.csv": ("QUARANTINED", 0, 1),
    }
    assert outcomes(spark, target) == first
    found = feed.file_outcomes(spark, target).where("state = 'QUARANTINED'").first()
    assert found["message"] == "the disk went away" and found["target"] is None
    (folder / "later.csv").write_text(GOOD)
    (folder / "x" / "empty.csv").write_text(GOOD)
    start()
    assert outcomes(spark, target) == first | {"later.csv": ("SUCCESS", 6, 1)}
    monkeypatch.setattr(M, "run_file", run_file)
    retried = feed.retry_quarantined(spark, str(folder), SCHEMA, target)
    assert sorted(path.split("/in/")[1] for path in retried) == ["faulty.csv", "x/empty.csv"]
    assert outcomes(spark, target)["faulty.csv"] == ("SUCCESS", 6, 2)
    assert outcomes(spark, target)["x/empty.csv"] == ("SUCCESS", 6, 2)
    assert feed.retry_quarantined(spark, str(folder), SCHEMA, target) == {}
