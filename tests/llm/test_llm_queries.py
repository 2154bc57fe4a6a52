"""The registered queries against their SQL, their contracts' columns, the pipeline."""

from __future__ import annotations

import pytest

import corpus_pipeline
from orefold.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import brute_removals, plain_fingerprint
from tests.oracle import difference, oracle, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "page_id url text n_chars",
    "op2": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4": "doc_id fingerprint component_id",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id held_out score predicted",
    "op9": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, name):
    found = spark_rows(QUERIES[name](spark, SF_DIR))
    assert difference(found, oracle_rows(oracle(SF_DIR), ORACLE[name])) is None


OF_PAIRS = {"op11_source_divergence", "op12_hard_negatives", "op13_nearest_neighbours"}


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in OF_PAIRS])
def test_one_row_per_input_row(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    table = "pages" if name.startswith("op1_") else "documents"
    wanted = COLUMNS.get(name.split("_")[0], "doc_id").split()
    assert set(wanted) <= set(found.columns)
    rows = found.collect()
    ids = spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(wanted[0]).collect()
    assert {row[wanted[0]] for row in rows} == {row[0] for row in ids}
    if not name.startswith("op3_"):
        assert len(rows) == len(ids)
    for row in rows:
        if "score" in found.columns:
            assert 0 <= row["score"] <= 1
        if "predicted" in found.columns:
            limit = 0.3 if name.startswith("op8_") else 0.5
            assert row["predicted"] == int(row["score"] >= limit)


def test_pipeline_equals_brute_force(spark):
    """Each stage's decisions, made plainly, on the smallest table."""
    from orefold.llm import decontaminate
    from orefold.llm.host_rules import measure

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    kept = {}
    for row in docs.collect():
        n, *_, repeats = measure(row["text"].encode())
        if n >= 50 and 100 * repeats <= 50 * n:
            kept[row["doc_id"]] = row["text"]
    prints = {i: plain_fingerprint(text) for i, text in kept.items()}
    root = {i: i for i in kept}
    for _ in range(20):
        for a in root:
            for b in root:
                if root[b] < root[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b]
    kept = {i: text for i, text in kept.items() if root[i] == i}
    removed = {i: row[1] for i, row in brute_removals(kept.items()).items()}
    texts = {row["doc_id"]: row["text"] for row in found}
    assert set(texts) <= set(kept)
    for i, text in texts.items():
        assert 0 <= len(text.encode()) - (len(kept[i].encode()) - removed[i]) <= 6 * removed[i]
        assert (text == kept[i]) == (removed[i] == 0)
    rest = spark.createDataFrame(
        [(i, kept[i]) for i in set(kept) - set(texts)], "doc_id bigint, text string"
    )
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert all(r["contaminated"] for r in decontaminate.contamination(rest, benchmark).collect())
    clean = spark.createDataFrame([(r["doc_id"], r["text"]) for r in found], rest.schema)
    assert not any(
        r["contaminated"] for r in decontaminate.contamination(clean, benchmark).collect()
    )
    assert all(row["n_chars"] == len(row["text"]) for row in found)


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
