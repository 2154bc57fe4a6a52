"""Verdicts of hosts, scores by compression, and texts without letters, on planted rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard

from orefold.llm import host_rules, langid, toxicity
from orefold.llm.sql import HOST_RULES
from tests.oracle import difference, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.01"


def planted_hosts(good_hosts, good_docs):
    """Hosts of which every eighth document is too short, and one of which nearly all are."""
    rows = []
    for host in range(good_hosts):
        for at in range(good_docs):
            n = 20 if at % 8 == 0 else 60
            rows.append((f"good-{host}", " ".join(f"w{host}x{at}y{i}" for i in range(n))))
    for at in range(60):
        n = 60 if at % 20 == 0 else 20
        rows.append(("bad", " ".join(f"b{at}y{i}" for i in range(n))))
    rows.append((None, " ".join(f"n{i}" for i in range(60))))
    return pd.DataFrame(
        [(at, host, text) for at, (host, text) in enumerate(rows)],
        columns=["doc_id", "source", "text"],
    )


@pytest.mark.parametrize("size", [(10, 40), (200, 80)])
def test_bad_host_is_rejected_in_corpora_of_any_size(spark, size):
    table = planted_hosts(*size)
    docs = spark.createDataFrame(table, "doc_id long, source string, text string")
    found = host_rules.judge(docs)
    rows = found.collect()
    bad = [row for row in rows if row["host"] == "bad"]
    assert not any(row["kept"] for row in bad)
    assert sum(not row["base_failed"] for row in bad) == 3
    assert all(row["kept"] == (not row["base_failed"]) for row in rows if row["host"] != "bad")
    kept = {row["doc_id"] for row in host_rules.keep_documents(docs).collect()}
    assert kept == {row["doc_id"] for row in rows if row["kept"]}
    connection = duckdb.connect()
    connection.register("documents", table)
    assert difference(spark_rows(found), oracle_rows(connection, HOST_RULES)) is None


def test_no_host_is_rejected_for_chance(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = host_rules.judge(docs).collect()
    assert all(row["kept"] == (not row["base_failed"]) for row in rows)


def plain_saved(text, toxic, ordinary):
    """Bytes saved in every window of sixteen words, each with compressors made anew."""
    words, word = [], ""
    for char in text.lower() + " ":
        if char.isalpha():
            word += char
        elif word:
            words.append(word[:4].upper() + word[4:])
            word = ""
    saved = []
    for at in range(0, max(1, len(words)), 16):
        window = (" " + " ".join(words[at : at + 16]) + " ").encode()
        sizes = []
        for content in (ordinary, toxic + ordinary):
            parameters = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS)
            made = zstandard.ZstdCompressionDict(content, dict_type=1)
            made.precompute_compress(compression_params=parameters)
            coder = zstandard.ZstdCompressor(dict_data=made, compression_params=parameters)
            sizes.append(len(coder.compress(window)))
        saved.append(max(0, sizes[0] - sizes[1]))
    return saved


def test_scores_equal_plain_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = {row["doc_id"]: row for row in toxicity.detect(docs, labels).collect()}
    args = (toxicity.Training(), "doc_id", "text", "toxic")
    model = toxicity.train(docs, labels, *args)
    texts = {row["doc_id"]: row["text"] or "" for row in docs.collect()}
    for doc_id in sorted(texts)[:60]:
        saved = plain_saved(texts[doc_id], model.toxic, model.ordinary)
        x = np.log1p([max(saved), sum(saved), np.mean(saved), len(saved)])
        logit = (x - model.mean) / model.spread @ model.weights[:4] + model.weights[4]
        assert found[doc_id]["max_saved"] == max(saved)
        assert found[doc_id]["score"] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_windows_do_not_depend_on_blocks(monkeypatch):
    text = "Ein Ärgernis, two words; " * 400 + "x" * 300 + " ½ end"
    whole = list(toxicity.windows_of(text, toxicity._Heads()))
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(toxicity, "_BLOCK", block)
        assert list(toxicity.windows_of(text, toxicity._Heads())) == whole
    assert list(toxicity.windows_of("", toxicity._Heads())) == [b"  "]
    assert list(toxicity.windows_of("1 2 _", toxicity._Heads())) == [b"  "]


@pytest.mark.parametrize("rows_per_class", [300, 2000])
def test_mean_score_is_the_share_of_toxic_documents(spark, rows_per_class):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    training = toxicity.Training(rows_per_class=rows_per_class)
    rows = toxicity.detect(docs, labels, training).join(labels, "doc_id").collect()
    share = np.mean([row["toxic"] for row in rows])
    assert abs(np.mean([row["score"] for row in rows]) - share) < 0.02


def test_numerals_are_no_letters(spark):
    assert not any(map(langid.has_letter, ["", "12 ½ ²", "Ⅷ ①", "_-"]))
    assert langid.has_letter("1 é") and langid.has_letter("语")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, "½ ²", None), (-2, "Ⅷ ①", None)], docs.schema)
    found = langid.identify(docs.union(more)).where("doc_id < 0").collect()
    assert [row["lang_pred"] for row in found] == ["und", "und"]
