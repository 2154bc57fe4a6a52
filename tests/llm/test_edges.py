"""Every operator on awkward rows, on clashing names, and on empty tables."""

from __future__ import annotations

import hashlib

import pytest

from orefold.llm import (
    decontaminate,
    host_rules,
    html_extract,
    langid,
    line_crf,
    mixing,
    simhash,
    suffix_dedup,
    token_count,
    toxicity,
)
from tests.llm import edges

OPERATORS = {
    "removals": lambda docs, spark: suffix_dedup.removals(docs),
    "mixed": lambda docs, spark: mixing.mixed(docs),
    "near_duplicates": lambda docs, spark: simhash.near_duplicates(docs),
    "line_crf": lambda docs, spark: line_crf.classify(docs, edges.labels(spark)),
    "judge": lambda docs, spark: host_rules.judge(docs),
    "contamination": lambda docs, spark: decontaminate.contamination(
        docs, edges.benchmark(spark)
    ),
    "toxicity": lambda docs, spark: toxicity.detect(docs, edges.labels(spark)),
    "langid": lambda docs, spark: langid.identify(docs),
    "token_counts": lambda docs, spark: token_count.token_counts(docs),
}
PASSED_ON = {
    "keep_documents": lambda docs, spark: host_rules.keep_documents(docs),
    "keep_first": lambda docs, spark: simhash.keep_first(docs),
    "remove_repeats": lambda docs, spark: suffix_dedup.remove_repeats(docs),
    "keep_clean": lambda docs, spark: decontaminate.keep_clean(docs, edges.benchmark(spark)),
    "mixed": lambda docs, spark: mixing.mixed(docs, keep=docs.columns),
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_and_clashing_names_change_nothing(spark, name):
    found = rows(OPERATORS[name](edges.documents(spark), spark))
    ids, given = [repr(row[0]) for row in found], [repr(row[0]) for row in edges.ROWS]
    assert set(ids) == set(given) if name == "mixed" else sorted(ids) == sorted(given)
    assert rows(OPERATORS[name](edges.clashing(spark), spark)) == found


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](edges.empty(spark), spark).collect() == []


@pytest.mark.parametrize("name", PASSED_ON)
def test_rows_pass_with_all_columns(spark, name):
    docs = edges.clashing(spark)
    found = PASSED_ON[name](docs, spark)
    replaced = [n for n in docs.columns if not (name == "mixed" and n in mixing.COLUMNS)]
    assert found.columns[: len(replaced)] == replaced
    given = {(row[0], row[1]) for row in edges.ROWS}
    got = {(row["doc_id"], row["text"]) for row in found.collect()}
    if name == "remove_repeats":
        assert {i for i, _ in got} == {i for i, _ in given}
    else:
        assert got <= given
    assert PASSED_ON[name](edges.empty(spark), spark).collect() == []


def test_defined_results(spark):
    docs = edges.documents(spark)
    nothing = hashlib.sha256(b"").hexdigest()
    removed = {row["doc_id"]: row for row in suffix_dedup.removals(docs).collect()}
    assert (removed[2]["n_bytes"], removed[2]["kept_sha256"]) == (0, nothing)
    assert removed[7]["n_removed"] == len(edges.PASSAGE)
    assert removed[6]["n_removed"] == removed[10]["n_removed"] == 0
    assert removed[5]["n_bytes"] - removed[5]["n_removed"] == len(edges.LONG) // 3000

    near = {(r["doc_id"], r["fingerprint"], r["component_id"])
            for r in simhash.near_duplicates(docs).collect()}
    zero = {row for row in near if row[1] == "0" * 16}
    assert {row[0] for row in zero} == {2, 3, 4, None} and {row[2] for row in zero} == {2}
    assert {row[2] for row in near if row[0] in (9, 10)} == {9}

    judged = {row["doc_id"]: row for row in host_rules.judge(docs).collect()}
    assert judged[2]["n_words"] == 0 and judged[2]["base_failed"] and not judged[2]["kept"]
    assert judged[4]["host"] is None and judged[8]["word_chars"] == 40 * 7

    hit = {row["doc_id"]: row for row in
           decontaminate.contamination(docs, edges.benchmark(spark)).collect()}
    assert hit[9]["n_hit"] == 1 and hit[9]["n_items"] == 1
    assert hit[1]["n_hit"] == 60 and not hit[2]["contaminated"]
    assert hit[5]["contaminated"] and hit[5]["n_items"] == 0

    counts = {row["doc_id"]: row["n_tokens"] for row in token_count.token_counts(docs).collect()}
    assert counts[2] == counts[3] == 0 and counts[9] == counts[10] > 0

    spoken = {row["doc_id"]: row for row in langid.identify(docs).collect()}
    assert all(spoken[i]["lang_pred"] == "und" and spoken[i]["score"] == 0 for i in (2, 3, 4))


def test_without_labels(spark):
    none = edges.labels(spark).where("false")
    docs = edges.documents(spark)
    assert {r["score"] for r in toxicity.detect(docs, none).collect()} == {0.0}
    assert {r["score"] for r in line_crf.classify(docs, none).collect()} == {0.5}


def test_pages(spark):
    given = [
        (1, "u", None),
        (2, None, ""),
        (3, "u", "no markup &amp; <nothing"),
        (None, "u", "<p>open <b>tags <div>and <!-- a comment that never ends"),
        (3, "u", "<html><script>never closed"),
    ]
    schema = "page_id bigint, url string, html string, text string, n_chars bigint"
    pages = spark.createDataFrame([(*row, None, None) for row in given], schema)
    found = html_extract.extract(pages).collect()
    assert len(found) == 5
    texts = {(row["page_id"], row["url"]): row for row in found}
    assert texts[(2, None)]["text"] == "" and texts[(1, "u")]["n_chars"] == 0
    assert all(row["n_chars"] == len(row["text"]) for row in found)
    assert html_extract.extract(pages.where("false")).collect() == []


def test_clean_rows_that_share_an_id_with_a_contaminated_one_stay(spark):
    leaked = "two three four five six seven eight nine ten eleven and more"
    given = [(None, leaked), (None, "clean without an id"), (None, None), (None, ""),
             (1, leaked), (1, "clean under the same id"), (2, "clean by itself")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
    found = rows(decontaminate.keep_clean(docs, edges.benchmark(spark)))
    assert found == sorted((row for row in given if row[1] != leaked), key=repr)


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    text = [" ".join(f"{topic}{i}" for i in range(40)) for topic in ("sea", "hill", "wood")]
    text.append("a word more than once is no near copy of any text of the others")
    given = [(1, text[0], "x"), (1, text[0], "x"), (1, text[0], "y"), (2, text[0], "x"),
             (None, text[0], "x"), (None, text[1], "z"), (None, text[1], "x"), (3, text[2], "x"),
             (5, text[2], "x"), (5, text[3], "x"), (None, None, "a"), (None, "", "a")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, source string").repartition(3)
    found = rows(simhash.keep_first(docs))
    empty = [row for row in found if not row[1]]
    assert len(empty) == 1 and empty[0][0] is None
    assert [row for row in found if row[1]] == sorted(
        [(1, text[0], "x"), (3, text[2], "x"), (5, text[3], "x"), (None, text[1], "x")], key=repr)
