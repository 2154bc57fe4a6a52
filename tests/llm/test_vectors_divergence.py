"""Divergence, hard negatives and neighbours against plain loops, on awkward tables too."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orefold.llm import divergence, hard_negatives, vantage
from tests.llm import edges

VECTORS = "vec_id bigint, embedding array<double>, label int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_divergence(table, least, ranks=10):
    """Ids, texts, languages and sources to the contract's rows, by dense loops."""
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in table:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    found = []
    for lang in documents:
        kept = sorted(term for term, n in documents[lang].items() if n >= least)
        sources = {s: counts for (of, s), counts in groups.items() if of == lang}
        everything = sum(sources.values(), Counter())

        def shares(counts, kept=kept):
            below = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // below for t in kept}

        p = {s: shares(counts) for s, counts in sources.items()}
        q = shares(everything)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            typical = [
                (t, apart(p[s][t], q[t])) for t in kept if sources[s][t] and p[s][t] > q[t]
            ]
            for part, items, most in (("pair", pairs, None), ("term", typical, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items[:most], 1):
                    found.append((lang, s, part, item, value, rank))
    return sorted(found, key=repr)


def test_divergence_equals_dense_loops(spark):
    found = rows(divergence.audit(edges.clashing(spark), min_documents=2))
    assert found == plain_divergence(edges.ROWS, 2)
    bounds = {"vocabulary": 7, "cell_terms": 3, "cell_sources": 1}
    found = rows(divergence.audit(edges.documents(spark), min_documents=1, **bounds))
    assert found == plain_divergence(edges.ROWS, 1)


def test_divergence_of_nothing_kept(spark):
    assert divergence.audit(edges.empty(spark)).collect() == []
    found = rows(divergence.audit(edges.documents(spark), min_documents=100))
    assert found == plain_divergence(edges.ROWS, 100)
    assert found and {(row[2], row[4]) for row in found} == {("pair", 0)}


def test_tasks_hand_on_few_rows(spark, monkeypatch):
    """Terms that documents share or repeat must not reach the vectorizer each time."""
    table = [
        (i, "alpha beta " * 300 + f"only{chr(97 + i % 26)}", "en", f"s{i % 2}") for i in range(200)
    ]
    written = {}
    whole = divergence.materialize

    def kept(df, label="stage"):
        return written.setdefault(label, whole(df, label))

    monkeypatch.setattr(divergence, "materialize", kept)
    columns = "doc_id bigint, text string, lang string, source string"
    documents = spark.createDataFrame(table, columns).coalesce(1)
    assert rows(divergence.audit(documents, min_documents=5)) == plain_divergence(table, 5)
    lists = [n for n, kind in written["terms"].dtypes if kind == "array<string>"]
    strings = sum(len(x) for row in written["terms"].select(*lists).collect() for x in row)
    assert strings < 1000


def test_bags_have_the_counts_of_the_texts():
    random = np.random.default_rng(4)
    words = [f"{'xyz'[i % 3] * (1 + i // 9)}{chr(97 + i % 9)}" for i in range(600)]
    texts = [
        " ".join(words[int(i)] for i in random.zipf(1.3, 400) if i < 600) for _ in range(60)
    ]
    texts += ["", "...", words[0] * 3000, f"{words[1]} " * 5000]
    langs = [["de", "en", ""][i % 3] for i in range(len(texts))]
    sources = [f"s{i % 5}" for i in range(len(texts))]
    counts, having = Counter(), Counter()
    for text, *group in zip(texts, langs, sources):
        found = [f"{word}\0{group[0]}" for word in re.findall("[a-z]+", text)]
        counts.update((*group, word) for word in found)
        having.update(set(found))
    for held in (1, 3000, 1 << 20):
        bags, given = divergence.Bags(4, held), []
        for at in range(0, len(texts), 7):
            part = slice(at, at + 7)
            found = divergence.terms_of(pa.array(texts[part]), pa.array(langs[part]))
            given += bags.add(zip(langs[part], sources[part]), found)
        given += bags.rows()
        table = pa.Table.from_batches(given).to_pylist()
        assert all(max(len(row["terms"]), len(row["bag"])) <= 256 for row in table)
        summed, seen = Counter(), Counter()
        for row in table:
            seen.update(row["terms"])
            for word in row["bag"]:
                summed[row["lang"], row["source"], word] += 1 << row["place"]
        assert summed == counts
        assert set(seen) == set(having)
        assert all(min(seen[word], 4) == min(having[word], 4) for word in having)
        assert {(row["lang"], row["source"]) for row in table if row["lang"] is not None} == set(
            zip(langs, sources)
        )


def test_cutting_needs_little_memory():
    texts = pa.array(["lorem ipsum dolor sit amet " * 100] * 1000)
    tags = pa.array(["en"] * 1000)
    divergence.terms_of(texts[:1], tags[:1])
    tracemalloc.start()
    try:
        divergence.terms_of(texts, tags)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * texts.nbytes


def test_shares_beyond_64_bits():
    counts = np.array([3, 10**12, 0])
    below = np.array([2 * 10**12 + 4] * 3)
    assert divergence.shares(counts, below).tolist() == [
        1 + 10**9 * (int(n) + 2) // int(d) for n, d in zip(counts, below)
    ]


def plain_negatives(table):
    given = []
    for vec_id, vector, label in table:
        if vector is None or label is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        given.append((vec_id, [math.floor(256 * x) for x in vector], label))
    last = lambda i: (i is None, i or 0)
    found = []
    for at, (anchor, vector, label) in enumerate(given):
        if anchor is None or anchor % 100:
            continue
        scored = [
            (sum(x * y for x, y in zip(vector, other)), vec_id, own)
            for i, (vec_id, other, own) in enumerate(given)
            if i != at
        ]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for score, positive, _ in [x for x in scored if x[2] == label][:5]:
            window = [
                x for x in scored if x[2] != label and 30 * score <= 100 * x[0] <= 90 * score
            ]
            for rank, (negative_score, negative, _) in enumerate(window[:10], 1):
                found.append((anchor, positive, rank, negative, score, negative_score))
    return sorted(found, key=repr)


def awkward_vectors(count=420, width=6):
    random = np.random.default_rng(3)
    centres = random.normal(0, 1, (4, width))
    table = []
    for i in range(count):
        label = int(random.integers(4))
        vector = np.round(centres[label] + random.normal(0, 0.7, width), 1).tolist()
        table.append((i, vector, label))
    copies = [(1000 + i, table[0][1], 1 + i % 2) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    return [
        *table,
        *copies,
        table[100],
        table[100],
        table[7],
        (None, table[1][1], 2),
        (None, table[2][1], None),
        (2000, None, 1),
        (2100, [1.0, None, 2.0], 1),
        (2200, [1.0, nan], 1),
        (2300, [inf, 1.0], 1),
        (2400, [], 1),
        (2500, [0.0] * width, 2),
        (2600, [0.5, 0.5], 2),
        (2700, table[5][1], None),
        (-100, table[9][1], 3),
    ]


@pytest.mark.parametrize("sizes", [(8192, 256), (40, 2)])
def test_hard_negatives_equal_plain_loops(spark, sizes):
    table = awkward_vectors()
    vectors = spark.createDataFrame(table, VECTORS).repartition(5)
    found = rows(hard_negatives.mine(vectors, tile=sizes[0], block=sizes[1]))
    assert found == plain_negatives(table)


def test_large_components_are_scored_exactly(spark):
    random = np.random.default_rng(1)
    for scale in (3e3, 1.2e6):
        table = [
            (i * 25, (random.normal(0.5, 1, 5) * scale).tolist(), i % 3) for i in range(40)
        ]
        table.append((4000, [1e300, 0.0, 0.0, 0.0, 0.0], 1))
        found = rows(hard_negatives.mine(spark.createDataFrame(table, VECTORS), tile=9, block=4))
        assert found and found == plain_negatives(table[:-1])


def test_the_tree_leaves_candidates_unscored():
    random = np.random.default_rng(5)
    centres = random.normal(0, 400, (5, 8))
    points = np.round(np.repeat(centres, 200, 0) + random.normal(0, 3, (1000, 8))).astype(np.int32)
    labels = np.repeat(np.arange(5), 200)
    tile = hard_negatives.Candidates(pa.array(np.arange(1000)), labels, points)
    anchors, own = points[::20], np.arange(0, 1000, 20)
    windows = [(int(0.3 * n), int(0.9 * n)) for n in np.square(anchors.astype(int)).sum(1)]
    wanted = [[hard_negatives.Best(window, 5)] for window in windows]
    tree = hard_negatives.spanning_tree(anchors.astype(float))
    scored = hard_negatives.walk(tree, anchors, labels[::20], tile, own, wanted, False)
    assert scored < 0.3 * len(anchors) * 800
    for at, best, (low, high) in zip(own, wanted, windows):
        scores = points.astype(int) @ points[at].astype(int)
        rest = [
            (-scores[i], i)
            for i in range(1000)
            if labels[i] != labels[at] and low <= scores[i] <= high
        ]
        assert [(-s, i) for s, i in zip(best[0].scores, best[0].ids)] == sorted(rest)[:5]


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    clashing = "tile bigint, ids int, block int, score double, place int, rank int, id string"
    table = awkward_vectors(150)
    wide = spark.createDataFrame(
        [(*row, *[None] * 7) for row in table], f"{VECTORS}, {clashing}"
    )
    assert rows(hard_negatives.mine(wide)) == plain_negatives(table)


def plain_neighbours(table, most=10):
    given = []
    for vec_id, vector, _ in table:
        if vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            given.append((vec_id, vector))
    width = max(len(vector) for _, vector in given)
    points = np.array([vector + [0.0] * (width - len(vector)) for _, vector in given])
    found = []
    for at, (query, _) in enumerate(given):
        if query is None or query % 100:
            continue
        away = vantage.distances(points, points[at])
        others = [
            (away[i], vec_id is None, vec_id or 0)
            for i, (vec_id, _) in enumerate(given)
            if i != at
        ]
        for rank, (score, null, vec_id) in enumerate(sorted(others)[:most], 1):
            found.append((query, rank, None if null else vec_id, float(score)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("sizes", [(8192, 512), (100, 2)])
def test_factor_one_is_the_exact_search(spark, sizes):
    table = awkward_vectors()
    vectors = spark.createDataFrame(table, VECTORS).repartition(5)
    found = vantage.nearest_neighbours(vectors, factor=1.0, shard=sizes[0], block=sizes[1])
    assert rows(found) == plain_neighbours(table)


def test_neighbours_of_few_rows(spark):
    assert vantage.nearest_neighbours(spark.createDataFrame([], VECTORS)).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    assert vantage.nearest_neighbours(one).collect() == []
    two = [(0, [1.0], 1), (0, [4.0], 1), (5, [0.0], 1)]
    found = rows(vantage.nearest_neighbours(spark.createDataFrame(two, VECTORS)))
    assert found == [(0, 1, 0, 3.0), (0, 1, 0, 3.0)]
    with pytest.raises(ValueError):
        vantage.nearest_neighbours(one, factor=0.0)


def test_recall_of_the_default_factor(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = [tuple(row) for row in vectors.select("vec_id", "embedding", "label").collect()]
    exact, found = plain_neighbours(table), vantage.nearest_neighbours(vectors, shard=500)
    wanted = {(row[0], row[2]) for row in exact}
    got = {(row["query_id"], row["vec_id"]) for row in found.collect()}
    assert len(wanted & got) >= 0.98 * len(wanted)


def test_a_smaller_factor_compares_less():
    random = np.random.default_rng(2)
    points = random.normal(0, 1, (4000, 3))
    order, bounds = vantage.plant(points)
    assert sorted(order) == list(range(4000))
    compared = {}
    for factor in (1.0, 0.3):
        tree = vantage.Tree(points[order], bounds, order.astype(np.int64), np.zeros(4000, bool))
        seen = []
        whole = tree._compare
        tree._compare = lambda start, end, of: (  # noqa: B023
            seen.append((end - start) * len(of)), whole(start, end, of)  # noqa: B023
        )
        nearest = vantage.Nearest(points[:50], 10)
        tree.search(nearest, np.full(50, -1), factor)
        compared[factor] = sum(seen)
    assert compared[0.3] < compared[1.0] < 50 * 4000 / 3
