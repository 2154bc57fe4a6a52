"""Operators against brute force, exact tokenizers, made-up pages and held-out rows."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from orefold.llm import (
    decontaminate,
    dom,
    html_extract,
    langid,
    line_crf,
    mixing,
    simhash,
    suffix_dedup,
    token_count,
    toxicity,
)
from orefold.llm.components import connected

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(8).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def brute_removals(texts):
    """Ids and whole texts in order to the contract's columns, window by window."""
    seen, found = set(), {}
    for doc_id, text in sorted(texts):
        data = text.encode()
        removed = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                removed[at : at + 100] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~removed])
        spans = int((np.diff(np.append(0, removed.astype(int))) == 1).sum())
        found[doc_id] = (len(data), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest())
    return found


def spark_removals(df):
    return {row[0]: tuple(row)[1:] for row in suffix_dedup.removals(df).collect()}


def test_removals_equal_brute_force(docs):
    rows = [tuple(row) for row in docs.select("doc_id", "text").where("doc_id < 400").collect()]
    assert spark_removals(docs.where("doc_id < 400")) == brute_removals(rows)


def test_removals_across_buckets_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BUCKET_ROWS", 40)
    random = np.random.default_rng(3)
    words = ["".join(map(chr, random.integers(97, 123, 5))) for _ in range(60)]
    passage = " ".join(random.choice(words, 60))
    rows = [(0, "x" * 1000), (1, "x" * 350 + "y")]
    for i in range(2, 90):
        start, stop = sorted(random.integers(0, len(passage), 2))
        before = " ".join(random.choice(words, random.integers(0, 12)))
        rows.append((i, before + passage[start:stop] + "é" * int(random.integers(0, 70))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert spark_removals(df) == brute_removals(rows)


def test_one_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_TASK_ANCHORS", 200)
    passage = "this very passage is in each of the documents, " * 4
    rows = [(i, f"{i * 7919 % 1009} start {passage} end {i * 31}") for i in range(300)]
    rows += [(1000 + i, "the same text from first to last, word for word, " * 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert spark_removals(df) == brute_removals(rows)


def test_texts_of_one_id_are_told_apart_by_more_than_a_few_bits(spark):
    """Two texts of one id whose hashes end with the same 16 bits: they share a passage
    at the same place, and the longer one repeats itself beyond the other's end."""

    def version(text):
        return int.from_bytes(xxhash.xxh64_digest(text.encode(), 42), "big", signed=True)

    passage = "a passage that both of the texts hold at the same place, " * 2
    filler = " ".join(map(str, range(7000, 7060)))
    ends = {}
    for i in range(2000):
        text = f"{i:05d} {passage} the end of {i}"
        ends[version(text) & 65535] = text
    pairs = (
        (ends[end], long)
        for i in range(2000)
        if (end := version(long := f"{i:05d} {passage} {filler}, {filler} of {i}") & 65535) in ends
    )
    short, long = next(pairs)
    assert version(short) != version(long)
    for doc_id in (None, 7):
        given = [(doc_id, short), (doc_id, long), (doc_id, long), (3, f"x {filler[:150]}")]
        order = {(i is None, i or 0, version(text)): text for i, text in given}
        want = brute_removals(order.items())
        df = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
        found = [tuple(row)[1:] for row in suffix_dedup.removals(df).collect()]
        each = [want[i is None, i or 0, version(text)] for i, text in given]
        assert sorted(found) == sorted(each)
        kept = [row["text"] for row in suffix_dedup.remove_repeats(df).collect()]
        assert sorted(len(text) for text in kept) == sorted(n - cut for n, cut, *_ in each)


def test_cut_keeps_whole_characters():
    text = "aéb".encode()
    assert suffix_dedup.cut_text(text, np.array([2]), np.array([4])) == "aé"
    assert suffix_dedup.cut_text(text, np.array([1]), np.array([3])) == "ab"
    assert suffix_dedup.cut_text(text, np.array([0]), np.array([2])) == "éb"


@given(st.lists(st.binary(max_size=12), max_size=60))
@settings(max_examples=60, deadline=None)
def test_multikey_quicksort_sorts(values):
    padded = np.zeros((len(values), 16), np.uint8)
    for i, value in enumerate(values):
        padded[i, : len(value)] = np.frombuffer(value, np.uint8)
    words = padded.view(">u8").astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(words, small=2)
    assert sorted(order) == list(range(len(values)))
    ordered = [padded[i].tobytes() for i in order]
    assert ordered == sorted(ordered)


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").where("doc_id < 300").collect()
    prints = {row["doc_id"]: plain_fingerprint(row["text"]) for row in rows}
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[b] < component[a]:
                    component[a], changed = component[b], True
    found = simhash.near_duplicates(docs.where("doc_id < 300"), tile=64).collect()
    assert {row["doc_id"]: row["fingerprint"] for row in found} == {
        i: f"{value:016x}" for i, value in prints.items()
    }
    assert {row["doc_id"]: row["component_id"] for row in found} == component


def test_tiles_link_what_all_pairs_link():
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 64, (40, 30)).astype(np.uint64)
    values = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    a, b = values[::2], values[1::2]
    for left, right in ((a, b), (values, values)):
        everything = left if left is right else np.concatenate([left, right])
        near = np.bitwise_count(everything[:, None] ^ everything[None, :]) <= 3
        if left is not right:
            near[: len(left), : len(left)] = near[len(left) :, len(left) :] = False
        x, y = np.nonzero(near)
        want = simhash.Forest(len(everything))
        want.link(x, y)
        src, dst = simhash.link_tiles(left, right, 3)
        place = {value: i for i, value in enumerate(everything.tolist())}
        got = simhash.Forest(len(everything))
        got.link(np.array([place[v] for v in src.tolist()], int),
                 np.array([place[v] for v in dst.tolist()], int))
        assert np.array_equal(want.root, got.root)
        assert len(src) < len(everything)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 600)]
    found = connected(spark.createDataFrame(links, "src bigint, dst bigint")).collect()
    roots = {row["node"]: row["root"] for row in found}
    assert all(roots[i] == 0 for i in range(201)) and roots[600] == roots[500] == 400


def test_contamination_by_places_equals_the_broadcast(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rows = lambda: sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()))
    small = rows()
    assert any(row[-1] for row in small)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert rows() == small


def test_contamination_has_no_python(spark, docs):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    plan = decontaminate.contamination(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


@pytest.fixture(scope="module")
def unigram():
    pieces = token_count.load_pieces(token_count.VOCABULARY)
    exact = Tokenizer(models.Unigram(pieces, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(
        replacement="▁", prepend_scheme="always", split=True
    )
    return token_count.TokenCounter(pieces), exact


@given(st.text(max_size=60) | st.text("ab ▁é\n<0x>s/", max_size=40))
@settings(max_examples=200, deadline=None)
def test_token_counts_equal_the_tokenizer(unigram, text):
    counter, exact = unigram
    assert counter.text(text) == len(exact.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_documents(docs, unigram):
    _, exact = unigram
    part = docs.where("doc_id < 150")
    found = {row[0]: row[1] for row in token_count.token_counts(part).collect()}
    want = {
        row["doc_id"]: len(exact.encode(row["text"], add_special_tokens=False).ids)
        for row in part.collect()
    }
    assert found == want


def test_ties_go_to_the_longest_last_piece():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("▁a", -2.0), ("ab", -2.0)]
    exact = Tokenizer(models.Unigram(pieces, 0, False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    counter = token_count.TokenCounter(pieces, byte_fallback=False)
    for text in ("ab", "aab", "xab", "xxa", "bxx xxb", "abab"):
        assert counter.text(text) == len(exact.encode(text, add_special_tokens=False).ids)


def test_mixture_meets_weights_and_repeats(spark):
    sizes = {"big": 600, "mid": 200, "small": 40, None: 60}
    rows = [
        (i, " ".join(["w"] * (1 + i % 7)), name)
        for name, n in sizes.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = mixing.Mix(min_entropy=None, max_repeats=3.0, blocks=64)
    found = mixing.mixed(df, mix).collect()
    tokens = defaultdict(int)
    for _, text, name in rows:
        tokens[name] += len(text.split())
    used, uses = defaultdict(int), defaultdict(int)
    for row in found:
        used[row["source"]] += row["mix_tokens"]
        uses[row["source"], row["doc_id"], row["mix_epoch"]] += 1
    assert set(uses.values()) == {1}
    assert {(s, i) for s, i, _ in uses} == {(name, i) for i, _, name in rows}
    most, least = max(tokens.values()), min(tokens.values())
    alpha = 1 - math.log(3.0) / math.log(most / least)
    for name, n in tokens.items():
        want = (most / n) ** (1 - alpha) * n
        assert abs(used[name] - want) <= 7 * max(2, sizes[name] // 64 + 2) * 2


def test_entropy_target_is_met(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.07,), (0.03,)], "p double")
    for target in (0.8, 0.9, 0.99):
        alpha = mixing.exponent(shares, mixing.Mix(min_entropy=target, max_repeats=None))
        powers = np.array([0.7, 0.2, 0.07, 0.03]) ** alpha
        weights = powers / powers.sum()
        assert abs(-(weights * np.log(weights)).sum() - target * math.log(4)) < 1e-6


def test_budget_cuts_after_its_block(spark):
    rows = [(i, "a b c d", "s") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mixed(df, mixing.Mix(tokens=1000, blocks=50))
    used = sum(row["mix_tokens"] for row in found.collect())
    assert 1000 <= used < 1000 + 4 * 60


def test_made_up_pages_are_read_exactly():
    trees = html_extract.train()
    scores = []
    for seed in range(10**6, 10**6 + 150):
        page = dom.Page(html_extract._Writer(seed).page())
        main = html_extract._labels(page)
        kept = dom.decode(page, trees.logits(dom.features(page)))
        size = np.array([len(text) for text in page.text])
        both = (size * (kept & main)).sum()
        scores.append(2 * both / max(1, (size * kept).sum() + (size * main).sum()))
    assert np.mean(scores) > 0.95 and np.mean(np.array(scores) == 1) > 0.85


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies here, agree to that.</p><button>OK</button></div>
<main><article><h1>A  title &amp; more</h1><script>var t="</p>";</script>
<p>First &eacute;l paragraph with some words, and a <a href="#">link</a> in it.<p>Second one,
not closed, that has more to say about the matter. It goes on for a while.
<div class="ad">Buy now!</div><ul><li>An item of a list that belongs to the text.</li></ul>
</article><section class="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot,
thank you for all the work.</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><a href="#">Another</a></aside>
<form class="newsletter"><label>Mail</label><input></form>
<footer>&copy; Someone</footer></body></html>"""


def test_page_with_everything_around_the_text():
    (blocks, _), = html_extract.main_blocks(html_extract.train(), [PAGE])
    assert blocks == [
        "A title & more",
        "First él paragraph with some words, and a link in it.",
        "Second one, not closed, that has more to say about the matter. It goes on for a while.",
        "An item of a list that belongs to the text.",
    ]


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ('<div style="overflow:hidden">a</div>b', "a b"),
        ('<div aria-hidden="false" data-hidden="no" title="hidden">a</div>b', "a b"),
        ('<div style="display:none;display:block">a</div>b', "a b"),
        ("<div hidden>a<div>b</div>c</div>d", "d"),
        ("<div style='Display: None !important'>a</div>b", "b"),
        ('<div style="visibility:hidden">a</div>b', "b"),
        ("<div aria-hidden=true>a</div>b", "b"),
        ("<html><head><title>t</title><body><p>a<p>b", "a b"),
        ("<html><head><title>t</title><style>x</style><p>a", "a"),
        ("<ul><li>a<li hidden>b<li>c</ul>d", "a c d"),
        ("<div><p hidden>a<p>b</div><div><p hidden>c</div>d", "b d"),
        ("<table><tr><td hidden>a<td>b<tr hidden><td>c<tr><td>d</table>e", "b d e"),
        ("<table><tbody hidden><tr><td>a<tbody><tr><td>b</table>", "b"),
        ("<p>a <span hidden>b <b>c</b> <span>d</span> e</span> f</p>", "a f"),
        ("<p>a <span hidden>b<p>c", "a c"),
        ('<div hidden>a<script>"</div>"</script>b<svg><g/></svg><br>c</div>d', "d"),
    ],
)
def test_only_hidden_elements_leave_nothing(source, texts):
    assert " ".join(text for text in dom.Page(source).text if text) == texts


def test_decoding_never_contradicts():
    page = dom.Page(PAGE)
    for seed in range(20):
        logits = np.random.default_rng(seed).normal(0, 2, len(page.parent))
        kept = dom.decode(page, logits)
        for at, up in enumerate(page.parent):
            assert not kept[at] or up < 0 or kept[up]


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    found = {row["page_id"]: row["text"] for row in html_extract.extract(pages).collect()}
    assert len(found) == pages.count()
    for row in pages.collect():
        body = row["html"].split("<article>")[1].split("</article>")[0]
        words = set(found[row["page_id"]].split())
        assert "Nicht</a>" not in words and found[row["page_id"]]
        first = body.split("<p><b>")[1].split("<br>")[0].split()
        plain = [word for word in first if "&" not in word and "<" not in word]
        assert set(plain) <= words


def held_out(found, labels, column):
    rows = found.join(labels, "doc_id").where("held_out").collect()
    return [(row["score"], row["predicted"], row[column]) for row in rows]


def area(rows):
    good = [s for s, _, y in rows if y == 1]
    bad = [s for s, _, y in rows if y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_of_held_out_documents(docs, labels):
    rows = held_out(line_crf.classify(docs, labels), labels, "quality")
    assert area(rows) > 0.95 and np.mean([p == y for _, p, y in rows]) > 0.93


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = held_out(toxicity.detect(docs, labels), labels, "toxic")
    flagged = [y for _, p, y in rows if p]
    assert area(rows) > 0.9 and np.mean(flagged) > 0.8
    assert sum(flagged) > 0.75 * sum(y for _, _, y in rows)


def test_language_of_held_out_documents(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    found = rows.collect()
    assert np.mean([row["lang_pred"] == row["lang"] for row in found]) > 0.97
    assert {row["lang_pred"] for row in found} <= {"en", "de", "fr", "es"}


def test_field_marginals_equal_enumeration():
    random = np.random.default_rng(1)
    owner = np.array([0, 0, 0, 0, 1, 2, 2])
    emitted, moves = random.normal(0, 1, 7), random.normal(0, 1, (2, 2))
    good, pairs = line_crf.marginals(emitted, owner, moves)
    for text in range(3):
        at = np.nonzero(owner == text)[0]
        total = np.zeros(len(at))
        weight = 0.0
        for code in range(2 ** len(at)):
            labels = [code >> i & 1 for i in range(len(at))]
            score = sum(emitted[a] for a, y in zip(at, labels) if y)
            score += sum(moves[a, b] for a, b in zip(labels, labels[1:]))
            weight += math.exp(score)
            total += math.exp(score) * np.array(labels)
        assert np.allclose(good[at], total / weight)
    assert np.allclose(pairs.sum((1, 2)), 1)
