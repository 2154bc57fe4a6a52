"""Source divergence: how far each source's words lie from those of its language's others.

Terms are runs of ASCII letters and of characters beyond ASCII. Every language has its own
vocabulary, the terms in enough of its documents. As a term is
tagged with its language, one ``CountVectorizer`` fit is one for each language. The
vocabulary it holds on the driver is bounded: terms beyond the bound are dealt by hash into
shards, each with a fit of its own, and a document is then one vector for each shard. Sums
over terms are the same however the terms are dealt.

Vectorizers look at every term of every row, so tasks first bring their documents into few
rows: for the fit a term in as many as have it, up to the number that it asks for, and
for the vectors a bag for each group and binary place of its counts. The vocabulary and the
sums are those of the documents.

``Summarizer`` works with rounded means, so group sums are added up as whole numbers here,
sparse, first within tasks. Pairs of sources are evaluated from the sparse sums: terms that
neither source has count as a number, not as rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.llm.common import buffer_of, text_array, text_slices
from orefold.session import materialize, scratch_path

MIN_DOCUMENTS = 10
RANKS = 10
VOCABULARY = 1 << 22
"""Distinct terms of a fit, about; more are dealt into shards. The driver holds those of
them that are kept, with their tags less than 100 bytes each for words of usual length."""
MOST_TERMS = 2**31 - 1
CELL_TERMS = 1024
CELL_SOURCES = 256
_HELD = 1 << 20
"""Sums that a task holds before it hands them on."""
_COUNTED = 3 << 18
"""Counts that a task holds before it hands them on."""
_TERM_BYTES = 16
"""Bytes of terms that weigh as much as a count."""
_SLICE_BYTES = 1 << 20
_BAG = 256
"""Most terms of a row, so that Spark's batches of rows stay small."""
_TERM = (1 << 32) - 1
_ROWS = 1024
_PARTS = 10**9
_HASHED = 16
_NUMBERS = np.random.default_rng(11).integers(1 << 32, size=256, dtype=np.uint32)
_READ_TOGETHER = 4
_VOCABULARY_PARTS = 64
_PART_BITS = 26
_TAG = "\0"


def _byte_class() -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to a term, and the byte with A-Z lower-cased."""
    of = np.arange(256, dtype=np.uint8)
    upper, lower = (of >= 65) & (of <= 90), (of >= 97) & (of <= 122)
    return upper | lower | (of >= 128), np.where(upper, of + 32, of).astype(np.uint8)


def terms_of(texts: pa.Array, tags: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, lower-cased, each with its text's tag behind a zero byte; where
    each text's terms start in what follows; and for each text its distinct terms, by place
    among all, with their counts. All bytes are looked at together."""
    inside_of, lowered_of = _byte_class()
    data, starts, _ = buffer_of(texts)
    inside = inside_of[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = starts[starts < len(data)]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    first = np.flatnonzero(begins)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, starts), append=len(first)))
    ends = np.append(0, np.cumsum(np.flatnonzero(closes) + 1 - first))
    words = pa.Array.from_buffers(
        pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(lowered_of[data[inside]])]
    ).dictionary_encode()
    tag = tags.dictionary_encode()
    most = max(1, len(words.dictionary))
    key, count = np.unique(text * most + words.indices.to_numpy(), return_counts=True)
    text, tag_of = key // most, tag.indices.to_numpy().astype(np.int64)
    known, place = np.unique(tag_of[text] * most + key % most, return_inverse=True)
    terms = pc.binary_join_element_wise(
        words.dictionary.cast(pa.string()).take(pa.array(known % most)),
        tag.dictionary.take(pa.array(known // most)),
        _TAG,
    )
    return terms, np.searchsorted(text, np.arange(len(texts) + 1)), place, count


def _marked(terms: pa.Array) -> pa.Array:
    """The terms with one of ``_HASHED`` hashes, which add up numbers of their bytes."""
    letters, first, _ = buffer_of(terms)
    if not len(first):
        return terms
    hashes = np.add.reduceat(_NUMBERS[letters], first)
    marks = hashes * np.uint32(2654435769) >> np.uint32(16) & np.uint32(_HASHED - 1) == 0
    return terms.filter(pa.array(marks))


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Bags:
    """What a vectorizer has to see of a task's documents, in few rows.

    A fit asks whether enough documents have a term. So a term comes in as many rows as the
    task has documents with it, but no more than that ``least``.

    A model takes no counts, but its vectors add up. So how often a group has its terms is
    written in binary: a bag for each place, with the terms whose count has that bit.

    A row has at most ``_BAG`` terms, all different. What is held is bounded by ``held``.
    """

    def __init__(self, least: int, held: int = _COUNTED) -> None:
        self.least, self.held = max(1, least), held
        self._clear()

    def _clear(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: list[pa.Array] = [pa.array([], pa.string())]
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.known = self.fresh = 0

    def add(
        self,
        groups: Iterable[tuple[str, str]],
        found: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray],
    ) -> Iterator[pa.RecordBatch]:
        """Take in the terms of some texts; give rows if too much is held."""
        terms, lists, place, count = found
        before = len(self.groups)
        # group 0 stands for the documents: how many have a term
        group = [self.groups.setdefault(key, len(self.groups) + 1) for key in groups]
        of = np.repeat(np.array(group, np.int64), np.diff(lists))
        keys, counts = _added_up(of << 32 | place + self.known, count)
        self.terms.append(terms)
        self.keys += [np.arange(self.known, self.known + len(terms)), keys]
        self.counts += [np.bincount(place, minlength=len(terms)), counts]
        self.known += len(terms)
        self.fresh += len(keys) + len(terms) + terms.nbytes // _TERM_BYTES
        self.fresh += len(self.groups) - before
        if self.fresh > self.held // 2:
            self._compact()
            size = len(self.keys[0]) + len(self.groups) + self.terms[0].nbytes // _TERM_BYTES
            if size > self.held:
                yield from self.rows()

    def _compact(self) -> None:
        words = pa.concat_arrays(self.terms).dictionary_encode()
        self.terms = [words.dictionary]
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []  # held once while they are sorted
        term = keys & _TERM
        keys -= term
        keys += words.indices.to_numpy()[term]
        del term
        keys, counts = _added_up(keys, counts)
        self.keys, self.counts = [keys], [counts]
        self.known, self.fresh = len(words.dictionary), 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of all that is held, as ``_terms`` has them; it is then let go."""
        self._compact()
        keys, counts = self.keys[0], self.counts[0]
        none, own = pa.array([], pa.string()), np.searchsorted(keys, 1 << 32)
        names = list(self.groups)
        lang, source = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
        marked = _marked(self.terms[0])
        yield _batch(lang, source, None, _lists(len(names), none), _lists(len(names), none), None)
        yield _batch(None, None, None, _lists(1, none), _lists(1, none), _lists(1, marked))
        left, times = keys[:own], counts[:own]
        for layer in range(self.least):
            left, times = left[times > layer], times[times > layer]
            if not len(left):
                break
            ends = np.append(np.arange(0, len(left), _BAG), len(left)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), self.terms[0].take(pa.array(left)))
            yield _batch(None, None, None, found, _lists(len(found), none), None)
        keys, counts = keys[own:], counts[own:]
        for place in range(int(counts.max(initial=0)).bit_length()):
            left = keys[counts >> place & 1 == 1]
            group = left >> 32
            first = np.flatnonzero((np.arange(len(left)) - np.searchsorted(group, group)) % _BAG == 0)
            of = pa.array(group[first] - 1)
            found = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(left)).astype(np.int32)),
                self.terms[0].take(pa.array(left & _TERM)),
            )
            yield _batch(
                lang.take(of), source.take(of), place, _lists(len(first), none), found, None
            )
        self._clear()


def _lists(rows: int, first: pa.Array) -> pa.ListArray:
    """Lists of which the first has all the values."""
    ends = np.full(rows + 1, len(first), np.int32)
    ends[0] = 0
    return pa.ListArray.from_arrays(pa.array(ends), first)


def _batch(
    lang: pa.Array | None,
    source: pa.Array | None,
    place: int | None,
    terms: pa.ListArray,
    bag: pa.ListArray,
    marked: pa.ListArray | None,
) -> pa.RecordBatch:
    rows = len(terms)
    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.nulls(rows, pa.string()) if lang is None else lang,
            "source": pa.nulls(rows, pa.string()) if source is None else source,
            "place": pa.array([place] * rows, pa.int32()),
            "terms": terms,
            "bag": bag,
            "marked": _lists(rows, pa.array([], pa.string())) if marked is None else marked,
        }
    )


def _terms(
    documents: DataFrame, text: str, lang: str, source: str, least: int, held: int = _COUNTED
) -> DataFrame:
    """Rows ``lang, source, place, terms, bag, marked``, as ``Bags`` of each task has them;
    a term carries its language behind a zero byte, which no term holds. Every group has a
    row without terms. ``terms`` are for the fit, of no group. A ``bag`` of a group counts
    ``2 ** place`` times. ``marked`` are the terms with one of ``_HASHED`` hashes; they tell
    how many distinct terms there are."""

    def tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(least, held)
        for batch in text_slices(batches, "__text", _SLICE_BYTES):
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = terms_of(text_array(batch, "__text"), batch.column(0))
            yield from bags.add(groups, found)
        yield from bags.rows()
        pa.default_memory_pool().release_unused()

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    given = documents.select(
        filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("__text")
    )
    strings = "terms array<string>, bag array<string>, marked array<string>"
    schema = f"lang string, source string, place int, {strings}"
    return materialize(given.mapInArrow(tokenised, schema), "terms")


def _dealt(terms: DataFrame, shards: int) -> DataFrame:
    """The rows once for each shard that holds some of their terms."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.cast(pa.binary()).to_pylist()
            of_word = np.array([xxhash.xxh64_intdigest(w) % shards for w in words], np.int64)
            shard = of_word[flat.indices.to_numpy(zero_copy_only=False)]
            key = np.repeat(np.arange(batch.num_rows) * shards, lengths) + shard
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ends = pa.array(np.append(first, len(key)).astype(np.int32))
            of = pa.array(key[first] // shards)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": batch.column(0).take(of),
                    "source": batch.column(1).take(of),
                    "place": batch.column(2).take(of),
                    "shard": pa.array((key[first] % shards).astype(np.int32)),
                    "terms": pa.ListArray.from_arrays(
                        ends, flat.dictionary.take(flat.indices.take(pa.array(order)))
                    ),
                }
            )

    path = scratch_path(terms.sparkSession, "dealt-terms")
    columns = "lang string, source string, place int"
    dealt = terms.mapInArrow(split, f"{columns}, shard int, terms array<string>")
    dealt.write.partitionBy("shard").parquet(path)
    return terms.sparkSession.read.schema(f"{columns}, terms array<string>, shard int").parquet(
        path
    )


def _shards(terms: DataFrame, vocabulary: int) -> list[tuple[DataFrame, DataFrame]]:
    """The rows to fit and the bags of each fit, so that a fit has about ``vocabulary`` distinct
    terms at most. Their number is told from the marked terms, without reading the others."""
    distinct = terms.select(F.explode("marked").alias("term")).agg(
        F.approx_count_distinct("term", 0.02)
    )
    shards = max(1, -(-int(distinct.first()[0]) * _HASHED // vocabulary))
    key, place = ["lang", "source", "place"], F.col("place")
    rows = terms.where(place.isNull() & (F.size("terms") > 0)).select(*key, "terms")
    bags = terms.where(place.isNotNull()).select(*key, F.col("bag").alias("terms"))
    if shards == 1:
        return [(rows, bags)]
    both = [_dealt(rows, shards), _dealt(bags, shards)]
    return [tuple(x.where(F.col("shard") == k).drop("shard") for x in both) for k in range(shards)]


def _fit(rows: DataFrame, min_documents: int) -> CountVectorizerModel | None:
    """The vocabulary of the terms in at least so many rows; none if no term is, which Spark
    refuses as an empty vocabulary. A task of the fit hands on each of its terms, so several
    tasks of the step before are read by one."""
    parts = rows.rdd.getNumPartitions()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    vectorizer = CountVectorizer(
        inputCol="terms", outputCol="vector", minDF=float(min_documents), vocabSize=MOST_TERMS
    )
    try:
        return vectorizer.fit(rows.coalesce(max(2 * cores, parts // _READ_TOGETHER)))
    except IllegalArgumentException as error:
        if "vocabulary size should be > 0" not in str(error):
            raise
        return None


def _slices(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _vocabulary(model: CountVectorizerModel, rows: DataFrame, shard: int) -> DataFrame:
    """Rows ``shard, index, term, lang``, read from the saved model."""
    path = scratch_path(rows.sparkSession, "vocabulary")
    model.write().save(path)
    saved = rows.sparkSession.read.parquet(f"{path}/data")
    listed = saved.select(F.posexplode("vocabulary").alias("index", "tagged"))
    return listed.select(
        F.lit(shard).alias("shard"),
        "index",
        F.substring_index("tagged", _TAG, 1).alias("term"),
        F.substring("tagged", F.locate(_TAG, F.col("tagged")) + 1, F.length("tagged")).alias("lang"),
    )


def _sums(model: CountVectorizerModel, bags: DataFrame, shard: int) -> DataFrame:
    """Rows ``lang, source, shard, index, n``: the bags' vectors, added up exactly.

    Tasks add up what they read and hand on sparse vectors, one for each group and part of
    the vocabulary. These meet by group and part, in order, so that the next task holds one
    sum at a time, whatever the size of a group.
    """

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def compact() -> None:
            held, total = _added_up(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [held], [total]

        def flush() -> pa.RecordBatch:
            names, vector = list(codes), keys[0] >> _PART_BITS
            first = np.flatnonzero(np.diff(vector, prepend=-1))
            of = pa.array(vector[first] // _VOCABULARY_PARTS)
            ends = pa.array(np.append(first, len(vector)).astype(np.int32))
            within = pa.array((keys[0] & ((1 << _PART_BITS) - 1)).astype(np.int32))
            return pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([n[0] for n in names], pa.string()).take(of),
                    "source": pa.array([n[1] for n in names], pa.string()).take(of),
                    "part": pa.array((vector[first] % _VOCABULARY_PARTS).astype(np.int32)),
                    "within": pa.ListArray.from_arrays(ends, within),
                    "counts": pa.ListArray.from_arrays(ends, pa.array(counts[0])),
                }
            )

        fresh = 0
        for batch in _slices(batches, _ROWS):
            group = [
                codes.setdefault(key, len(codes))
                for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            place = batch.column(2).to_numpy(zero_copy_only=False)
            vectors = batch.column(3)
            indices, values = vectors.field("indices"), vectors.field("values")
            lengths = indices.value_lengths().to_numpy(zero_copy_only=False)
            index = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            vector = np.repeat(np.array(group, np.int64) * _VOCABULARY_PARTS, lengths)
            key = vector + index % _VOCABULARY_PARTS << _PART_BITS | index // _VOCABULARY_PARTS
            number = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            keys.append(key)
            counts.append(number << np.repeat(place, lengths))
            fresh += len(key)
            if fresh > _HELD:
                compact()
                fresh = 0
                if len(keys[0]) > _HELD:
                    yield flush()
                    codes.clear()
                    keys[:], counts[:] = [keys[0][:0]], [counts[0][:0]]
        compact()
        if len(keys[0]):
            yield flush()
        pa.default_memory_pool().release_unused()

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, np.int64)

        def whole() -> pa.RecordBatch:
            within = np.flatnonzero(total)
            index = within * _VOCABULARY_PARTS + at[2]
            return pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([at[0]] * len(within), pa.string()),
                    "source": pa.array([at[1]] * len(within), pa.string()),
                    "index": pa.array(index.astype(np.int32)),
                    "n": pa.array(total[within]),
                }
            )

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, within, counts in zip(keys, batch.column(3), batch.column(4)):
                if key != at:
                    if at is not None:
                        yield whole()
                    at, total = key, np.zeros(0, np.int64)
                place = within.values.to_numpy(zero_copy_only=False)
                if place[-1] >= len(total):
                    total = np.append(total, np.zeros(place[-1] + 1 - len(total), np.int64))
                total[place] += counts.values.to_numpy(zero_copy_only=False)
        if at is not None:
            yield whole()

    vectors = model.transform(bags).select("lang", "source", "place", "vector")
    key = ["lang", "source", "part"]
    sums = vectors.mapInArrow(
        added,
        "lang string, source string, part int, within array<int>, counts array<bigint>",
    )
    return (
        sums.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(met, "lang string, source string, index int, n bigint")
        .withColumn("shard", F.lit(shard))
    )


def _share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 * (count + 2) / (total + 2 * kept))``, exactly."""
    above = F.lit(_PARTS).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", above, below))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_cells(
    sums: DataFrame, groups: DataFrame, cell_terms: int, cell_sources: int
) -> DataFrame:
    """Rows ``lang, source, item, value``: what the terms that either source has add to the
    value of the pair, beyond what they would add if neither had them; in parts.

    A cell has some terms of a language and two sets of its sources, so its size is bounded
    whatever the size of the table. Sums go to the cells of their term, and each group to
    all cells of its sources.
    """
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    sets = max(1, -(-most // cell_sources))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("kept") / cell_terms)).cast("int")
    of = F.pmod(F.xxhash64("source"), F.lit(sets)).cast("int").alias("of")
    languages = groups.select("lang", chunks.alias("chunks")).where("kept > 0").distinct()
    counted = sums.join(languages, "lang").select(
        "lang",
        F.pmod(F.xxhash64("shard", "index"), F.col("chunks")).cast("int").alias("chunk"),
        of,
        "source",
        (F.col("shard").cast("long") * (1 << 32) + F.col("index")).alias("place"),
        "n",
        F.lit(None).cast("bigint").alias("below"),
    )
    described = groups.where("kept > 0").select(
        "lang",
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
        of,
        "source",
        F.lit(None).cast("bigint").alias("place"),
        F.lit(None).cast("bigint").alias("n"),
        (F.col("total") + 2 * F.col("kept")).alias("below"),
    )
    rows = counted.union(described)
    other = F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("other")
    rows = rows.select("*", other).select(
        "lang",
        "chunk",
        F.least("of", "other").alias("a"),
        F.greatest("of", "other").alias("b"),
        "of",
        "source",
        "place",
        "n",
        "below",
    )
    return rows.groupBy("lang", "chunk", "a", "b").applyInArrow(
        _evaluate, "lang string, source string, item string, value bigint"
    )


def _evaluate(key: tuple, table: pa.Table) -> pa.Table:
    """The pairs of one cell."""
    a, b = key[2].as_py(), key[3].as_py()
    table = table.combine_chunks()
    column = {name: table.column(name).combine_chunks() for name in table.column_names}
    is_group = column["place"].is_null().to_numpy(zero_copy_only=False)
    of = column["of"].to_numpy(zero_copy_only=False)
    names = column["source"].filter(pa.array(is_group)).to_pylist()
    below = column["below"].filter(pa.array(is_group)).to_numpy(zero_copy_only=False)
    group_set = of[is_group]
    order = sorted(range(len(names)), key=names.__getitem__)
    names, below, group_set = [names[i] for i in order], below[order], group_set[order]
    code = {name: i for i, name in enumerate(names)}
    counted = pa.array(~is_group)
    group = np.array([code[s] for s in column["source"].filter(counted).to_pylist()], int)
    places = column["place"].filter(counted).to_numpy(zero_copy_only=False)
    terms = np.unique(places)
    term = np.searchsorted(terms, places)
    share = shares(column["n"].filter(counted).to_numpy(zero_copy_only=False), below[group])
    none = shares(np.zeros(len(names), np.int64), below)
    by = np.argsort(group, kind="stable")
    group, term, share = group[by], term[by], share[by]
    starts = np.searchsorted(group, np.arange(len(names) + 1))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(group_set == a):
        others = np.flatnonzero(group_set == b)
        others = others[others > i] if a == b else others
        if len(others):
            values = _with_others(i, group, term, share, none, starts, len(terms))
            found.append((i, others, values[others]))
    left = np.concatenate([np.zeros(0, int), *(np.full(len(o), i) for i, o, _ in found)])
    right = np.concatenate([np.zeros(0, int), *(o for _, o, _ in found)])
    value = np.concatenate([np.zeros(0, np.int64), *(v for _, _, v in found)])
    listed = pa.array(names, pa.string())
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(value), pa.string()),
            "source": listed.take(pa.array(left)),
            "item": listed.take(pa.array(right)),
            "value": pa.array(value),
        }
    )


def shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """``_share`` of counts; beyond 64 bits in Python's own numbers."""
    if len(counts) and int(counts.max()) > (1 << 62) // _PARTS:
        return np.array(
            [1 + _PARTS * (int(n) + 2) // int(d) for n, d in zip(counts, below)], np.int64
        )
    return 1 + _PARTS * (counts + 2) // below


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.square(p - q) // (p + q)


def _with_others(
    i: int,
    group: np.ndarray,
    term: np.ndarray,
    share: np.ndarray,
    none: np.ndarray,
    starts: np.ndarray,
    terms: int,
) -> np.ndarray:
    """For group ``i`` and each group: the sum over the terms that either has, less what
    these terms would add if neither had them."""
    mine = slice(starts[i], starts[i + 1])
    groups = len(none)
    has = np.diff(starts)
    different, times = np.unique(share[mine], return_counts=True)
    total = (apart(different[:, None], none) * times[:, None]).sum(0)
    ends = np.append(0, np.cumsum(apart(none[i], share)))
    total += ends[starts[1:]] - ends[starts[:-1]]
    own = np.zeros(terms, np.int64)
    own[term[mine]] = share[mine]
    both = own[term] > 0
    p, q, other = own[term[both]], share[both], group[both]
    extra = np.zeros(groups, np.int64)
    np.add.at(extra, other, apart(p, q) - apart(p, none[other]) - apart(none[i], q))
    shared = np.bincount(other, minlength=groups)
    return total + extra - apart(none[i], none) * (has[i] + has - shared)


def audit(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    ranks: int = RANKS,
    vocabulary: int = VOCABULARY,
    cell_terms: int = CELL_TERMS,
    cell_sources: int = CELL_SOURCES,
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``, all arithmetic in whole numbers.

    A language keeps the terms in at least ``min_documents`` of its documents. A group is
    a language and source that occur, with or without terms; with ``V`` kept terms and
    ``N`` occurrences of them in the group, a term's share is
    ``p = 1 + floor(10^9 * (count + 2) / (N + 2 * V))``, and two shares are
    ``floor((p - q)^2 / (p + q))`` apart. Part ``pair`` has for each other source of the
    language the sum over all kept terms, 0 if there are none. Part ``term`` has the
    ``ranks`` terms that the group has more of than its language, farthest first. Ranks go
    by value, then by the item's bytes.

    Null text, language and source count as empty; empty and repeated texts are documents
    like others. Whole texts are read, however long. An empty table gives an empty result.
    Other columns are ignored.
    """
    terms = _terms(documents, text, lang, source, min_documents)
    sums, words = [], []
    for shard, (rows, bags) in enumerate(_shards(terms, vocabulary)):
        model = _fit(rows, min_documents)
        if model is not None:
            words.append(_vocabulary(model, rows, shard))
            sums.append(materialize(_sums(model, bags, shard), "group-sums"))
    spark = terms.sparkSession
    if not sums:
        words = [spark.createDataFrame([], "shard int, index int, term string, lang string")]
        sums = [
            spark.createDataFrame(
                [], "lang string, source string, index int, n bigint, shard int"
            )
        ]
    known = materialize(reduce(DataFrame.union, words), "vocabulary")
    total = reduce(DataFrame.union, sums)
    kept = known.groupBy("lang").agg(F.count("*").alias("kept"))
    occurring = total.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(
        terms.where("lang is not null")
        .select("lang", "source")
        .distinct()
        .join(kept, "lang", "left")
        .join(occurring, ["lang", "source"], "left")
        .na.fill(0, ["kept", "total"]),
        "groups",
    )
    pairs = _pairs(total, groups, cell_terms, cell_sources)
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value",
        F.row_number().over(own).alias("rank"),
    )
    typical = _typical(total, groups, known).withColumn("rank", F.row_number().over(own))
    typical = typical.where(F.col("rank") <= ranks).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank"
    )
    return pairs.union(typical)


def _pairs(
    sums: DataFrame, groups: DataFrame, cell_terms: int, cell_sources: int
) -> DataFrame:
    """Rows ``lang, source, item, value`` for every two sources of a language; the rows are
    the result itself, so they are as many as asked for."""
    none = _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))
    described = groups.select("lang", "source", "kept", none.alias("none"))
    others = described.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    base = F.coalesce(F.col("kept") * _apart(F.col("none"), F.col("other")), F.lit(0))
    whole = (
        described.join(others, "lang")
        .where(F.col("source") != F.col("item"))
        .select("lang", "source", "item", base.alias("value"))
    )
    cells = materialize(_pair_cells(sums, groups, cell_terms, cell_sources), "pair-cells")
    turned = cells.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"
    )
    parts = whole.union(cells).union(turned)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _typical(sums: DataFrame, groups: DataFrame, known: DataFrame) -> DataFrame:
    """Rows ``lang, source, item, value``: terms that a group has more of than its language."""
    place = ["shard", "index"]
    of_lang = sums.groupBy(place).agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    p = _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    rows = (
        sums.join(groups.join(lang_total, "lang"), ["lang", "source"])
        .join(of_lang.join(known.drop("lang"), place), place)
        .select("lang", "source", F.col("term").alias("item"), p, q)
    )
    return rows.where("p > q").withColumn("value", _apart(F.col("p"), F.col("q")))
