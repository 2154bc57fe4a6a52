"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import packed
from orefold.session import materialize

WINDOW = 10
BROADCAST_BYTES = 32 << 20
"""Largest measured size of an index that is sent to every task."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, letters a-z and non-ASCII characters. Null
    has no words."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )
    return F.array_remove(F.split(lowered, _BREAKS), "")


def item_windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows: ``window`` (its words) and ``items`` (the ids that hold it)."""
    split = benchmark.select(
        F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w")
    ).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    at = split.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return (
        at.select("item", F.slice("w", F.col("at") + 1, F.lit(width)).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def _small(df: DataFrame, size: Column) -> bool:
    """Whether the rows, at 64 bytes each besides ``size``, stay under the bound."""
    total = df.agg(F.sum(size + 64).alias("n")).first()["n"] or 0
    return total <= BROADCAST_BYTES


def _split(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, a hash of the text, and the words behind an empty word that marks the row."""
    body = F.col(f"`{text}`")
    return documents.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.xxhash64(body).alias("version"),
        F.concat(F.array(F.lit("")), words(body)).alias("w"),
    )


def _rarity(split: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of the benchmark occurs in all documents. The outer form of
    explode keeps Spark from splitting the text twice for a filter on the array."""
    tokens = split.select(F.explode_outer("w").alias("word"))
    if _small(vocabulary, F.octet_length("word")):
        tokens = tokens.join(F.broadcast(vocabulary), "word")
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.join(counts, "word", "left").select(
        "word", F.coalesce("n", F.lit(0)).alias("n")
    )


def prefix_index(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """Each window under its rarest word and that word's first place in it.

    Containment must be exact, so a prefix of one word is all that is necessary: a text
    without the rarest word cannot contain the window.
    """
    places = windows.select("window", F.posexplode("window").alias("offset", "word"))
    rarest = (
        places.join(rarity, "word")
        .groupBy("window")
        .agg(F.min(F.struct("n", "word", "offset")).alias("p"))
    )
    return windows.join(rarest, "window").select("p.word", "p.offset", "window", "items")


def _match(split: DataFrame, index: DataFrame) -> DataFrame:
    """Rows ``id, version, n_words, start, stop, items``: one marker per document, without
    start, and one row per place where a window occurs.

    With an index that fits into every task the words are exploded, probed and verified in
    one pass, and nothing but matches leaves it. A larger index is joined by a shuffle of
    places, and candidates go back to their document's words to be verified.
    """
    places = split.select("id", "version", "w", F.posexplode_outer("w").alias("pos", "word"))
    start = F.col("pos") - 1 - F.col("offset")
    count = F.size("w") - 1
    fits = (start >= 0) & (start + F.size("window") <= count)
    same = F.slice("w", F.col("pos") - F.col("offset") + 1, F.size("window")) == F.col("window")
    held = F.octet_length(F.concat_ws(" ", "window")) + 32 * F.size("window") + 32 * F.size("items")
    if _small(index, held):
        marker = index.sparkSession.range(1).select(
            F.lit("").alias("word"),
            *(
                F.lit(None).cast(index.schema[name].dataType).alias(name)
                for name in ("offset", "window", "items")
            ),
        )
        return (
            places.join(F.broadcast(index.union(marker)), "word")
            .where(F.col("window").isNull() | (fits & same))
            .select(
                "id",
                "version",
                count.alias("n_words"),
                start.alias("start"),
                (start + F.size("window")).alias("stop"),
                "items",
            )
        )
    keyed = index.withColumn("key", F.concat_ws(" ", "window"))
    found = (
        places.select("id", "version", "pos", "word", count.alias("n_words"))
        .join(keyed.select("word", "offset", "key", F.size("window").alias("size")), "word")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .groupBy("id", "version")
        .agg(F.collect_list(F.struct(start.alias("start"), "size", "key")).alias("found"))
    )
    same_row = F.col("s.id").eqNullSafe(F.col("f.id")) & (
        F.col("s.version") == F.col("f.version")
    )
    verified = F.filter(
        "found",
        lambda c: F.concat_ws(" ", F.slice("w", c["start"] + 2, c["size"])) == c["key"],
    )
    checked = (
        split.alias("s")
        .join(found.alias("f"), same_row, "left")
        .select("s.id", "s.version", count.alias("n_words"), verified.alias("hits"))
    )
    hits = checked.select("id", "version", "n_words", F.explode("hits").alias("h")).select(
        "id",
        "version",
        "n_words",
        F.col("h.start").alias("start"),
        (F.col("h.start") + F.col("h.size")).alias("stop"),
        F.col("h.key").alias("key"),
    )
    hits = hits.join(keyed.select("key", "items"), "key").drop("key")
    none = F.lit(None)
    marks = checked.select(
        "id",
        "version",
        "n_words",
        none.cast("int").alias("start"),
        none.cast("int").alias("stop"),
        none.cast("array<string>").alias("items"),
    )
    return hits.select(*marks.columns).union(marks)


def _verdicts(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str,
    text: str,
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """The rows of :func:`contamination`, with ``version``, the hash of the row's text."""
    windows = materialize(item_windows(benchmark, item_id, item_text, width), "windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    split = _split(documents, doc_id, text)
    rarity = _rarity(split, materialize(vocabulary, "vocabulary"))
    index = materialize(prefix_index(windows, rarity), "prefix-index")
    found = (
        _match(split, index)
        .groupBy("id", "version")
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum(F.col("start").isNull().cast("long")).alias("copies"),
            F.collect_set(
                F.when(F.col("start").isNotNull(), F.struct("start", "stop"))
            ).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"),
        )
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda done, span: F.struct(
            (
                done["n"]
                + F.greatest(
                    F.lit(0), span["stop"] - F.greatest(done["reach"], span["start"])
                )
            ).alias("n"),
            F.greatest(done["reach"], span["stop"]).alias("reach"),
        ),
        lambda done: done["n"],
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "version",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("ids")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """Rows ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is ``width`` consecutive words of an item, or all words of a shorter one. A
    document word within any occurrence of a window is hit. Words are ordered by how rare
    they are in all documents; each window is looked up by its rarest word, must fit into
    the document around that place, and is then compared word by word.

    Null and empty texts have no words, in documents and items. Items with a null id hit
    but are not listed. Null document ids stay null. Repeated rows each give a row. Empty
    tables give an empty result, or no hits.
    """
    found = _verdicts(documents, benchmark, doc_id, text, item_id, item_text, width)
    return found.drop("version")


def keep_clean(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    **columns: str,
) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item. Rows that
    share an id, null included, are told apart by their texts: only the contaminated go."""
    found = _verdicts(documents, benchmark, doc_id, text, **columns)
    bad = found.where("contaminated").select(
        F.col("doc_id").alias("bad"), F.col("version").alias("bad_version")
    )
    rows = packed(documents, key=F.col(f"`{doc_id}`"), version=F.xxhash64(F.col(f"`{text}`")))
    same = F.col("key").eqNullSafe(F.col("bad")) & (F.col("version") == F.col("bad_version"))
    return rows.join(bad.distinct(), same, "left_anti").select("row.*")
