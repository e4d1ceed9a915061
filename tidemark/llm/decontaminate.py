"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every ``guarantee`` - ``gram`` + 1 consecutive word ``gram``-grams the one with the least hash is kept, in
documents and benchmark items alike. Any span of ``guarantee`` words that both share holds equal grams at
the same places, so both keep the same one: the join of the kept hashes finds every document that
can hold a window. Only those documents are then extended word by word: all their windows are looked
up, and a hit is confirmed on its words.

The join moves hashes, not texts, and broadcasts the benchmark's only after counting them.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import NULL_ID, id_key, text_key, whole_text
from tidemark.operators.joins import is_small, sized_join
from tidemark.session import written

WINDOW = 10
GRAM = 7

#: Everything but digits, letters (after lower-casing A-Z) and characters beyond ASCII parts words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the words of a text, A-Z lower-cased, as an array."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    df = df.withColumn(name, F.split(lowered, BETWEEN_WORDS))
    # Only the first and the last can be empty.
    edges = (F.get(name, F.lit(0)) == "") | (F.element_at(name, -1) == "")
    return df.withColumn(name, F.when(edges, F.array_remove(name, "")).otherwise(F.col(name)))


def _least(left: Column, right: Column) -> Column:
    return F.least(left, right)


def _hash(left: Column, right: Column) -> Column:
    return F.xxhash64(left, right)


def _tag(length: int) -> Callable[[Column], Column]:
    return lambda value: F.xxhash64(F.lit(length), value)


def _placed(length: int) -> Callable[[Column, Column], Column]:
    tag = _tag(length)
    return lambda value, i: F.struct(i.alias("place"), F.lit(length).alias("length"), tag(value).alias("key"))


def _runs(df: DataFrame, values: str, n: int, combine: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Add ``combine`` over each ``n`` consecutive elements, by combining ever longer stretches pairwise.

    Every step is a column of its own: nested in one expression it would be evaluated again and again.
    """
    df = df.withColumn(name, F.col(values))
    reach = 1
    while reach < n:
        step = min(reach, n - reach)
        left = F.greatest(F.size(name) - step, F.lit(0))
        longer = F.zip_with(F.slice(name, F.lit(1), left), F.slice(name, F.lit(1 + step), left), combine)
        df = df.withColumn(name, longer)
        reach += step
    return df


def _with_hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("__hashes", F.transform("words", lambda word: F.xxhash64(word)))


def _fingerprints(df: DataFrame, window: int, gram: int, short: list[int], name: str) -> DataFrame:
    """Add the kept gram hashes of the column ``words``; whole short items are kept under their length."""
    rest = df.columns
    df = _runs(_with_hashes(df), "__hashes", gram, _hash, "__grams")
    df = _runs(df, "__grams", window - gram + 1, _least, "__least")
    kept = [F.array_distinct("__least")]
    for length in short:
        df = _runs(df, "__hashes", length, _hash, f"__short{length}")
        kept.append(F.array_distinct(F.transform(f"__short{length}", _tag(length))))
    return df.select(*rest, (F.concat(*kept) if len(kept) > 1 else kept[0]).alias(name))


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for every run of as many words as ``lengths`` says: its ``place``, ``length`` and ``key``."""
    rest = df.columns
    df = _with_hashes(df)
    every = []
    for n in lengths:
        df = _runs(df, "__hashes", n, _hash, f"__runs{n}")
        every.append(F.transform(f"__runs{n}", _placed(n)))
    return df.select(*rest, F.inline(F.concat(*every)))


def _hits(
    docs: DataFrame, benchmark: DataFrame, window: int, gram: int, limit: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents with their number of words; every occurrence of a window; the items of the windows."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), whole_text().alias("text")
    )
    items = with_words(items, "text", "words").drop("text").withColumn("n", F.size("words")).filter("n > 0")
    # At most window - 1 numbers: the lengths of items too short for a window.
    short = sorted(row[0] for row in items.filter(F.col("n") < window).select("n").distinct().collect())

    # Outer, or a filter on the size of the array is derived and pushed through every step of ``_runs``, which
    # spells all of them out in one expression.
    kept = _fingerprints(items, window, gram, short, "kept").select(F.explode_outer("kept").alias("mark"))
    marks = written(kept.filter("mark IS NOT NULL").distinct(), "marks")
    read = docs.select(
        F.monotonically_increasing_id().alias("row"),
        id_key().alias("id"),
        text_key().alias("h"),
        whole_text().alias("text"),
    )
    read = with_words(read, "text", "words").withColumn("n_words", F.size("words").cast("long"))
    marked = _fingerprints(read, window, gram, short, "kept").select("row", "id", "h", "n_words", F.explode_outer("kept").alias("mark"))
    hits = marks.withColumn("hit", F.lit(1))
    joined = marked.join(F.broadcast(hits) if is_small(marks, limit) else hits, "mark", "left")
    seen = written(
        joined.groupBy("row", "id", "h", "n_words").agg(F.max("hit").alias("hit")).drop("row"), "seen"
    )

    # Extend: all windows of the documents that share a mark, looked up and compared word by word.
    found = seen.filter("hit = 1").select("id", "h").distinct()
    texts = docs.select(id_key().alias("id"), text_key().alias("h"), whole_text().alias("text"))
    candidates = written(
        with_words(sized_join(texts, found, ["id", "h"], "left_semi", limit), "text", "words")
        .dropDuplicates(["id", "h"])
        .select("id", "h", "words"),
        "candidates",
    )
    lengths = sorted({window, *short})
    spelled = _windows(items, lengths).filter("length = least(n, %d)" % window).select(
        "item", "key", F.concat_ws(" ", F.slice("words", F.col("place") + 1, F.col("length"))).alias("spelling")
    )
    spelled = written(spelled.distinct(), "windows")
    lookup = spelled.select("key", "spelling").distinct()
    places = sized_join(_windows(candidates, lengths).select("id", "h", "place", "length", "key"), lookup, ["key"], "inner", limit)
    listed = places.groupBy("id", "h").agg(F.collect_list(F.struct("place", "length", "spelling")).alias("places"))
    confirmed = F.filter(
        "places",
        lambda p: F.concat_ws(" ", F.slice(F.col("words"), p["place"] + 1, p["length"])) == p["spelling"],
    )
    hit = written(candidates.join(listed, ["id", "h"]).select("id", "h", F.inline(confirmed)), "hits")
    return seen, hit, spelled


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = 100_000
) -> DataFrame:
    """``id`` and ``h`` (see ``common``) of the documents with any window of an item."""
    return written(_hits(docs, benchmark, window, gram, limit)[1].select("id", "h").distinct(), "contaminated")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = 100_000
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every document.

    A window is ``window`` consecutive words of a benchmark item, or a whole shorter item that has words. A
    document word inside any occurrence of a window is hit; ``n_items`` items have occurring windows, and
    ``items_sha256`` is that of their ids, sorted as strings and joined by commas. Null texts have no
    words, null item ids count as the string "null". Other columns are not looked at. ``gram`` is below
    ``window``; ``limit`` bounds what is broadcast, in rows.
    """
    seen, hit, spelled = _hits(docs, benchmark, window, gram, limit)
    so_far = Window.partitionBy("id", "h").orderBy("place", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("length")
    reached = F.coalesce(F.max(end).over(so_far), F.lit(0))
    covered = (
        hit.withColumn("new", F.greatest(end - F.greatest(F.col("place"), reached), F.lit(0)))
        .groupBy("id", "h").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        sized_join(hit.select("id", "h", "spelling").distinct(), spelled.select("spelling", "item").distinct(), ["spelling"], "inner", limit)
        .groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    result = written(covered.join(named, ["id", "h"]), "contaminated")
    counted = sized_join(seen, result, ["id", "h"], "left", limit)
    return counted.select(
        F.nullif("id", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
