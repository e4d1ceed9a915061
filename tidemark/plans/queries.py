"""One query per operator over the test tables.

Every function takes the session and the table folder and returns scalar columns only, so that the
same answer can be computed and compared in another SQL engine (see ``oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import attributes as attr
from tidemark.functions import keys, times
from tidemark.operators import (
    arrival,
    countmin,
    distinct,
    frequency,
    labels,
    spacesaving,
    values,
    windows,
)
from tidemark.schema import DAY_MS, MONITORED_CAPACITY, STREAM, STREAM_CONFIG, TOP_LIST_CAPACITY
from tidemark.session import fresh_folder, tune, written
from tidemark.sources import export, records, tables
from tidemark.sources.rollup import RollUps
from tidemark.sources.store import WindowStore
from tidemark.streaming import arrival as arrival_stream
from tidemark.streaming import labels as label_stream
from tidemark.streaming import windows as window_stream
from tidemark.streaming.sealing import StreamSealer
from tidemark.streaming.totals import RunningTotals

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the range queries: labels of daily windows, and the moment taken as the present.
BEGIN = "20240108T000000"
END = "20240121T000000"
AS_OF = "20240120T120000"
TOP_K = 10
CURRENT_LIMIT = 20
STREAM_ASKED = ("events", "click")
STREAM_COMPARED = "purchase"
MIDDLE = "20240114T000000"
WINDOW_ASKED = "20240110T000000"
KEY_ASKED = "6"
IMPORT_SINCE = "20240110T000000"
SLIDE_MS = 6 * 60 * 60 * 1000
SLIDE_OFFSET_MS = 90 * 60 * 1000
#: Rows per bucket of the ordered queries: small, so that small tables take the path that large ones do.
CHECKED_BUCKET = 250
SKETCH_WIDTH = 1024
SKETCH_DEPTH = 3
SKETCH_CAP = 1 << 30
KMV_SIZE = 256
STORED_KMV = 64
PAGE = (100, 500)
LABEL_COLLECTION = "en"
ARRIVAL_BLOCK = 64
#: The words of documents are dealt to so many days, each with a summary of its own.
WORD_DAYS = 16
#: A list that holds far fewer keys than a stream has.
SMALL_CAPACITY = 24
#: Streams of the streaming query with settings of their own: slide and offset differ for each.
MANY_STREAMS = 100
STREAM_BATCHES = 5
#: Every so many events one arrives some micro-batches after its time.
LATE_EVERY, LATE_PLACE, LATE_BATCHES = 50, 7, 2
LATE_DELAY_MS = 6 * 60 * 60 * 1000
NO_DELAY = "0 seconds"
# Three standard errors of the distinct sketch.
HLL_BOUND = 3 * 1.04 / 64
# A frequent-items sketch that tracks m keys errs by at most 3.5 * 0.75 / m of all events.
TOPK_ERROR = 2.625

# service, collection, start, slide, sketch width, sketch max value, top list; null means default.
STREAM_SETTINGS = [
    ("events", "click", 6 * 3_600_000, 12 * 3_600_000, None, None, 5),
    ("events", "error", None, 3_600_000, 4096, None, None),
    ("events", "view", 0, None, 16, 7, 3),
]

_QUERIES: dict[str, Query] = {}
_STORES: dict[tuple[str, ...], WindowStore | RollUps] = {}
_SEALERS: dict[tuple[str, ...], StreamSealer] = {}


def query(function: Query) -> Query:
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    _QUERIES[function.__name__] = tuned
    return tuned


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_windows(tables.event_records(spark, sf_dir))


def _ranged(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return windows.select_range(tables.event_records(spark, sf_dir), BEGIN, END, **options)


def _asked(df: DataFrame) -> DataFrame:
    return windows.of_stream(df, *STREAM_ASKED)


def _number(name: str) -> Column:
    return attr.attribute(F.col("values"), name).try_cast("double")


def _flat_values(df: DataFrame) -> DataFrame:
    """The attributes of the events table as columns."""
    return df.withColumns(
        {"v_k": attr.attribute(F.col("values"), "k"), "v_value": _number("value")}
    ).drop("values")


# --- sources -------------------------------------------------------------------------------------


@query
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = tables.event_records(spark, sf_dir)
    return rec.select(*STREAM, "key", times.format_label(F.col("ts")).alias("t"), "seq")


@query
def log_events_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.map_concat(
        attr.json_attributes(F.col("props")), attr.attribute_map({"value": F.col("value")})
    )
    rec = records.log_records(
        tables.table(spark, sf_dir, "events"),
        F.lit("events"),
        "event_type",
        "user_id",
        "ts",
        "event_id",
        joined,
    )
    sized = rec.withColumn("n_attributes", F.size("values").cast("long"))
    return _flat_values(sized).drop("ts")


@query
def log_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.total_counts(tables.word_records(spark, sf_dir))


@query
def import_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("collection"),
        F.col("ts").alias("TimeStamp"),
        F.col("user_id").alias("query"),
        F.col("value").alias("hit_docs_num"),
        "event_id",
        "props",
    )
    rec = records.imported_records(log, F.lit("imported"), IMPORT_SINCE, seq="event_id")
    return rec.select(
        *STREAM,
        "key",
        times.format_label(F.col("ts")).alias("t"),
        "seq",
        attr.attribute(F.col("values"), "query").try_cast("long").alias("v_query"),
        _number("hit_docs_num").alias("v_hits"),
        attr.attribute(F.col("values"), "props").alias("v_props"),
        F.size("values").cast("long").alias("n_attributes"),
    )


@query
def labels_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("collection"),
        F.col("source").alias("label_name"),
        F.col("n_chars").cast("string").alias("hit_docs_num"),
    )
    return labels.label_totals(records.label_hits(table))


@query
def export_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").withColumn(
        "img", F.when(F.col("lang") == "de", "NULL").otherwise(F.col("lang"))
    )
    ready = export.exportable(docs, "doc_id", "text", "img", "source")
    return export.export_page(
        ready, *PAGE, rows_per_bucket=CHECKED_BUCKET, ids=docs.select(F.col("doc_id").alias("id"))
    )


# --- windows and listings ------------------------------------------------------------------------


@query
def window_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_labels(_daily(spark, sf_dir))


@query
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = windows.of_stream(_daily(spark, sf_dir), "events")
    return windows.collections(daily, AS_OF)


@query
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_label(frequency.key_counts(_daily(spark, sf_dir)))


@query
def window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_label(frequency.event_counts(_daily(spark, sf_dir)))


@query
def window_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = tables.event_records(spark, sf_dir)
    sliced = windows.assign_windows(rec, SLIDE_MS, SLIDE_OFFSET_MS)
    return windows.with_label(frequency.event_counts(sliced))


@query
def window_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    return windows.with_label(daily).select(*STREAM, "label", "seq")


@query
def window_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each block of events arrives in reverse, so some come after the first of the next day.
    block = F.lit(ARRIVAL_BLOCK)
    place = F.col("seq") % block
    shuffled = tables.event_records(spark, sf_dir).withColumn(
        "seq", F.col("seq") - place + (block - 1 - place)
    )
    dated = arrival.assign_arrival_windows(shuffled, CHECKED_BUCKET)
    return windows.with_label(dated).select(*STREAM, "label", "key", "seq")


def _config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STREAM_SETTINGS, STREAM_CONFIG)


@query
def config_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = tables.event_records(spark, sf_dir)
    sliced = windows.assign_configured_windows(rec, _config(spark))
    return windows.with_label(frequency.event_counts(sliced))


@query
def config_toplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = tables.event_records(spark, sf_dir)
    counts = frequency.key_counts(windows.assign_configured_windows(rec, _config(spark)))
    limited = windows.with_config(
        counts, _config(spark), {"topk_max_count": TOP_LIST_CAPACITY}
    )
    largest = _config(spark).agg(F.max("topk_max_count")).first()[0]
    top = frequency.configured_top_list(limited, max(largest, TOP_LIST_CAPACITY))
    return _ranked(windows.with_label(top).drop("topk_max_count"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rk", F.col("rk").cast("long"))


# --- frequent keys -------------------------------------------------------------------------------


@query
def window_toplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = frequency.top_list(frequency.key_counts(_daily(spark, sf_dir)))
    return _ranked(windows.with_label(top))


@query
def words_toplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = windows.assign_windows(tables.word_records(spark, sf_dir))
    return _ranked(windows.with_label(frequency.top_list(frequency.key_counts(words))))


@query
def topk_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = tables.event_records(spark, sf_dir)
    return _ranked(frequency.current_top_keys(rec, TOP_K, AS_OF))


@query
def topk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(frequency.top_keys(_ranged(spark, sf_dir), TOP_K))


@query
def topk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.top_keys_of_stream(_asked(_ranged(spark, sf_dir)), TOP_K)


@query
def topk_range_end_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(frequency.top_keys(_ranged(spark, sf_dir, label="end"), TOP_K))


@query
def topk_range_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frequency.key_counts(_ranged(spark, sf_dir))
    return _ranked(frequency.top_keys_truncated(counts, TOP_K))


@query
def topk_range_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(frequency.top_keys(_ranged(spark, sf_dir, as_of=AS_OF), TOP_K))


@query
def sales_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(frequency.top_keys(tables.sales_records(spark, sf_dir), CURRENT_LIMIT))


def _with_bound(exact: DataFrame, estimates: DataFrame, totals: DataFrame, m: int) -> DataFrame:
    """Flag each exact count whose estimate errs by no more than the sketch may."""
    beside = exact.join(estimates, [*STREAM, "key"], "left").join(totals, STREAM)
    error = F.abs(F.coalesce(F.col("estimate"), F.lit(0)) - F.col("n"))
    return beside.select(
        *STREAM,
        F.col("rk").cast("long").alias("rk"),
        "key",
        "n",
        (error <= F.lit(TOPK_ERROR / m) * F.col("total")).alias("within_bound"),
    )


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("total"))


@query
def topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = _ranged(spark, sf_dir)
    sketches = frequency.top_sketches(ranged)
    estimates = frequency.merged_top_keys(sketches, TOP_LIST_CAPACITY)
    exact = frequency.top_keys(ranged, TOP_K)
    return _with_bound(exact, estimates, _totals(ranged), TOP_LIST_CAPACITY)


def _daily_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``documents``, one stream per language, dealt to days by ``doc_id``."""
    docs = tables.table(spark, sf_dir, "documents")
    day = F.pmod(F.col("doc_id"), F.lit(WORD_DAYS)) * F.lit(DAY_MS)
    ts = times.later(times.moment("20240101T000000"), day)
    return windows.assign_windows(records.token_records(docs, "text", F.lit("docs"), "lang", ts))


def _monitored(words: DataFrame) -> DataFrame:
    daily = spacesaving.summaries(frequency.key_counts(words), MONITORED_CAPACITY)
    return spacesaving.merge(daily, MONITORED_CAPACITY)


@query
def monitored_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of at most ``MONITORED_CAPACITY`` words a day, merged over all days."""
    return _ranked(_monitored(_daily_words(spark, sf_dir)))


@query
def monitored_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the list promises, checked on every word: none above the floor is missing, no count is out of bounds."""
    words = _daily_words(spark, sf_dir)
    listed = _monitored(words)
    floors = listed.groupBy(*STREAM).agg(F.max("floor").alias("most"))
    beside = frequency.total_counts(words).join(listed, [*STREAM, "key"], "left").join(floors, STREAM)
    missed = F.col("count").isNull() & (F.col("n") > F.col("most"))
    broken = ~F.col("n").between(F.col("count") - F.col("error"), F.col("count"))
    bound = F.sum("n") / F.lit(MONITORED_CAPACITY + 1)
    return beside.groupBy(*STREAM).agg(
        F.sum("n").alias("n_events"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count("count").alias("n_listed"),
        F.count(F.when(missed, 1)).alias("n_missed"),
        F.count(F.when(broken, 1)).alias("n_broken"),
        (F.max("most") <= bound).alias("floor_within_bound"),
    )


# --- distinct keys -------------------------------------------------------------------------------


@query
def distinct_current_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_keys(windows.open_window(tables.event_records(spark, sf_dir), AS_OF))


@query
def distinct_range_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_keys(_ranged(spark, sf_dir))


def _within(exact: DataFrame, estimates: DataFrame) -> DataFrame:
    beside = exact.join(estimates, STREAM)
    error = F.abs(F.col("estimate") - F.col("n_distinct"))
    return beside.select(
        *STREAM,
        "n_distinct",
        (error <= F.lit(HLL_BOUND) * F.col("n_distinct")).alias("within_bound"),
    )


@query
def distinct_current_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.open_window(tables.event_records(spark, sf_dir), AS_OF)
    return _within(distinct.distinct_keys(rows), distinct.approximate_distinct(rows))


@query
def distinct_range_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = _ranged(spark, sf_dir)
    merged = distinct.merged_distinct(distinct.distinct_sketches(ranged))
    return _within(distinct.distinct_keys(ranged), merged)


@query
def hll_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = distinct.accuracy(tables.sales_records(spark, sf_dir))
    return report.select(
        *STREAM, "exact", (F.col("relative_error") <= HLL_BOUND).alias("within_bound")
    )


@query
def kmv_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = distinct.kmv_hashes(tables.sales_records(spark, sf_dir), KMV_SIZE)
    return distinct.kmv_estimate(hashes, KMV_SIZE)


@query
def kmv_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets kept per window and merged over the range."""
    per_window = distinct.kmv_hashes(
        _ranged(spark, sf_dir), KMV_SIZE, [*STREAM, "window_start"]
    )
    return distinct.kmv_estimate(distinct.merge_kmv(per_window, KMV_SIZE), KMV_SIZE)


# --- count-min -----------------------------------------------------------------------------------


def _cells(counts: DataFrame) -> DataFrame:
    return countmin.cells(counts, SKETCH_DEPTH, SKETCH_WIDTH, SKETCH_CAP)


def _cell_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("i", F.col("i").cast("long"))


@query
def cms_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(frequency.key_counts(_daily(spark, sf_dir)))
    return _cell_columns(windows.with_label(cells))


@query
def config_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream with its own sketch width and cap."""
    counts = frequency.key_counts(_daily(spark, sf_dir))
    defaults = {"sketch_width": SKETCH_WIDTH, "sketch_max_value": SKETCH_CAP}
    sized = windows.with_config(counts, _config(spark), defaults)
    cells = countmin.cells(
        sized, SKETCH_DEPTH, F.col("sketch_width"), F.col("sketch_max_value")
    )
    return _cell_columns(windows.with_label(cells))


@query
def cms_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(frequency.key_counts(_ranged(spark, sf_dir)))
    return _cell_columns(countmin.merge(cells))


@query
def cms_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, since both the keys and the cells come from it: the log is counted once.
    counts = written(frequency.key_counts(_ranged(spark, sf_dir)), "counts")
    merged = countmin.merge(_cells(counts))
    return countmin.estimate(counts, merged, SKETCH_DEPTH, SKETCH_WIDTH)


# --- attributes ----------------------------------------------------------------------------------


@query
def values_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_label(_flat_values(values.first_seen(_daily(spark, sf_dir))))


@query
def values_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_values(values.newest(values.first_seen(_ranged(spark, sf_dir))))


@query
def values_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attribute rows of a named sealed window."""
    rec = _asked(tables.event_records(spark, sf_dir))
    window = windows.select_range(rec, WINDOW_ASKED, WINDOW_ASKED)
    limited = values.first_values(values.first_seen(window), CURRENT_LIMIT)
    return windows.with_label(_flat_values(limited))


@query
def values_current_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attribute rows of the open window."""
    rec = _asked(tables.event_records(spark, sf_dir))
    limited = values.first_values(
        values.first_seen(windows.open_window(rec, AS_OF)), CURRENT_LIMIT
    )
    return windows.with_label(_flat_values(limited))


@query
def value_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = values.values_of_key(tables.event_records(spark, sf_dir), KEY_ASKED)
    seen = values.first_seen(windows.open_window(rec, AS_OF))
    return seen.select(*STREAM, "key", attr.attribute(F.col("values"), "k").alias("v_k"))


@query
def values_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = values.values_and_key(values.first_seen(_daily(spark, sf_dir)))
    packed = seen.withColumn("packed", attr.pack(F.col("values"))).drop("values")
    return windows.with_label(packed)


@query
def value_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = windows.select_range(_asked(tables.event_records(spark, sf_dir)), BEGIN)
    return _flat_values(values.values_with_counts(since))


@query
def value_and_count_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from the merged count-min sketch, joined to the newest attributes."""
    since = windows.select_range(tables.event_records(spark, sf_dir), BEGIN)
    rolled = values.key_rollup(since)
    merged = countmin.merge(_cells(rolled))
    estimates = countmin.estimate(rolled, merged, SKETCH_DEPTH, SKETCH_WIDTH)
    counted = values.attach_counts(values.newest(rolled), estimates, "estimate")
    return _flat_values(counted)


@query
def all_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = windows.of_stream(tables.event_records(spark, sf_dir), "events")
    since = windows.select_range(rec, BEGIN, as_of=AS_OF)
    return _flat_values(values.values_with_counts(since))


# --- labels --------------------------------------------------------------------------------------


@query
def labels_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_totals(tables.source_hits(spark, sf_dir))


@query
def labels_of_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = labels.label_totals(tables.source_hits(spark, sf_dir))
    return labels.labels_of(totals, LABEL_COLLECTION)


@query
def labels_after_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = labels.label_totals(tables.source_hits(spark, sf_dir))
    return labels.without_collection(totals, LABEL_COLLECTION)


# --- scalar functions ----------------------------------------------------------------------------


@query
def key_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as plain text, lower-case and upper-case digests, depending on the event type."""
    digest = F.md5("key")
    written = (
        F.when(F.col("collection") == "click", F.upper(digest))
        .when(F.col("collection") == "view", digest)
        .otherwise(F.col("key"))
    )
    return tables.event_records(spark, sf_dir).select(
        "seq",
        written.alias("key"),
        keys.canonical_key(written).alias("canonical"),
        keys.hex_digest(F.col("key").cast("long")).alias("hex"),
    )


@query
def pack_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = attr.pack(
        attr.attribute_map(
            {
                "user": F.col("user_id"),
                "k": F.get_json_object("props", "$.k"),
                "type": F.col("event_type"),
            }
        )
    )
    return tables.table(spark, sf_dir, "events").select("event_id", packed.alias("packed"))


@query
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with a repeated attribute and a ``#`` in a value; error events are malformed."""
    text = F.concat(
        F.lit("k#1$path#"),
        F.col("event_type"),
        F.lit("#"),
        F.col("user_id").cast("string"),
        F.lit("$k#"),
        F.col("user_id").cast("string"),
        F.when(F.col("event_type") == "error", F.lit("$broken")).otherwise(F.lit("")),
    )
    parsed = tables.table(spark, sf_dir, "events").select(
        "event_id", attr.parse(text).alias("values")
    )
    return parsed.filter(F.col("values").isNotNull()).select(
        "event_id",
        attr.attribute(F.col("values"), "k").alias("v_k"),
        attr.attribute(F.col("values"), "path").alias("v_path"),
        F.size("values").cast("long").alias("n_attributes"),
    )


@query
def time_iso_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    label = times.format_label(ts)
    return tables.event_records(spark, sf_dir).select(
        "seq",
        label.alias("label"),
        times.format_label(times.start_of_day(times.parse_label(label))).alias("day"),
        times.format_label(times.next_day(ts)).alias("next_day"),
    )


@query
def ms_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = tables.event_records(spark, sf_dir)
    return rec.select("seq", times.ms_of_day(F.col("ts")).alias("ms"))


# --- stored windows ------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> WindowStore:
    """The windows over by ``AS_OF``, written once per session and table folder."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _STORES:
        store = _new_store(spark, "store")
        store.seal_records(_daily(spark, sf_dir), "first", AS_OF)
        _STORES[place] = store
    return _STORES[place]


def _new_store(spark: SparkSession, name: str) -> WindowStore:
    return WindowStore(
        spark, fresh_folder(spark, name), depth=SKETCH_DEPTH, width=SKETCH_WIDTH, max_value=SKETCH_CAP
    )


@query
def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _store(spark, sf_dir).catalog()
    return windows.with_label(catalog).drop("seal")


@query
def stored_toplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(windows.with_label(_store(spark, sf_dir).top_lists()))


@query
def stored_topk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(frequency.top_keys(_store(spark, sf_dir).keys(BEGIN, END), TOP_K))


@query
def stored_topk_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _store(spark, sf_dir).top_lists(BEGIN, END)
    return _ranked(frequency.top_keys_truncated(top, TOP_K))


@query
def stored_topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored summaries that each had to drop most keys, merged over a range."""
    place = (spark.sparkContext.applicationId, sf_dir, "small")
    if place not in _STORES:
        store = WindowStore(
            spark, fresh_folder(spark, "small"), SMALL_CAPACITY, SKETCH_DEPTH, SKETCH_WIDTH, SKETCH_CAP
        )
        store.seal_records(_daily(spark, sf_dir), "first", AS_OF)
        _STORES[place] = store
    return _ranked(spacesaving.merge(_STORES[place].frequent(BEGIN, END), SMALL_CAPACITY))


@query
def stored_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    merged = distinct.merged_distinct(store.distinct_sketches(BEGIN, END))
    return _within(distinct.distinct_keys(store.keys(BEGIN, END)), merged)


@query
def stored_cms_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_columns(countmin.merge(_store(spark, sf_dir).cells(BEGIN, END)))


def _rolled(spark: SparkSession, sf_dir: str) -> RollUps:
    """Windows with minimum values, their cells brought up to date after half of the days and at the end."""
    place = (spark.sparkContext.applicationId, sf_dir, "rolled")
    if place not in _STORES:
        store = WindowStore(
            spark, fresh_folder(spark, "rolled"), depth=SKETCH_DEPTH, width=SKETCH_WIDTH, max_value=SKETCH_CAP,
            kmv_size=STORED_KMV,
        )
        rolled = RollUps(store)
        for name, as_of in (("first", BEGIN), ("second", AS_OF)):
            store.seal_records(_daily(spark, sf_dir), name, as_of)
            rolled.refresh()
        _STORES[place] = rolled
    return _STORES[place]


@query
def stored_distinct_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct count of a range from cells of several days."""
    rolled = _rolled(spark, sf_dir)
    merged = distinct.merged_distinct(rolled.sketches("distinct", BEGIN, END))
    return _within(distinct.distinct_keys(rolled.store.keys(BEGIN, END)), merged)


@query
def stored_cms_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_columns(countmin.merge(_rolled(spark, sf_dir).sketches("cms", BEGIN, END)))


@query
def stored_kmv_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of a range from stored minimum values."""
    hashes = _rolled(spark, sf_dir).sketches("kmv", BEGIN, END)
    return distinct.kmv_estimate(distinct.merge_kmv(hashes, STORED_KMV), STORED_KMV)


@query
def stored_kmv_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream, keys of the first part of a range that the rest has as well, and those of either alone."""
    store = _rolled(spark, sf_dir).store
    early = F.col("window_start") <= times.moment(MIDDLE)
    return distinct.compare_kmv(store.minimum_values(BEGIN, END), early, STORED_KMV, STREAM)


@query
def stored_kmv_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two streams share over a range, and those of either alone."""
    hashes = _rolled(spark, sf_dir).sketches("kmv", BEGIN, END)
    side = F.when(F.col("collection") == STREAM_ASKED[1], True).when(F.col("collection") == STREAM_COMPARED, False)
    return distinct.compare_kmv(hashes, side, STORED_KMV)


@query
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _store(spark, sf_dir).keys(WINDOW_ASKED, WINDOW_ASKED)
    return windows.with_label(_flat_values(stored).drop("n"))


@query
def stored_value_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored windows together with the window still open, read from the records."""
    store = _store(spark, sf_dir)
    rec = tables.event_records(spark, sf_dir)
    live = values.key_rollup(windows.open_window(rec, AS_OF))
    return _flat_values(
        values.values_with_counts(store.keys(BEGIN).unionByName(live))
    )


@query
def seal_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second seal doubles every count; windows sealed before it keep theirs."""
    store = _new_store(spark, "once")
    daily = _daily(spark, sf_dir)
    store.seal_records(daily, "first", AS_OF)
    store.seal_records(daily.unionByName(daily), "second")
    return windows.with_label(store.keys().drop("values"))


# --- streaming -----------------------------------------------------------------------------------


@query
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows sealed by the watermark, then the tail of the finite stream."""
    store = _new_store(spark, "stream")
    writer = window_stream.seal_windows(
        tables.event_stream(spark, sf_dir), store, "events", delay=NO_DELAY
    )
    _drain(spark, writer, "stream-state")
    window_stream.flush_tail(tables.event_records(spark, sf_dir), store, "tail")
    return windows.with_label(_flat_values(store.keys()))


@query
def stream_open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept up to date while their windows are open."""
    path = fresh_folder(spark, "open")
    writer = window_stream.track_open_windows(
        tables.event_stream(spark, sf_dir), path, delay=NO_DELAY
    )
    _drain(spark, writer, "open-state")
    return windows.with_label(window_stream.latest_counts(spark.read.parquet(path)))


@query
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "labels")
    writer = label_stream.track_labels(tables.source_hit_stream(spark, sf_dir), path)
    _drain(spark, writer, "labels-state")
    return label_stream.latest_totals(spark.read.parquet(path))


@query
def stream_label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over several micro-batches, folded every second one."""
    hits = tables.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("collection"), F.col("source").alias("label_name"), F.lit(1).cast("long").alias("hits"), "doc_id"
    )
    batch = F.pmod(F.col("doc_id"), F.lit(STREAM_BATCHES)).cast("int")
    totals = RunningTotals(spark, fresh_folder(spark, "label-totals"), fold_every=2)
    _drain(spark, totals.writer(_in_batches(spark, hits, batch)), "label-totals-state")
    return totals.totals()


def _in_batches(spark: SparkSession, rec: DataFrame, batch: Column) -> DataFrame:
    """Rows as a stream that brings ``batch`` 0 to ``STREAM_BATCHES`` - 1 one after another.

    The rows are written once, by all tasks, and the stream is of batch numbers, each of which brings its rows.
    """
    path, numbers = fresh_folder(spark, "batches"), fresh_folder(spark, "batch-numbers")
    rec.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    for number in range(STREAM_BATCHES):
        spark.range(number, number + 1, 1, 1).select(F.col("id").cast("int").alias("batch")).write.mode("append").parquet(numbers)
    placed = spark.read.schema(rec.withColumn("batch", batch).schema).parquet(path)
    turn = spark.readStream.schema("batch int").option("maxFilesPerTrigger", 1).parquet(numbers)
    return placed.join(F.broadcast(turn), "batch").select(*rec.columns)


def _late_batch(rec: DataFrame) -> Column:
    """The micro-batch of an event by its number; some come ``LATE_BATCHES`` after their time."""
    total = rec.agg(F.max("seq") + 1).first()[0]
    late = F.when(F.col("seq") % LATE_EVERY == LATE_PLACE, LATE_BATCHES).otherwise(0)
    batch = F.floor(F.col("seq") * STREAM_BATCHES / F.lit(total)) + late
    return F.least(batch, F.lit(STREAM_BATCHES - 1)).cast("int")


def _sealed_stream(spark: SparkSession, sf_dir: str) -> StreamSealer:
    """Daily windows of a stream with late events, all sealed; run once per session and table folder."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _SEALERS:
        rec = tables.event_records(spark, sf_dir)
        sealer = StreamSealer(
            spark, _new_store(spark, "late"), fresh_folder(spark, "late-open"), "late", LATE_DELAY_MS
        )
        _drain(spark, sealer.writer(_in_batches(spark, rec, _late_batch(rec))), "late-state")
        sealer.close()
        _SEALERS[place] = sealer
    return _SEALERS[place]


@query
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches; an event whose window is sealed counts in the window open when it comes."""
    return windows.with_label(_sealed_stream(spark, sf_dir).store.keys().drop("values"))


@query
def stream_late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side output: events that came after their window was sealed, as they came."""
    late = _sealed_stream(spark, sf_dir).late_records()
    return late.select(*STREAM, "key", times.format_label(F.col("ts")).alias("t"), "seq")


@query
def stream_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred streams with a window length and start of their own in one streaming query."""
    name = F.concat(F.lit("c"), (F.col("key").cast("long") % MANY_STREAMS).cast("string"))
    rec = tables.event_records(spark, sf_dir).withColumn("collection", name)
    settings = [
        ("events", f"c{i}", i * 60_000, (i + 1) * 600_000, None, None, None) for i in range(MANY_STREAMS)
    ]
    sealer = StreamSealer(
        spark,
        _new_store(spark, "settings"),
        fresh_folder(spark, "settings-open"),
        "settings",
        0,
        spark.createDataFrame(settings, STREAM_CONFIG),
    )
    total = rec.agg(F.max("seq") + 1).first()[0]
    batch = F.floor(F.col("seq") * STREAM_BATCHES / F.lit(total)).cast("int")
    _drain(spark, sealer.writer(_in_batches(spark, rec, batch)), "settings-state")
    sealer.close()
    return windows.with_label(sealer.store.keys().drop("values"))


@query
def stream_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open day of every stream carried over micro-batches with late events."""
    rec = tables.event_records(spark, sf_dir)
    path = fresh_folder(spark, "arrival")
    writer = arrival_stream.track_arrival_windows(_in_batches(spark, rec, _late_batch(rec)), path, CHECKED_BUCKET)
    _drain(spark, writer, "arrival-state")
    placed = arrival_stream.arrival_windows(spark, path)
    return windows.with_label(placed).select(*STREAM, "label", "key", "seq")


def _drain(spark: SparkSession, writer, name: str) -> None:
    running = (
        writer.option("checkpointLocation", fresh_folder(spark, name))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
