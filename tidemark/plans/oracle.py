"""The registered queries in plain SQL over the same parquet tables.

Written from the definition of each question, not from the Spark plans, so that both sides can
disagree.
"""

from __future__ import annotations

from tidemark.plans import queries as q
from tidemark.schema import DEFAULT_CONFIG, MONITORED_CAPACITY, TOP_LIST_CAPACITY

LABEL = "'%Y%m%dT%H%M%S'"


def _time(label: str) -> str:
    return f"strptime('{label}', {LABEL})"


def _label(ts: str) -> str:
    return f"strftime({ts}, {LABEL})"


def _ms(ts: str) -> str:
    # epoch_ms rounds half a millisecond up; a clock that has not reached it does not.
    return f"(epoch_us({ts}) // 1000)"


REC = """
rec AS (
    SELECT 'events' AS service, event_type AS collection, CAST(user_id AS VARCHAR) AS key,
           ts, event_id AS seq, value AS v_value,
           regexp_extract(props, '"k": *([0-9]+)', 1) AS v_k
    FROM events
),
daily AS (
    SELECT *, date_trunc('day', ts) AS w, date_trunc('day', ts) + INTERVAL 1 DAY AS w_end FROM rec
)"""

SALES = """
sales AS (
    SELECT 'sales' AS service, l_returnflag AS collection, CAST(l_partkey AS VARCHAR) AS key
    FROM lineitem
)"""

WORDS = """
words AS (
    SELECT 'docs' AS service, lang AS collection, key
    FROM (SELECT lang, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS key
          FROM documents)
    WHERE key <> ''
)"""

DAILY_WORDS = f"""
daily_words AS (
    SELECT 'docs' AS service, lang AS collection, doc_id % {q.WORD_DAYS} AS w, key
    FROM (SELECT lang, doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS key
          FROM documents)
    WHERE key <> ''
)"""

BEGIN, END, AS_OF = _time(q.BEGIN), _time(q.END), _time(q.AS_OF)
OPEN = f"ts >= date_trunc('day', {AS_OF}) AND ts <= {AS_OF}"
IN_RANGE = f"w BETWEEN {BEGIN} AND {END}"
RANGED = f"ranged AS (SELECT * FROM daily WHERE {IN_RANGE})"
S = "service, collection"


def _sql(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def _top(rows: str, k: int, where: str = "TRUE") -> str:
    """Rank the keys of every stream in ``rows``."""
    return f"""
SELECT {S}, key, n, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY n DESC, key) AS rk FROM (
        SELECT {S}, key, count(*) AS n FROM {rows} WHERE {where} GROUP BY ALL))
WHERE rk <= {k}"""


def _top_list(windowed: str, capacity: int) -> str:
    """Rank the keys of every window of ``windowed (…, w, key)``."""
    return f"""
SELECT {S}, w, key, n, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY {S}, w ORDER BY n DESC, key) AS rk FROM (
        SELECT {S}, w, key, count(*) AS n FROM {windowed} GROUP BY ALL))
WHERE rk <= {capacity}"""


def _first(rows: str) -> str:
    """First-seen attributes per window and key."""
    return f"""
SELECT {S}, w, key, arg_min(v_k, seq) AS v_k, arg_min(v_value, seq) AS v_value
FROM {rows} GROUP BY ALL"""


def _newest(rows: str) -> str:
    """First-seen attributes of the newest window, with the count over all windows."""
    return f"""
SELECT {S}, key, arg_max(v_k, w) AS v_k, arg_max(v_value, w) AS v_value,
       CAST(sum(n) AS BIGINT) AS n
FROM (SELECT {S}, w, key, arg_min(v_k, seq) AS v_k, arg_min(v_value, seq) AS v_value,
             count(*) AS n
      FROM {rows} GROUP BY ALL)
GROUP BY ALL"""


def _buckets(rows: str, group: str) -> str:
    """The cells every row of ``rows (…, key)`` touches."""
    return f"""
SELECT {group}, key, i, CAST('0x' || substr(md5((i // 4) || '|' || key), 8 * (i % 4) + 1, 8)
                             AS BIGINT) % {q.SKETCH_WIDTH} AS b
FROM {rows}, range({q.SKETCH_DEPTH}) AS depth(i)"""


def _window_cells(rows: str) -> str:
    return f"""
SELECT {S}, w, i, b, least(CAST(count(*) AS BIGINT), {q.SKETCH_CAP}) AS v
FROM ({_buckets(rows, f"{S}, w")}) GROUP BY ALL"""


def _merged_cells(rows: str) -> str:
    return f"SELECT {S}, i, b, CAST(sum(v) AS BIGINT) AS v FROM ({_window_cells(rows)}) GROUP BY ALL"


def _estimates(rows: str) -> str:
    return f"""
SELECT p.service, p.collection, p.key, min(m.v) AS estimate
FROM ({_buckets(f"(SELECT DISTINCT {S}, key FROM {rows})", S)}) p
JOIN ({_merged_cells(rows)}) m USING (service, collection, i, b)
GROUP BY ALL"""


def _kmv(rows: str, size: int = q.KMV_SIZE) -> str:
    return f"""
SELECT {S}, CASE WHEN count(*) < {size} THEN CAST(count(*) AS DOUBLE)
                 ELSE {size - 1}.0::DOUBLE / (CAST(max(h) AS DOUBLE) / 1152921504606846976.0::DOUBLE)
            END AS estimate
FROM (SELECT {S}, h, row_number() OVER (PARTITION BY {S} ORDER BY h) AS r
      FROM (SELECT DISTINCT {S}, CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) AS h FROM {rows}))
WHERE r <= {size} GROUP BY ALL"""


def _compared(rows: str, left: str, group: str = "") -> str:
    """Estimates of two sets of keys, told apart by ``left``, from the smallest hashes of their union."""
    size = q.STORED_KMV
    per = f"{group}, " if group else ""
    whole = f"PARTITION BY {group} " if group else ""
    parts = ", ".join(
        f"coalesce({part} * either / nullif(kept, 0), 0.0::DOUBLE) AS {part}" for part in ("shared", "left_only", "right_only")
    )
    return f"""
SELECT {per}either, {parts}, CAST(shared AS DOUBLE) / nullif(kept, 0) AS similarity
FROM (SELECT {per}count(*) AS kept,
             CASE WHEN count(*) < {size} THEN CAST(count(*) AS DOUBLE)
                  ELSE {size - 1}.0::DOUBLE / (CAST(max(h) AS DOUBLE) / 1152921504606846976.0::DOUBLE) END AS either,
             count(*) FILTER (l AND r) AS shared, count(*) FILTER (l AND NOT r) AS left_only,
             count(*) FILTER (r AND NOT l) AS right_only
      FROM (SELECT {per}h, l, r, row_number() OVER ({whole}ORDER BY h) AS place
            FROM (SELECT {per}CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) AS h,
                         bool_or({left}) AS l, bool_or(NOT ({left})) AS r
                  FROM {rows} GROUP BY {per}h))
      WHERE place <= {size}{f" GROUP BY {group}" if group else ""})"""


def _summaries(rows: str, capacity: int, bounding: int | None = None) -> list[str]:
    """Lists of ``capacity`` keys per window of ``rows (…, w, key)``, merged per stream as ``merged``.

    What a list does not hold is bounded by the count at rank ``bounding``, by default the first one left out.
    """
    bounding = bounding or capacity + 1
    return [
        f"""
parts AS (
    SELECT *, coalesce(max(CASE WHEN r = {bounding} THEN n END) OVER (PARTITION BY {S}, w), 0) AS lost
    FROM (SELECT *, row_number() OVER (PARTITION BY {S}, w ORDER BY n DESC, key) AS r
          FROM (SELECT {S}, w, key, count(*) AS n FROM {rows} GROUP BY ALL)))""",
        f"""
kept AS (
    SELECT {S}, key, CAST(sum(n) AS BIGINT) AS least, CAST(sum(n - lost) AS BIGINT) AS above
    FROM parts WHERE r <= {capacity} GROUP BY ALL)""",
        f"bases AS (SELECT {S}, CAST(sum(lost) AS BIGINT) AS base FROM (SELECT DISTINCT {S}, w, lost FROM parts) GROUP BY ALL)",
        f"""
merged AS (
    SELECT *, coalesce(max(CASE WHEN rk = {capacity + 1} THEN count END) OVER (PARTITION BY {S}), base) AS floor
    FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY count DESC, key) AS rk
          FROM (SELECT {S}, key, above + base AS count, above + base - least AS error, base
                FROM kept JOIN bases USING (service, collection))))""",
    ]


def _late() -> list[str]:
    """Events with their micro-batch, the time reached before it, and whether they came too late."""
    batch = f"seq * {q.STREAM_BATCHES} // (SELECT max(seq) + 1 FROM rec)"
    late = f"CASE WHEN seq % {q.LATE_EVERY} = {q.LATE_PLACE} THEN {q.LATE_BATCHES} ELSE 0 END"
    return [
        f"batched AS (SELECT *, least({batch} + {late}, {q.STREAM_BATCHES - 1}) AS batch FROM daily)",
        f"""
times AS (
    SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  - INTERVAL {q.LATE_DELAY_MS} MILLISECOND AS reached
    FROM (SELECT batch, max(ts) AS newest FROM batched GROUP BY batch))""",
        "arrived AS (SELECT *, coalesce(w_end <= reached, FALSE) AS late FROM batched JOIN times USING (batch))",
    ]


def _distinct(rows: str, flag: bool = False, where: str = "TRUE") -> str:
    extra = ", TRUE AS within_bound" if flag else ""
    return f"""
SELECT {S}, count(DISTINCT key) AS n_distinct{extra} FROM {rows} WHERE {where} GROUP BY ALL"""


def _settings() -> str:
    def text(value) -> str:
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    rows = ", ".join(f"({', '.join(text(v) for v in row)})" for row in q.STREAM_SETTINGS)
    return f"""
config(service, collection, start_ms, slide_ms, width, max_value, capacity) AS (VALUES {rows}),
configured AS (
    SELECT service, collection, key, capacity,
           make_timestamp((ms - ((ms - start_ms) % slide_ms + slide_ms) % slide_ms) * 1000) AS w
    FROM (SELECT {S}, key, {_ms('ts')} AS ms,
                 coalesce(start_ms, {DEFAULT_CONFIG["start_time_ms"]}) AS start_ms,
                 coalesce(slide_ms, {DEFAULT_CONFIG["slide_length_ms"]}) AS slide_ms,
                 coalesce(capacity, {TOP_LIST_CAPACITY}) AS capacity
          FROM rec LEFT JOIN config USING (service, collection)))"""


def _sealed() -> str:
    return f"sealed AS (SELECT * FROM daily WHERE w_end <= {AS_OF})"


ASKED = "service = '{}' AND collection = '{}'".format(*q.STREAM_ASKED)
LABELS = "labelled AS (SELECT lang AS collection, source AS label_name FROM documents)"
TOTALS = "SELECT collection, label_name, count(*) AS hit_docs_num FROM labelled"
ROWS = f"{S}, {_label('w')} AS label"


def all_oracles() -> dict[str, str]:
    block = q.ARRIVAL_BLOCK
    offset, limit = q.PAGE
    start = f"{_ms('ts')} - (({_ms('ts')} - {q.SLIDE_OFFSET_MS}) % {q.SLIDE_MS})"
    seen_asked = f"SELECT * FROM ({_first('asked')}) ORDER BY key LIMIT {q.CURRENT_LIMIT}"
    value_columns = f"{S}, key, v_k, v_value"
    return {
        "log_events": _sql([REC], f"SELECT {S}, key, {_label('ts')} AS t, seq FROM rec"),
        "log_events_values": _sql(
            [REC], f"SELECT {S}, key, seq, v_k, v_value, CAST(2 AS BIGINT) AS n_attributes FROM rec"
        ),
        "log_tokens": _sql([WORDS], f"SELECT {S}, key, count(*) AS n FROM words GROUP BY ALL"),
        "import_filtered": f"""
SELECT 'imported' AS service, event_type AS collection, CAST(user_id AS VARCHAR) AS key,
       {_label('ts')} AS t, event_id AS seq, user_id AS v_query, value AS v_hits,
       props AS v_props, CAST(6 AS BIGINT) AS n_attributes
FROM events WHERE ts >= {_time(q.IMPORT_SINCE)} AND value > 0""",
        "labels_import": """
SELECT lang AS collection, source AS label_name, CAST(sum(n_chars) AS BIGINT) AS hit_docs_num
FROM documents GROUP BY ALL""",
        "export_tagged": f"""
SELECT id, block FROM (
    SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS position,
           '<DOCID>' || doc_id || chr(10) || '<Content>' || text || chr(10) || '<Img>' || img
           || chr(10) || '<ShareSourceName>' || source AS block
    FROM (SELECT *, CASE WHEN lang = 'de' THEN 'NULL' ELSE lang END AS img FROM documents)
    WHERE strlen(text) > 10 AND img <> 'NULL')
WHERE position > {offset} AND position <= {offset + limit}""",
        "window_catalog": _sql([REC], f"SELECT DISTINCT {ROWS} FROM daily"),
        "collections": _sql([REC], f"SELECT DISTINCT {S} FROM daily WHERE w_end <= {AS_OF}"),
        "window_counts": _sql([REC], f"SELECT {ROWS}, key, count(*) AS n FROM daily GROUP BY ALL"),
        "window_events": _sql([REC], f"SELECT {ROWS}, count(*) AS n_events FROM daily GROUP BY ALL"),
        "window_slide": _sql(
            [REC],
            f"SELECT {S}, {_label(f'make_timestamp(({start}) * 1000)')} AS label, "
            "count(*) AS n_events FROM rec GROUP BY ALL",
        ),
        "window_day": _sql([REC], f"SELECT {ROWS}, seq FROM daily"),
        "window_arrival_order": _sql(
            [
                REC,
                f"""shuffled AS (
SELECT service, collection, key, w, seq - seq % {block} + ({block - 1} - seq % {block}) AS seq
FROM daily)""",
            ],
            f"""
SELECT {S}, {_label('opened')} AS label, key, seq FROM (
    SELECT *, max(w) OVER (PARTITION BY {S} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS opened
    FROM shuffled)""",
        ),
        "config_applied": _sql(
            [REC, _settings()], f"SELECT {ROWS}, count(*) AS n_events FROM configured GROUP BY ALL"
        ),
        "config_toplist": _sql(
            [REC, _settings()],
            f"""
SELECT {ROWS}, key, n, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY {S}, w ORDER BY n DESC, key) AS rk FROM (
        SELECT {S}, w, capacity, key, count(*) AS n FROM configured GROUP BY ALL))
WHERE rk <= capacity""",
        ),
        "window_toplist": _sql(
            [REC], f"SELECT {ROWS}, key, n, rk FROM ({_top_list('daily', TOP_LIST_CAPACITY)})"
        ),
        "words_toplist": _sql(
            [WORDS],
            f"SELECT '20240101T000000' AS label, * FROM ({_top('words', TOP_LIST_CAPACITY)})",
        ),
        "topk_current": _sql([REC], _top("rec", q.TOP_K, OPEN)),
        "topk_range": _sql([REC], _top("daily", q.TOP_K, IN_RANGE)),
        "topk_stream": _sql(
            [REC],
            f"SELECT {S}, key, count(*) AS n FROM daily WHERE {IN_RANGE} AND {ASKED} "
            f"GROUP BY ALL ORDER BY n DESC, key LIMIT {q.TOP_K}",
        ),
        "topk_range_end_label": _sql(
            [REC], _top("daily", q.TOP_K, f"w_end BETWEEN {BEGIN} AND {END}")
        ),
        "topk_range_truncated": _sql([REC, RANGED], _truncated("ranged")),
        "topk_range_open": _sql(
            [REC],
            _top("daily", q.TOP_K, f"({IN_RANGE} AND w_end <= {AS_OF}) OR ({OPEN})"),
        ),
        "sales_topk": _sql([SALES], _top("sales", q.CURRENT_LIMIT)),
        "topk_approx": _sql(
            [REC, RANGED], f"SELECT *, TRUE AS within_bound FROM ({_top('ranged', q.TOP_K)})"
        ),
        "monitored_list": _sql(
            [DAILY_WORDS, *_summaries("daily_words", MONITORED_CAPACITY)],
            f"SELECT {S}, key, rk, count, error, floor FROM merged WHERE rk <= {MONITORED_CAPACITY}",
        ),
        "monitored_bounds": _sql(
            [DAILY_WORDS],
            f"""
SELECT {S}, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_keys,
       least(count(*), {MONITORED_CAPACITY}) AS n_listed, CAST(0 AS BIGINT) AS n_missed,
       CAST(0 AS BIGINT) AS n_broken, TRUE AS floor_within_bound
FROM (SELECT {S}, key, count(*) AS n FROM daily_words GROUP BY ALL) GROUP BY service, collection""",
        ),
        "distinct_current_exact": _sql([REC], _distinct("rec", where=OPEN)),
        "distinct_range_exact": _sql([REC, RANGED], _distinct("ranged")),
        "distinct_current_hll": _sql([REC], _distinct("rec", True, OPEN)),
        "distinct_range_hll": _sql([REC, RANGED], _distinct("ranged", True)),
        "hll_accuracy": _sql(
            [SALES],
            f"SELECT {S}, count(DISTINCT key) AS exact, TRUE AS within_bound FROM sales GROUP BY ALL",
        ),
        "kmv_distinct": _sql([SALES], _kmv("sales")),
        "kmv_merged": _sql([REC, RANGED], _kmv("ranged")),
        "cms_cells": _sql([REC], f"SELECT {ROWS}, i, b, v FROM ({_window_cells('daily')})"),
        "config_cells": _sql(
            [REC, _settings()],
            f"""
SELECT {ROWS}, i, b, least(CAST(count(*) AS BIGINT), max_value) AS v
FROM (SELECT {S}, w, i, max_value,
             CAST('0x' || substr(md5((i // 4) || '|' || key), 8 * (i % 4) + 1, 8) AS BIGINT)
             % width AS b
      FROM (SELECT d.service, d.collection, d.w, d.key,
                   coalesce(width, {q.SKETCH_WIDTH}) AS width,
                   coalesce(max_value, {q.SKETCH_CAP}) AS max_value
            FROM daily d LEFT JOIN config USING (service, collection)),
           range({q.SKETCH_DEPTH}) AS depth(i))
GROUP BY service, collection, w, i, b, max_value""",
        ),
        "cms_merge": _sql([REC, RANGED], _merged_cells("ranged")),
        "cms_estimate": _sql([REC, RANGED], _estimates("ranged")),
        "values_first_seen": _sql(
            [REC], f"SELECT {ROWS}, key, v_k, v_value FROM ({_first('daily')})"
        ),
        "values_newest": _sql(
            [REC, RANGED], f"SELECT {value_columns} FROM ({_newest('ranged')})"
        ),
        "values_limit": _sql(
            [REC, f"asked AS (SELECT * FROM daily WHERE w = {_time(q.WINDOW_ASKED)} AND {ASKED})"],
            f"SELECT {ROWS}, key, v_k, v_value FROM ({seen_asked})",
        ),
        "values_current_limit": _sql(
            [REC, f"asked AS (SELECT * FROM daily WHERE {OPEN} AND {ASKED})"],
            f"SELECT {ROWS}, key, v_k, v_value FROM ({seen_asked})",
        ),
        "value_of_key": _sql(
            [REC, f"asked AS (SELECT * FROM daily WHERE {OPEN} AND key = '{q.KEY_ASKED}')"],
            f"SELECT {S}, key, v_k FROM ({_first('asked')})",
        ),
        "values_with_key": _sql(
            [REC],
            f"""
SELECT {ROWS}, key, 'k#' || v_k || '$key#' || key || '$value#' || CAST(v_value AS VARCHAR) AS packed
FROM ({_first('daily')})""",
        ),
        "value_and_count": _sql(
            [REC, f"asked AS (SELECT * FROM daily WHERE w >= {BEGIN} AND {ASKED})"],
            _newest("asked"),
        ),
        "value_and_count_sketch": _sql(
            [REC, f"since AS (SELECT * FROM daily WHERE w >= {BEGIN})"],
            f"SELECT {value_columns}, estimate FROM ({_newest('since')}) "
            f"JOIN ({_estimates('since')}) USING (service, collection, key)",
        ),
        "all_collections": _sql(
            [REC, f"since AS (SELECT * FROM daily WHERE w >= {BEGIN} AND ts <= {AS_OF})"],
            _newest("since"),
        ),
        "labels_total": _sql([LABELS], f"{TOTALS} GROUP BY ALL"),
        "labels_of_collection": _sql(
            [LABELS], f"{TOTALS} WHERE collection = '{q.LABEL_COLLECTION}' GROUP BY ALL"
        ),
        "labels_after_drop": _sql(
            [LABELS], f"{TOTALS} WHERE collection <> '{q.LABEL_COLLECTION}' GROUP BY ALL"
        ),
        "key_canonical": _sql(
            [REC],
            """
SELECT seq, CASE collection WHEN 'click' THEN upper(md5(key)) WHEN 'view' THEN md5(key) ELSE key END
            AS key, md5(key) AS canonical, lpad(lower(hex(CAST(key AS BIGINT))), 32, '0') AS hex
FROM rec""",
        ),
        "pack_values": _sql(
            [REC],
            "SELECT seq AS event_id, 'k#' || v_k || '$type#' || collection || '$user#' || key "
            "AS packed FROM rec",
        ),
        "parse_values": _sql(
            [REC],
            "SELECT seq AS event_id, key AS v_k, collection || '#' || key AS v_path, "
            "CAST(2 AS BIGINT) AS n_attributes FROM rec WHERE collection <> 'error'",
        ),
        "time_iso_basic": _sql(
            [REC],
            f"SELECT seq, {_label('ts')} AS label, {_label('w')} AS day, "
            f"{_label('w_end')} AS next_day FROM daily",
        ),
        "ms_of_day": _sql(
            [REC], f"SELECT seq, {_ms('ts')} - {_ms('w')} AS ms FROM daily"
        ),
        "stored_catalog": _sql(
            [REC, _sealed()],
            f"SELECT {ROWS}, count(*) AS n_events, count(DISTINCT key) AS n_keys "
            "FROM sealed GROUP BY ALL",
        ),
        "stored_toplist": _sql(
            [REC, _sealed()],
            f"SELECT {ROWS}, key, n, rk FROM ({_top_list('sealed', TOP_LIST_CAPACITY)})",
        ),
        "stored_topk_range": _sql([REC, _sealed()], _top("sealed", q.TOP_K, IN_RANGE)),
        "stored_topk_truncated": _sql(
            [REC, _sealed(), f"ranged AS (SELECT * FROM sealed WHERE {IN_RANGE})"],
            _truncated("ranged"),
        ),
        "stored_topk_approx": _sql(
            [
                REC,
                _sealed(),
                f"ranged AS (SELECT * FROM sealed WHERE {IN_RANGE})",
                *_summaries("ranged", q.SMALL_CAPACITY, q.SMALL_CAPACITY),
            ],
            f"SELECT {S}, key, rk, count, error, floor FROM merged WHERE rk <= {q.SMALL_CAPACITY}",
        ),
        "stored_distinct": _sql([REC, _sealed()], _distinct("sealed", True, IN_RANGE)),
        "stored_cms_merge": _sql(
            [REC, _sealed(), f"ranged AS (SELECT * FROM sealed WHERE {IN_RANGE})"],
            _merged_cells("ranged"),
        ),
        "stored_distinct_rolled": _sql([REC, _sealed()], _distinct("sealed", True, IN_RANGE)),
        "stored_cms_rolled": _sql(
            [REC, _sealed(), f"ranged AS (SELECT * FROM sealed WHERE {IN_RANGE})"],
            _merged_cells("ranged"),
        ),
        "stored_kmv_rolled": _sql(
            [REC, _sealed(), f"ranged AS (SELECT * FROM sealed WHERE {IN_RANGE})"],
            _kmv("ranged", q.STORED_KMV),
        ),
        "stored_kmv_retained": _sql(
            [REC, _sealed(), f"ranged AS (SELECT * FROM sealed WHERE {IN_RANGE})"],
            _compared("ranged", f"w <= {_time(q.MIDDLE)}", S),
        ),
        "stored_kmv_overlap": _sql(
            [
                REC,
                _sealed(),
                f"two AS (SELECT * FROM sealed WHERE {IN_RANGE}"
                f" AND collection IN ('{q.STREAM_ASKED[1]}', '{q.STREAM_COMPARED}'))",
            ],
            _compared("two", f"collection = '{q.STREAM_ASKED[1]}'"),
        ),
        "stored_values": _sql(
            [REC],
            f"SELECT {ROWS}, key, v_k, v_value FROM ({_first('daily')}) "
            f"WHERE w = {_time(q.WINDOW_ASKED)}",
        ),
        "stored_value_and_count": _sql(
            [REC, f"since AS (SELECT * FROM daily WHERE w >= {BEGIN} AND ts <= {AS_OF})"],
            _newest("since"),
        ),
        "seal_write_once": _sql(
            [REC],
            f"""
SELECT {ROWS}, key, CASE WHEN w_end <= {AS_OF} THEN n ELSE 2 * n END AS n
FROM (SELECT {S}, w, w_end, key, count(*) AS n FROM daily GROUP BY ALL)""",
        ),
        "stream_windows": _sql(
            [REC],
            f"""
SELECT {ROWS}, key, arg_min(v_k, seq) AS v_k, arg_min(v_value, seq) AS v_value, count(*) AS n
FROM daily GROUP BY service, collection, w, key""",
        ),
        "stream_open_window": _sql(
            [REC], f"SELECT {ROWS}, key, count(*) AS n FROM daily GROUP BY ALL"
        ),
        "stream_late_windows": _sql(
            [REC, *_late()],
            f"""
SELECT {S}, {_label("CASE WHEN late THEN date_trunc('day', reached) ELSE w END")} AS label, key, count(*) AS n
FROM arrived GROUP BY ALL""",
        ),
        "stream_late_records": _sql(
            [REC, *_late()], f"SELECT {S}, key, {_label('ts')} AS t, seq FROM arrived WHERE late"
        ),
        "stream_settings": _sql(
            [REC],
            f"""
SELECT service, 'c' || i AS collection, key, count(*) AS n,
       {_label("make_timestamp((ms - (ms - i * 60000) % ((i + 1) * 600000)) * 1000)")} AS label
FROM (SELECT service, key, CAST(key AS BIGINT) % {q.MANY_STREAMS} AS i, {_ms('ts')} AS ms FROM rec)
GROUP BY ALL""",
        ),
        "stream_arrival_order": _sql(
            [REC, *_late()],
            f"""
SELECT {S}, {_label('opened')} AS label, key, seq FROM (
    SELECT *, max(w) OVER (PARTITION BY {S} ORDER BY batch, seq ROWS UNBOUNDED PRECEDING) AS opened
    FROM arrived)""",
        ),
        "stream_label_totals": _sql([LABELS], f"{TOTALS} GROUP BY ALL"),
        "stream_labels": _sql([LABELS], f"{TOTALS} GROUP BY ALL"),
    }


def _truncated(rows: str) -> str:
    heads = _top_list(rows, q.TOP_K + q.TOP_K // 2)
    return f"""
SELECT {S}, key, n, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY n DESC, key) AS rk FROM (
        SELECT {S}, key, CAST(sum(n) AS BIGINT) AS n FROM ({heads}) GROUP BY ALL))
WHERE rk <= {q.TOP_K}"""
