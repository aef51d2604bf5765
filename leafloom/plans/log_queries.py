"""Queries over the events table read as a reading log, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom.operators import events as E
from leafloom.operators import medians, reader

#: What the tables' event types stand for in a reader's log.
KINDS = {"signup": "open", "purchase": "close", "click": "dial", "view": "jump_source", "error": "hover_source"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " ELSE 'dwell' END"


def _kind():
    out = F.lit("dwell")
    for a, b in KINDS.items():
        out = F.when(F.col("event_type") == a, b).otherwise(out)
    return out


def reading_session_figures(events):
    """Sessions that an opening begins: their length, first zoom, source checks and farthest zoom."""
    x = events.select("user_id", "ts", F.col("event_id").alias("seq"), _kind().alias("type"), (F.col("event_id") % 100 / 100).alias("z_to"))
    return E.reading_sessions(x)


def zoom_history_bursts(events):
    """Snapshots of the dial, those within ten minutes as one, and which are large moves."""
    x = events.select("user_id", "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("k"), (F.col("event_id") % 3).alias("section"))
    return E.zoom_history(x, "user_id", "ts", 600.0)


def event_types_known(events):
    """How often each type of event comes, and whether readers send it."""
    return E.known_types(events.select(_kind().alias("type")))


def event_batches(events):
    """Each user's events of a day as they are posted, some of them spoilt: why batches are refused."""
    one = F.struct("event_id", F.concat(F.lit('{"type": "'), _kind(), F.lit('"}')).alias("json"))
    day = F.to_date("ts").alias("day")
    b = events.groupBy("user_id", day).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["json"]), ",").alias("b"))
    u = F.col("user_id") % 4
    batch = F.when(u == 0, F.concat(F.lit("["), "b", F.lit("]"))).when(u == 1, F.concat(F.lit("[1,"), "b", F.lit("]"))).when(u == 2, F.concat(F.lit('{"all": ['), "b", F.lit("]}"))).otherwise(F.concat(F.lit("["), "b"))
    return b.select("user_id", "day", E.batch_problem(batch, 4_000).alias("problem"))


def event_medians(events):
    """Exact medians of values by event type and by hour, in groups of any size."""
    x = events.select("event_type", F.hour("ts").alias("hour"), "value")
    kinds = medians.exact_medians(x, ["event_type"], "value").select("event_type", F.lit(None).cast("int").alias("hour"), "n", "median")
    return kinds.unionByName(medians.exact_medians(x, ["hour"], "value").select(F.lit(None).cast("string").alias("event_type"), "hour", "n", "median"))


def event_fields_clean(events):
    """All experiment fields of events that hold numbers, truth values and text of any kind, cleaned."""
    v, k = F.col("value"), F.col("event_id")
    put = {n: F.round(v * 10) for n in E.NUMBERS} | {n: k % 9 for n in E.WHOLE} | {n: k % 2 == 0 for n in E.FLAGS}
    even = F.struct(*[c.alias(n) for n, c in put.items()], F.lit("A").alias("condition"), F.lit("B2").alias("phase"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("doc_label"))
    odd = F.struct(*[F.when(F.lit(n) == "max_z", F.lit("true")).otherwise(k.cast("string")).alias(n) for n in put], F.lit("C").alias("condition"), F.lit("B3").alias("phase"), F.lit("  ").alias("doc_label"))
    x = events.select(k.alias("seq"), F.when(k % 5 > 0, F.to_json(even)).otherwise(F.to_json(odd)).alias("value"))
    return E.clean_events(E.parse_lines(x)).select(F.col("seq").alias("event_id"), *E.NUMBERS, *E.WHOLE, *E.FLAGS, "condition", "phase", "doc_label")


def reader_state_checks(events):
    """Highlights and positions that are well formed, by event type."""
    k, v = F.col("event_id"), F.col("value")
    h = events.select("event_type", F.when(k % 6 == 0, "bad id").otherwise(k.cast("string")).alias("id"), F.lit("n").alias("node_id"), F.round(v).cast("double").alias("start"), (F.round(v) + k % 4 - 1).cast("double").alias("end"), F.when(k % 5 == 0, "red").otherwise("#a1B2c3").alias("colour"))
    p = events.select("event_type", F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(v).alias("z"), F.lit("n").alias("anchor_node_id"), F.when(k % 4 == 0, None).when(k % 4 == 1, F.lit(float("inf"))).otherwise(v).alias("anchor_offset"))
    n = lambda df, name: df.groupBy("event_type").agg(F.count("*").alias(name))
    return n(reader.valid_highlights(h), "highlights").join(n(reader.valid_positions(p), "positions"), "event_type", "full")


def _clean_sql() -> str:
    good = [f"CASE WHEN event_id % 5 > 0 AND round(value * 10) BETWEEN {a} AND {b} THEN round(value * 10) END AS {n}" for n, (a, b) in E.NUMBERS.items()]
    good += [f"CASE WHEN event_id % 5 > 0 AND event_id % 9 BETWEEN {a} AND {b} THEN event_id % 9 END AS {n}" for n, (a, b) in E.WHOLE.items()]
    good += [f"CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS {n}" for n in E.FLAGS]
    return f"SELECT event_id, {', '.join(good)}, CASE WHEN event_id % 5 > 0 THEN 'A' END AS condition, CASE WHEN event_id % 5 > 0 THEN 'B2' END AS phase, CASE WHEN event_id % 5 > 0 THEN event_type END AS doc_label FROM events"


LOG_SQL = {
    "reading_session_figures": f"""WITH x AS (SELECT *, {_KIND} AS type, epoch_us(ts) / 1000 AS ms, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, CAST(island AS BIGINT) AS island, min(ms) FILTER (type = 'close') - min(ms) FILTER (type = 'open') AS session_ms, min(ms) FILTER (type = 'dial') - min(ms) FILTER (type = 'open') AS first_zoom_ms,
  count(*) FILTER (type IN ('jump_source', 'hover_source')) AS source_checks, max((event_id % 100) / 100.0) FILTER (type = 'dial') AS max_z FROM x WHERE island > 0 GROUP BY user_id, island""",
    "zoom_history_bursts": """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 600000000 THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g),
l AS (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, ts, event_id % 7 AS k, event_id % 3 AS section FROM s QUALIFY row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts DESC, event_id DESC) = 1)
SELECT *, abs(k - lag(k) OVER w) >= 3 OR section IS DISTINCT FROM lag(section) OVER w AS big FROM l WINDOW w AS (PARTITION BY user_id ORDER BY session_no)""",
    "event_types_known": f"SELECT {_KIND} AS type, count(*) AS events, true AS known FROM events GROUP BY ALL",
    "event_batches": f"""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg('{{"type": "' || {_KIND} || '"}}', ',' ORDER BY event_id) AS b FROM events GROUP BY ALL),
t AS (SELECT *, CASE user_id % 4 WHEN 0 THEN '[' || b || ']' WHEN 1 THEN '[1,' || b || ']' WHEN 2 THEN '{{"all": [' || b || ']}}' ELSE '[' || b END AS batch FROM b),
j AS (SELECT *, TRY_CAST(batch AS JSON) AS v FROM t)
SELECT user_id, day, CASE WHEN strlen(batch) > 4000 THEN 'too large' WHEN v IS NULL OR json_type(v) <> 'ARRAY' THEN 'no array' WHEN len([x FOR x IN json_extract(v, '$[*]') IF json_type(x) <> 'OBJECT']) > 0 THEN 'no array of objects' END AS problem FROM j""",
    "event_medians": "SELECT event_type, NULL::INTEGER AS hour, count(value) AS n, median(value) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type UNION ALL SELECT NULL, CAST(hour(ts) AS INTEGER), count(value), median(value) FROM events WHERE value IS NOT NULL GROUP BY 2",
    "event_fields_clean": _clean_sql(),
    "reader_state_checks": """SELECT event_type, count(*) FILTER (event_id % 6 > 0 AND event_id % 4 > 1 AND event_id % 5 > 0) AS highlights, count(*) FILTER (event_id % 3 > 0 AND event_id % 4 <> 1 AND value IS NOT NULL) AS positions FROM events GROUP BY event_type""",
}
OVER_EVENTS = (reading_session_figures, zoom_history_bursts, event_types_known, event_batches, event_medians, event_fields_clean, reader_state_checks)
