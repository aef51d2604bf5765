"""Reading events: cleaning, carried experiment state, sessions, and the report of an A-B-A-B experiment. Relational throughout; file order is the column `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import HOT_ROWS, PIECES, before, beside, in_blocks

PHASES = ("A1", "B1", "A2", "B2")
TLX = tuple(f"tlx_{x}" for x in ("mental", "physical", "temporal", "performance", "effort", "frustration"))
# Range of each number; whole numbers; truth values.
NUMBERS = {"first_zoom_ms": (0, 86_400_000), "max_z": (0, 1), "session_ms": (0, 86_400_000), "minutes_to_know": (0, 1440), "minutes_to_first_action": (0, 20_160), **dict.fromkeys(TLX, (0, 100))}
WHOLE = {"source_checks": (0, 100_000), "checklist_score": (0, 5)}
FLAGS = ("did_it_help", "missed_later", "started_within_24h")
OUTCOME_NUMBERS = ("minutes_to_know", "checklist_score", "minutes_to_first_action")
OUTCOME_FLAGS = ("missed_later", "started_within_24h")
TEXTS = ("type", "action", "tree_id", "node_id")

# Metric, which way is better, and the centre of a phase.
PATTERN = (("minutes_to_know", "lower", "median"), ("checklist_score", "higher", "mean"), ("tlx_raw", "lower", "mean"), ("minutes_to_first_action", "lower", "median"))
REPORT_COLUMNS = ("phase", "condition", "doc_label", *OUTCOME_NUMBERS, "tlx_raw", *OUTCOME_FLAGS, "sessions", "session_ms", "first_zoom_ms", "max_z", "source_checks", "did_it_help")


def parse_lines(lines: DataFrame, line: str = "value", seq: str = "seq") -> DataFrame:
    """(seq, v variant): JSON objects in order; damaged lines and other JSON are skipped."""
    v = F.try_parse_json(line)
    return lines.select(F.col(seq).alias("seq"), v.alias("v")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def clean_events(parsed: DataFrame) -> DataFrame:
    """Typed experiment fields: a value of the wrong type (true is no number) or out of range is null, the event stays."""
    v = F.col("v")
    kind = lambda n: F.schema_of_variant(F.variant_get(v, f"$.{n}", "variant"))
    text = lambda n: F.when(kind(n) == "STRING", F.variant_get(v, f"$.{n}", "string"))

    def number(n, lo, hi, whole):
        x = F.when((kind(n) == "BIGINT") if whole else (kind(n).isin("BIGINT", "DOUBLE", "FLOAT") | kind(n).startswith("DECIMAL")), F.try_variant_get(v, f"$.{n}", "double"))
        return F.when(x.between(lo, hi), x)

    label = F.substring(F.trim(text("doc_label")), 1, 80)
    cols = [text(n).alias(n) for n in TEXTS]
    cols += [F.when(text("condition").isin("A", "B"), text("condition")).alias("condition"), F.when(text("phase").isin(*PHASES), text("phase")).alias("phase"), F.when(label != "", label).alias("doc_label")]
    cols += [number(n, *r, False).alias(n) for n, r in NUMBERS.items()] + [number(n, *r, True).cast("long").alias(n) for n, r in WHOLE.items()]
    cols += [F.when(kind(n) == "BOOLEAN", F.variant_get(v, f"$.{n}", "boolean")).alias(n) for n in (*FLAGS, "value")]
    return parsed.select("seq", text("ts").alias("ts"), *cols)


def batch_problem(batch: Column, most_bytes: int = 1 << 20) -> Column:
    """Why a posted batch of events (JSON text) is refused, else null: too large, or no array of objects."""
    v = F.try_parse_json(batch)
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    objects = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    return F.when(F.octet_length(batch) > most_bytes, "too large").when(v.isNull() | ~kind.startswith("ARRAY"), "no array").when(~objects, "no array of objects")


# The types of events that readers send.
EVENT_TYPES = (
    "open", "close", "dial", "dwell", "idle", "jump_source", "hover_source", "highlight", "palette", "reading", "history", "search", "map", "not_helpful",
    "checkin", "checkin_adjust_undo", "resume_build", "rebuild", "experiment", "did_it_help", "outcome",
)


def known_types(events: DataFrame, kind: str = "type") -> DataFrame:
    """(type, events, known) over a log: how often each type comes, and whether it is one that readers send."""
    return events.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("events")).withColumn("known", F.coalesce(F.col("type").isin(*EVENT_TYPES), F.lit(False)))


_STATE = "struct<phase:string,label:string,condition:string>"


def _states_before(folded: Column) -> Column:
    """Of a log's blocks in order (struct `block`, ended, phase, label, alone, after): the state that each starts with, as an array of (block, state).

    A block changes a state so: where it ends the experiment, nothing is kept of what came in. Else what it names replaces what came in. The
    condition it leaves depends on whether a phase came in: `alone` without one, `after` with one, `@` being that phase's letter.
    """
    none = F.lit(None).cast(_STATE)
    start = F.struct(none.alias("now"), F.array().cast(f"array<struct<block:int,state:{_STATE}>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        came = F.when(~b["ended"], acc["now"])
        said = F.when(came["phase"].isNull(), F.coalesce(b["alone"], came["condition"])).when(b["after"] == "@", F.substring(came["phase"], 1, 1)).otherwise(F.coalesce(b["after"], came["condition"]))
        now = F.struct(F.coalesce(b["phase"], came["phase"]).alias("phase"), F.coalesce(b["label"], came["label"]).alias("label"), said.alias("condition"))
        return F.struct(now.cast(_STATE).alias("now"), F.array_append(acc["out"], F.struct(b["block"].alias("block"), acc["now"].alias("state"))).alias("out"))

    return F.aggregate(F.array_sort(folded), start, step, lambda acc: acc["out"])


def carry_experiment(events: DataFrame, by: list[str], pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds phase_of, condition_of, label_of to each event that is no `experiment` one: its own values, else those carried.

    An `experiment` event sets what it names until another does, or until one with action `end` resets all. A phase without a
    condition implies the condition of its first letter. by: columns that keep logs apart, one at least; each log is an ordered
    stream of its own. A log of very many events is scanned in blocks (see scan.py): each block's change of state is folded first.
    """
    if not by:
        raise ValueError("name the columns that keep logs apart")
    cut = in_blocks(events, by, F.col("seq").cast("long"), pieces, hot_rows)
    is_set = F.col("type") == "experiment"
    x = cut.rows.withColumn("_end", (is_set & (F.coalesce("action", F.lit("")) == "end")).cast("int"))
    x = x.withColumn("_island", F.sum("_end").over(cut.windows("seq").rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_block", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sets = is_set & (F.col("_end") == 0)
    named = lambda c: F.when(sets, F.col(c))
    for c in ("phase", "doc_label"):
        x = x.withColumn(f"_{c}", F.last(named(c), ignorenulls=True).over(run))
    letter = F.substring("_phase", 1, 1)
    x = x.withColumn("_alone", F.last(F.coalesce(named("condition"), F.when(sets, letter)), ignorenulls=True).over(run))
    if cut.hot:
        x = x.withColumn("_after", F.last(F.coalesce(named("condition"), F.when(sets, F.coalesce(letter, F.lit("@")))), ignorenulls=True).over(run))
        last = F.struct((F.col("_island") > 0).alias("ended"), F.col("_phase").alias("phase"), F.col("_doc_label").alias("label"), F.col("_alone").alias("alone"), F.col("_after").alias("after"))
        folded = x.where("_cut").groupBy(*by, "_block").agg(F.max_by(last, "seq").alias("b"))
        blocks = folded.groupBy(*by).agg(F.collect_list(F.struct(F.col("_block").alias("block"), "b.*")).alias("l"))  # a row for each block: PIECES at most
        states = blocks.select(*by, F.inline(_states_before(F.col("l")))).withColumnsRenamed({"block": "_block", "state": "_came"})
        x = beside(x, states, [*by, "_block"])
    else:
        x = x.withColumns({"_after": F.lit(None).cast("string"), "_came": F.lit(None).cast(_STATE)})
    came = F.when(F.col("_island") == 0, F.col("_came"))
    x = x.where(~F.coalesce(is_set, F.lit(False))).withColumn("_came", came)
    carried = F.when(F.col("_came.phase").isNull(), F.coalesce("_alone", "_came.condition")).when(F.col("_after") == "@", F.substring("_came.phase", 1, 1)).otherwise(F.coalesce("_after", "_came.condition"))
    x = x.withColumns({"_phase": F.coalesce("_phase", "_came.phase"), "_doc_label": F.coalesce("_doc_label", "_came.label"), "_condition": carried})
    phase = F.coalesce("phase", "_phase")
    implied = F.when(F.col("phase").isNotNull(), F.substring("phase", 1, 1)).otherwise(F.coalesce("_condition", F.substring(phase, 1, 1)))
    out = x.withColumns({"phase_of": phase, "condition_of": F.coalesce("condition", implied), "label_of": F.coalesce("doc_label", "_doc_label", F.when(F.col("tree_id") != "", F.col("tree_id")), F.lit("(unlabelled)"))})
    return out.drop("_end", "_island", "_phase", "_doc_label", "_alone", "_after", "_came", "_condition", "_cut", "_block")


def documents_report(carried: DataFrame, by: list[str] = ()) -> DataFrame:
    """A row for each phase and document: last outcome values, sessions and their sums; the condition of its first event."""
    outcome, close = F.col("type") == "outcome", F.col("type") == "close"
    last = lambda c, on: F.max_by(c, F.when(on & F.col(c).isNotNull(), F.col("seq"))).alias(c)
    helped = F.when(close, F.col("did_it_help")).when(F.col("type") == "did_it_help", F.col("value"))
    aggs = [F.min_by("condition_of", "seq").alias("condition"), *[last(c, outcome) for c in (*OUTCOME_NUMBERS, *TLX, *OUTCOME_FLAGS)]]
    aggs += [F.sum(close.cast("int")).alias("sessions"), F.sum(F.when(close, F.col("session_ms"))).alias("session_ms"), F.min_by("first_zoom_ms", F.when(close & F.col("first_zoom_ms").isNotNull(), F.col("seq"))).alias("first_zoom_ms")]
    aggs += [F.max(F.when(close, F.col("max_z"))).alias("max_z"), F.sum(F.when(close, F.col("source_checks").cast("double"))).alias("source_checks"), F.max_by("_helped", F.when(F.col("_helped").isNotNull(), F.col("seq"))).alias("did_it_help")]
    docs = carried.where("phase_of is not null").withColumn("_helped", helped).groupBy(*by, F.col("phase_of").alias("phase"), F.col("label_of").alias("doc_label")).agg(*aggs)
    raw = sum((F.col(c) for c in TLX[1:]), F.col(TLX[0])) / len(TLX)
    return docs.select(*by, *[raw.alias(c) if c == "tlx_raw" else F.col(c) for c in REPORT_COLUMNS])


def stats(c: str) -> list[Column]:
    """n, mean, median, min, max of a column."""
    return [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]


def yes_no(c: str) -> list[Column]:
    return [F.count_if(F.col(c)).alias(f"{c}_yes"), F.count_if(~F.col(c)).alias(f"{c}_no")]


def phases_report(docs: DataFrame, carried: DataFrame, by: list[str] = ()) -> DataFrame:
    """A row for each phase: outcomes over documents, session figures over sessions."""
    a = docs.groupBy(*by, "phase").agg(F.min("condition").alias("condition"), F.count("*").alias("documents"), F.sum("sessions").alias("sessions"), *[x for c in (*OUTCOME_NUMBERS, "tlx_raw") for x in stats(c)], *[x for c in OUTCOME_FLAGS for x in yes_no(c)])
    per = carried.where("phase_of is not null and type = 'close'").groupBy(*by, F.col("phase_of").alias("phase")).agg(*[x for c in ("session_ms", "first_zoom_ms", "max_z", "source_checks") for x in stats(c)])
    helped = carried.where("phase_of is not null").select(*by, F.col("phase_of").alias("phase"), F.when(F.col("type") == "close", F.col("did_it_help")).when(F.col("type") == "did_it_help", F.col("value")).alias("did_it_help"))
    return a.join(per, [*by, "phase"], "left").join(helped.groupBy(*by, "phase").agg(*yes_no("did_it_help")), [*by, "phase"], "left")


def by_condition(docs: DataFrame, by: list[str] = ()) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    return docs.groupBy(*by, "condition").agg(F.count("*").alias("documents"), F.sum("sessions").alias("sessions"), F.transform(F.array_sort(F.collect_set(F.struct(order.alias("k"), F.col("phase").alias("p")))), lambda x: x["p"]).alias("phases"))


def pattern_report(phases: DataFrame, by: list[str] = ()) -> DataFrame:
    """A row for each metric with two phases or more: centres in phase order, changes, and whether B beat A both times."""
    order = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(b).alias("better"), F.col(f"{m}_{c}").cast("double").alias("centre"), F.col(f"{m}_n").alias("n")) for m, b, c in PATTERN]
    x = phases.select(*by, "phase", order.alias("k"), F.explode(F.array(*rows)).alias("r")).where("r.n > 0").select(*by, "phase", "k", "r.*")
    before = F.lag("centre").over(Window.partitionBy(*by, "metric").orderBy("k"))
    better = F.when(F.col("better") == "lower", F.col("centre") < F.col("_b")).otherwise(F.col("centre") > F.col("_b"))
    x = x.withColumn("_b", before).withColumn("change", F.when(F.col("_b").isNull(), None).when(F.col("centre") == F.col("_b"), "same").when(better, "better").otherwise("worse"))
    at = {p: F.max(F.when(F.col("phase") == p, F.col("centre"))) for p in PHASES}
    beat = lambda b, a: F.when(F.col("better") == "lower", at[b] < at[a]).otherwise(at[b] > at[a])
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("k", c)))), lambda s: s[c])
    out = x.groupBy(*by, "metric", "better").agg(F.count("*").alias("phases"), in_order("centre").alias("series"), in_order("change").alias("changes"), (beat("B1", "A1") & beat("B2", "A2")).alias("b_beat_a_twice"), F.count_if(F.col("phase").isin(*PHASES)).alias("_n"))
    return out.where("phases >= 2").withColumn("b_beat_a_twice", F.when(F.col("_n") == 4, F.col("b_beat_a_twice"))).drop("_n")


def unassigned(carried: DataFrame) -> DataFrame:
    return carried.agg(F.count_if(F.col("phase_of").isNull()).alias("unassigned_events"))


# ---------------------------------------------------------------- sessions


def _micros(c: Column) -> Column:
    """Microseconds since the epoch, of a time with or without a zone (which then is the session's)."""
    return F.unix_micros(c.cast("timestamp"))


def sessions(events: DataFrame, user: str, ts: str, gap_s: float, pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events with session_no (from 1 for each user): a new one after a pause of more than gap_s seconds. Ties go by event order given in `seq`.

    A user of very many events is scanned in blocks of time.
    """
    most = gap_s * 1_000_000
    cut = in_blocks(events, [user], _micros(F.col(ts)), pieces, hot_rows)
    w = cut.windows(ts, "seq")
    x = cut.rows.withColumn("_t", _micros(F.col(ts))).withColumn("_first", F.row_number().over(w) == 1)
    pause = F.col("_t") - F.lag("_t").over(w)
    x = x.withColumn("_new", F.when(F.col("_first"), 0).when(pause.isNull() | (pause > most), 1).otherwise(0))

    def scan(few, over):
        near = F.coalesce(F.col("_from") - F.lag("_to").over(over) <= most, F.lit(False))
        begun = few.withColumn("_opens", (~near).cast("int"))  # whether the block's first row begins a session
        return begun.withColumn("_base", F.sum("_opens").over(over) + F.coalesce(F.sum("_inner").over(before(over)), F.lit(0)))

    x = cut.carried(x, [F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.sum("_new").alias("_inner")], scan, "_base")
    number = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_base", F.lit(1))
    return x.withColumn("session_no", number.cast("long")).drop("_t", "_first", "_new", "_base", "_cut", "_block")


def reading_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "type", opens: str = "open", closes: str = "close", dials: tuple = ("dial",), checks: tuple = ("jump_source", "hover_source"), z: str = "z_to", pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A row for each island that an opening event begins: session_ms to the first close, first_zoom_ms, source_checks, max_z."""
    cut = in_blocks(events, [user], _micros(F.col(ts)), pieces, hot_rows)
    x = cut.rows.withColumn("_open", (F.col(kind) == opens).cast("int"))
    x = cut.carried(x, [F.sum("_open").alias("_n")], lambda few, over: few.withColumn("_base", F.sum("_n").over(before(over))), "_base")
    own = F.sum("_open").over(cut.windows(ts, "seq").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("island", F.coalesce(own, F.lit(0)) + F.coalesce("_base", F.lit(0))).where("island > 0")
    ms = lambda c: _micros(c) / 1000
    begun = F.min(F.when(F.col(kind) == opens, ms(F.col(ts))))
    return x.groupBy(user, "island").agg(
        (F.min(F.when(F.col(kind) == closes, ms(F.col(ts)))) - begun).alias("session_ms"), (F.min(F.when(F.col(kind).isin(*dials), ms(F.col(ts)))) - begun).alias("first_zoom_ms"),
        F.count_if(F.col(kind).isin(*checks)).alias("source_checks"), F.max(F.when(F.col(kind).isin(*dials), F.col(z))).alias("max_z"),
    )


def as_of(events: DataFrame, marks: DataFrame, key: str, ts: str, value: str, within_s: float, pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events with the value of the latest mark of the key at or before them, no older than within_s seconds; null without one. Of marks at one time the largest value counts.

    A key of very many events and marks is scanned in blocks of time.
    """
    m = marks.select(key, ts, F.lit(0).alias("_side"), F.struct(ts, value).alias("_m"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c not in (key, ts)])
    e = events.withColumns({"_side": F.lit(1), "_m": F.lit(None).cast(m.schema["_m"].dataType)})
    cut = in_blocks(e.unionByName(m), [key], _micros(F.col(ts)), pieces, hot_rows)
    x = cut.carried(cut.rows, [F.max("_m").alias("_best")], lambda few, over: few.withColumn("_earlier", F.max("_best").over(before(over))), "_earlier")
    own = F.max("_m").over(cut.windows(ts, "_side").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_last", F.coalesce(own, F.col("_earlier").cast(m.schema["_m"].dataType))).where("_side = 1")
    fresh = _micros(F.col(ts)) - _micros(F.col(f"_last.{ts}")) <= within_s * 1_000_000
    return x.withColumn(value, F.when(fresh, F.col(f"_last.{value}"))).drop("_side", "_m", "_last", "_earlier", "_cut", "_block")


def zoom_history(events: DataFrame, user: str, ts: str, merge_s: float = 1.0, jump: int = 3, pieces: int = PIECES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The last snapshot of each burst (pauses under merge_s), with big: a move of `jump` steps or more, or into another section, since the burst before."""
    x = sessions(events, user, ts, merge_s, pieces, hot_rows)
    last = x.groupBy(user, "session_no").agg(F.max_by(F.struct(ts, "k", "section"), F.struct(ts, "seq")).alias("s")).select(user, "session_no", "s.*")
    cut = in_blocks(last, [user], F.col("session_no"), pieces, hot_rows)
    y = cut.carried(cut.rows, [F.max_by(F.struct("k", "section"), "session_no").alias("_end")], lambda few, over: few.withColumn("_prior", F.lag("_end").over(over)), "_prior")
    pair = F.struct("k", "section")
    y = y.withColumn("_was", F.coalesce(F.lag(pair).over(cut.windows("session_no")), F.col("_prior").cast(last.select(pair).schema[0].dataType)))
    big = F.coalesce((F.abs(F.col("k") - F.col("_was.k")) >= jump) | ~F.col("section").eqNullSafe(F.col("_was.section")), F.lit(False))
    return y.withColumn("big", big).drop("_was", "_prior", "_cut", "_block")
