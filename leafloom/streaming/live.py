"""Streaming forms: event logs as they arrive, sessions with a watermark, and the experiment state carried from event to event."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON events as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def session_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, started, ended, n_events) of sessions that a pause ends; events later than `late` are dropped (a choice of ours)."""
    x = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n_events"))
    return x.select(user, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_events")


#: The state store that states with timers need; the streams below set it on their session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HOUR_MS = 3_600_000
#: Microseconds since the epoch.
_AT = "at_us"


class _Idle(StatefulProcessor):
    """State of one key that goes when nothing has come for it for `idle_ms` of event time, or for `ttl_ms` by the clock."""

    STATE = ""

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("now", self.STATE)

    def wait(self, latest_us: int, watermark_ms: int) -> None:
        """The only timer of the key: idle_ms after its latest event."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(-(-latest_us // 1000) + self.idle_ms, watermark_ms + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.now.clear()
        return iter(())

    def close(self) -> None:
        pass


def _stateful(keyed: DataFrame, processor: _Idle, schema: str, user: str, mode: str = "EventTime") -> DataFrame:
    """keyed (user, ...) through a processor; the first column of schema is the user's."""
    for name, value in STATE_STORE.items():
        keyed.sparkSession.conf.set(name, value)
    kind = keyed.schema["user"].dataType.simpleString()
    return keyed.groupBy("user").transformWithStateInPandas(processor, f"user {kind}, {schema}", "Append", mode).withColumnRenamed("user", user)


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(by), kind="stable").reset_index(drop=True)


def _carried(rows: pd.DataFrame, came: tuple) -> tuple[pd.DataFrame, tuple]:
    """carry_experiment() over one user's rows in order, from the state (phase, condition, label) that came in; and the state they leave."""
    text = rows.astype(object).where(rows.notna(), None)
    is_set = (text["type"] == "experiment").to_numpy()
    ends = is_set & (text["action"] == "end").to_numpy()
    island = ends.cumsum()
    names = is_set & ~ends
    carry = lambda c, first: c.where(names).groupby(island).ffill().where(lambda x: x.notna() | (island > 0), first)
    phase, label = carry(text["phase"], came[0]), carry(text["doc_label"], came[2])
    letter = lambda c: c.map(lambda x: x[:1] if isinstance(x, str) else None)
    condition = carry(text["condition"].where(text["condition"].notna(), letter(phase)), came[1])
    tell = ~is_set
    own = text["phase"].where(text["phase"].notna(), phase)
    implied = letter(text["phase"]).where(text["phase"].notna(), condition.where(condition.notna(), letter(own)))
    named = text["tree_id"].where(text["tree_id"] != "", None)
    out = pd.DataFrame({"seq": rows["seq"], "type": text["type"], "phase_of": own, "condition_of": text["condition"].where(text["condition"].notna(), implied)})
    out["label_of"] = text["doc_label"].where(text["doc_label"].notna(), label.where(label.notna(), named.where(named.notna(), "(unlabelled)")))
    last = lambda c: c.iloc[-1] if isinstance(c.iloc[-1], str) else None
    return out[tell], (last(phase), last(condition), last(label))


class _Carry(_Idle):
    STATE = "phase string, condition string, doc_label string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _in_order(rows, "seq")
        out, state = _carried(batch, tuple(self.now.get()) if self.now.exists() else (None, None, None))
        if any(state):
            self.now.update(state)
            if self.idle_ms is not None:
                self.wait(int(batch[_AT].max()), timerValues.getCurrentWatermarkInMs())
        else:
            self.now.clear()  # nothing to keep of a user without an experiment
        out.insert(0, "user", key[0])
        yield out


def carry_stream(events: DataFrame, user: str = "user_id", ts: str | None = None, late: str = "1 hour", idle_ms: int = 30 * 24 * HOUR_MS, ttl_ms: int | None = None) -> DataFrame:
    """carry_experiment() over a stream: events of a batch in order of seq, the state of each user kept between batches.

    With ts a user's state goes when the watermark is idle_ms past their latest event; with ttl_ms when no event has come for so long by
    the clock. With neither it stays until the experiment ends: users without an experiment have no state.
    """
    cols = ["seq", "type", "action", "phase", "condition", "doc_label", "tree_id"]
    x = events.withWatermark(ts, late) if ts and not ttl_ms else events
    times = [ts, F.unix_micros(F.col(ts).cast("timestamp")).alias(_AT)] if ts else []
    x = x.select(F.col(user).alias("user"), *times, *cols)
    processor, mode = (_Carry(None, ttl_ms), "ProcessingTime") if ttl_ms else (_Carry(idle_ms), "EventTime") if ts else (_Carry(), "None")
    return _stateful(x, processor, "seq long, type string, phase_of string, condition_of string, label_of string", user, mode)


class _LastMark(_Idle):
    """The latest mark of a key; its timer runs from the mark, not from what is asked of it."""

    STATE = "at long, value double"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _in_order(rows, _AT, "side", "mark")
        at, value = tuple(self.now.get()) if self.now.exists() else (None, None)
        mark = batch["side"] == 0
        when = batch[_AT].where(mark).ffill().fillna(math.nan if at is None else at)
        what = batch["mark"].where(mark).groupby(mark.cumsum()).ffill()
        what = what.where(mark.cumsum() > 0, math.nan if value is None else value)
        fresh = batch[_AT] - when <= 1000 * self.idle_ms
        if mark.any() and (at is None or when.iloc[-1] >= at):
            self.now.update((int(when.iloc[-1]), None if pd.isna(what.iloc[-1]) else float(what.iloc[-1])))
            self.wait(int(when.iloc[-1]), timerValues.getCurrentWatermarkInMs())
        out = pd.DataFrame({"user": key[0], "seq": batch["seq"], "value": what.where(fresh, None)})
        yield out[~mark]


def as_of_stream(events: DataFrame, is_mark: Column, value: Column, user: str = "user_id", ts: str = "ts", within_ms: int = 4 * HOUR_MS, late: str = "1 hour") -> DataFrame:
    """(user, seq, value) of the events that are no marks: the value of the user's latest mark before them, no older than within_ms.

    as_of() over a stream whose batches come in the order of time. A mark is forgotten once the watermark is within_ms past it.
    """
    x = events.withWatermark(ts, late).select(F.col(user).alias("user"), ts, "seq", F.unix_micros(F.col(ts).cast("timestamp")).alias(_AT), F.when(is_mark, 0).otherwise(1).alias("side"), F.when(is_mark, value).cast("double").alias("mark"))
    return _stateful(x, _LastMark(within_ms), "seq long, value double", user)


class _Sessions(_Idle):
    STATE = "island long, begun long, closed long, zoomed long, checks long, max_z double"
    COLUMNS = ("island", "begun", "closed", "zoomed", "checks", "max_z")

    def told(self, user, rows: pd.DataFrame) -> pd.DataFrame:
        ms = lambda c: rows[c].astype(float) / 1000 - rows["begun"].astype(float) / 1000
        return pd.DataFrame({"user": user, "island": rows["island"], "session_ms": ms("closed"), "first_zoom_ms": ms("zoomed"), "source_checks": rows["checks"], "max_z": rows["max_z"].astype(float)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _in_order(rows, _AT, "seq")
        open_ = dict(zip(self.COLUMNS, self.now.get())) if self.now.exists() else None
        first = open_["island"] if open_ else 0
        batch["island"] = first + (batch["kind"] == "open").cumsum()
        batch = batch[(batch["island"] > 0) & ((batch["island"] > first) | (open_ is not None and open_["begun"] is not None))]
        if batch.empty:
            return
        pick = lambda kind: batch[_AT].where(batch["kind"] == kind)
        g = pd.DataFrame({"island": batch["island"], "begun": pick("open"), "closed": pick("close"), "zoomed": pick("dial"), "checks": (batch["kind"] == "check").astype(int), "max_z": batch["z"].where(batch["kind"] == "dial")}).groupby("island")
        now = g.agg({"begun": "min", "closed": "min", "zoomed": "min", "checks": "sum", "max_z": "max"}).reset_index()
        if open_ and open_["begun"] is not None:
            held = pd.DataFrame([open_])
            now = pd.concat([held, now]).groupby("island").agg({"begun": "min", "closed": "min", "zoomed": "min", "checks": "sum", "max_z": "max"}).reset_index()
        last = now.iloc[-1]
        whole = lambda x: None if pd.isna(x) else int(x)
        self.now.update((int(last["island"]), whole(last["begun"]), whole(last["closed"]), whole(last["zoomed"]), int(last["checks"]), None if pd.isna(last["max_z"]) else float(last["max_z"])))
        self.wait(int(batch[_AT].max()), timerValues.getCurrentWatermarkInMs())
        yield self.told(key[0], now.iloc[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.DataFrame([tuple(self.now.get())], columns=list(self.COLUMNS))
        self.now.clear()
        yield self.told(key[0], held)


def reading_session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "type", opens: str = "open", closes: str = "close", dials: tuple = ("dial",), checks: tuple = ("jump_source", "hover_source"), z: str = "z_to", idle_ms: int = 24 * HOUR_MS, late: str = "1 hour") -> DataFrame:
    """reading_sessions() over a stream whose batches come in the order of time: a session is told when the next one opens, or when the
    watermark is idle_ms past its user's latest event. Then the user's state goes; what comes later without an opening belongs to no
    session, and their sessions are numbered from 1 again."""
    k = F.col(kind)
    name = F.when(k == opens, "open").when(k == closes, "close").when(k.isin(*dials), "dial").when(k.isin(*checks), "check")
    x = events.withWatermark(ts, late).select(F.col(user).alias("user"), ts, "seq", F.unix_micros(F.col(ts).cast("timestamp")).alias(_AT), name.alias("kind"), F.col(z).cast("double").alias("z"))
    return _stateful(x, _Sessions(idle_ms), "island long, session_ms double, first_zoom_ms double, source_checks long, max_z double", user)


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None):
    """Starts writing a stream to Parquet; with a trigger such as `5 seconds`, else all that is there and no more."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start(path)


def progress_history(spark: SparkSession, path: str, schema: str, after: int = -1) -> DataFrame:
    """Build events that were written before a reader came, in order of seq: what a late subscriber is told first."""
    return spark.read.schema(schema).json(path).where(F.col("seq") > after).orderBy("seq")


def progress_stream(spark: SparkSession, path: str, schema: str, after: int = -1) -> DataFrame:
    """The same events from the first file on and then as they arrive, so that a subscriber misses none, however late."""
    return spark.readStream.schema(schema).option("latestFirst", "false").json(path).where(F.col("seq") > after)


# ---------------------------------------------------------------- each batch once


def write_once(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None):
    """Starts writing a stream so that a batch that is run again changes nothing: see put_batch()."""
    w = stream.writeStream.foreachBatch(lambda batch, n: put_batch(batch, n, path)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def put_batch(batch: DataFrame, number: int, path: str) -> bool:
    """Writes a batch into a folder of its own and then notes its number beside the data; False if it was noted before.

    A batch that failed before its note was written is written anew over what it left, so that a reader of the noted batches (read_batches)
    sees every batch whole and once.
    """
    spark = batch.sparkSession
    note = f"{path}/noted/{number:012d}"
    files, at = _place(spark, note)
    if files.exists(at):
        return False
    batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
    files.create(at, False).close()
    return True


def read_batches(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """All rows of the batches noted so far with numbers over `after`, with their `batch`: what a reader who comes late is told."""
    files, at = _place(spark, f"{path}/noted")
    noted = sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []
    held = [f"{path}/data/batch={n}" for n in noted if n > after]
    if not held:
        raise ValueError(f"no batch after {after} in {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*held)


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
