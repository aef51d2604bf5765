import pytest
import json

from pyspark.sql import functions as F

from leafloom.operators import events as E
from leafloom.operators import ledger as L
from leafloom.plans import catalog
from leafloom.sources import files, sinks
from leafloom.streaming import live


def log(spark, records):
    lines = [(k, x if isinstance(x, str) else json.dumps(x)) for k, x in enumerate(records)]
    return E.clean_events(E.parse_lines(spark.createDataFrame(lines, "seq long, value string")))


def test_cleaning(spark):
    tlx = dict.fromkeys(E.TLX, 10)
    rows = log(spark, ["not json", "[1]", {"type": "outcome", "checklist_score": True, "max_z": 1.5, "doc_label": "  x" + "y" * 90, **tlx}, {"type": "close", "checklist_score": 4, "session_ms": 12.5}]).collect()
    assert len(rows) == 2 and rows[0].checklist_score is None and rows[0].max_z is None and len(rows[0].doc_label) == 80 and rows[0].tlx_effort == 10
    assert rows[1].checklist_score == 4 and rows[1].session_ms == 12.5


def abab():
    out = []
    for phase, minutes in (("A1", (10, 20)), ("B1", (5, 9)), ("A2", (12, 16)), ("B2", (4, 8))):
        out.append({"type": "experiment", "phase": phase})
        for k, m in enumerate(minutes):
            out += [{"type": "outcome", "doc_label": f"d{k}", "minutes_to_know": m}, {"type": "close", "doc_label": f"d{k}", "session_ms": 100.0 * k}]
    return out


def test_report(spark):
    one = log(spark, [{"type": "dial"}, *abab(), {"type": "experiment", "action": "end"}, {"type": "dial"}]).withColumn("user_id", F.lit(1))
    with pytest.raises(ValueError):
        E.carry_experiment(one, [])
    c = E.carry_experiment(one, ["user_id"]).cache()
    docs = E.documents_report(c)
    phases = E.phases_report(docs, c)
    assert {r.phase: (r.minutes_to_know_median, r.documents, r.session_ms_n) for r in phases.collect()} == {"A1": (15, 2, 2), "B1": (7, 2, 2), "A2": (14, 2, 2), "B2": (6, 2, 2)}
    (p,) = E.pattern_report(phases).collect()
    assert p.series == [15, 7, 14, 6] and p.changes == ["better", "worse", "better"] and p.b_beat_a_twice
    assert E.unassigned(c).first()[0] == 2
    assert {r.condition: r.phases for r in E.by_condition(docs).collect()} == {"A": ["A1", "A2"], "B": ["B1", "B2"]}


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"user_id": u, "seq": k, **x} for u in (1, 2) for k, x in enumerate(abab()[u:])]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "user_id long, seq long, type string, action string, phase string, condition string, doc_label string, tree_id string"
    live.append_to(live.carry_stream(live.event_stream(spark, str(src), schema)), str(out), str(tmp_path / "cp")).awaitTermination()
    batch = E.carry_experiment(spark.read.schema(schema).json(str(src)), ["user_id"]).select("user_id", "seq", "type", "phase_of", "condition_of", "label_of")
    got = sorted(spark.read.parquet(str(out)).collect(), key=lambda r: (r.user_id, r.seq))
    assert got == sorted(batch.collect(), key=lambda r: (r.user_id, r.seq)) and got


def test_as_of_and_sessions(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:20:00"), (3, 1, "2024-01-01 15:00:00")], "seq long, u long, ts string").withColumn("ts", F.to_timestamp("ts"))
    marks = spark.createDataFrame([(1, "2024-01-01 10:00:00", 7)], "u long, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    assert {r.seq: r.v for r in E.as_of(e, marks, "u", "ts", "v", 4 * 3600).collect()} == {1: 7, 2: 7, 3: None}
    assert {r.seq: r.session_no for r in E.sessions(e, "u", "ts", 1800).collect()} == {1: 1, 2: 1, 3: 2}


def test_ledger(spark):
    a, f, o = catalog._ledger(spark)
    held = L.holds(a, o)
    s = {(r.finding, r.objective): r.status for r in L.finding_status(f, o, held).collect()}
    assert s[("F2", "plan")] == "?" and s[("F3", "plan")] == "N" and s[("F4", "plan")] == "Y" and s[("F3", "learn")] == "Y"
    what_if = spark.createDataFrame([("A2", "plan", "Y")], "assumption string, objective string, status string")
    assert {(r.finding, r.objective): r.status for r in L.finding_status(f, o, L.holds(a, o, what_if)).collect()}[("F2", "plan")] == "Y"
    queue = L.research_queue(L.finding_status(f, o, held)).where("objective = 'plan'").collect()
    assert [(r.assumption, r.findings) for r in queue] == [("A2", 1)]
    assert L.open_cells(a, f).count() == 1
    assert L.matrix(held, ["plan", "learn"]).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Title\n\nhello")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path.rsplit("/", 1)[-1]: (r.title, r.text, r.problem) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("Title", "# Title\n\nhello", None) and got["d.docx"][:2] == ("Head", "## Head\n\nBody")
    assert got["b.bin"][2] == "file type not supported" and got["c.pdf"][2] == "no PDF reader configured"


def test_mail(spark):
    import base64

    data = base64.urlsafe_b64encode(b"<p>Hi&amp;bye</p>").decode().rstrip("=")
    raw = {"id": "m1", "internalDate": "1000", "snippet": "a &lt; b", "payload": {"mimeType": "multipart/x", "headers": [{"name": "From", "value": "x"}, {"name": "FROM", "value": "y"}], "parts": [{"mimeType": "text/html", "body": {"data": data}}]}}
    (m,) = files.read_messages(spark.createDataFrame([("acc", json.dumps(raw)), ("acc", "nope")], "account_id string, value string")).collect()
    assert (m.sender, m.snippet, m.body) == ("x", "a < b", "Hi&bye")


def test_work_queue(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "tree_id string")
    assert {tuple(r) for r in sinks.work_queue(ids("a", "b", "c", "a"), ids("c"), ids("b")).collect()} == {("a", "build"), ("b", "resume")}


def test_batches_and_types(spark):
    rows = [('[{"type": "open"}, {"a": 1}]',), ("[]",), ('[1]',), ('{"a": 1}',), ("nope",), ('["' + "x" * (1 << 20) + '"]',)]
    got = spark.createDataFrame(rows, "b string").select(E.batch_problem(F.col("b"))).collect()
    assert [r[0] for r in got] == [None, None, "no array of objects", "no array", "no array", "too large"]
    told = E.known_types(spark.createDataFrame([("open",), ("open",), ("zzz",), (None,)], "type string")).collect()
    assert {(r.type, r.events, r.known) for r in told} == {("open", 2, True), ("zzz", 1, False), (None, 1, False)}


def test_log_lines_keep_order_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n": {k}}}\n' for k in range(5000)))
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n\nnope\n[1]\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.read_jsonl(spark, str(tmp_path)).collect()
        told = [(r.problem, r.finding is None) for r in files.read_ledger(spark, str(tmp_path / "b.jsonl")).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted((r for r in lines if "a.jsonl" in r.file), key=lambda r: r.seq)] == [f'{{"n": {k}}}' for k in range(5000)]
    assert told == [(None, False), ("b.jsonl:2: no JSON object", True), ("b.jsonl:3: no JSON object", True)]


def test_mail_by_id_and_account(spark):
    mail = spark.createDataFrame([("a", "1"), ("b", "1")], "account_id string, id string")
    assert [r.account_id for r in files.get_message(mail, "b", "1").collect()] == ["b"]
    asked = files.routed(spark.createDataFrame([("a",), ("z",)], "account_id string"), spark.createDataFrame([("a", "gmail")], "account_id string, provider string"))
    assert {(r.account_id, r.problem) for r in asked.collect()} == {("a", None), ("z", "unknown account: z")}
