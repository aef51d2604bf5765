from datetime import date

from pyspark.sql import functions as F

from leafloom.functions import classify, evidence


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("o")).first()[0]


def genre(spark, title, text):
    g = one(spark, classify.detect_genre(F.col("t"), F.col("x")), t=title, x=text)
    return g.genre, g.strong


def test_genres(spark):
    assert genre(spark, "Essay brief", "Assignment 2. Due date: 3 May. Submit by noon. Word limit 2000. Worth 40%.") == ("assignment", True)
    assert genre(spark, "", "From: a\nTo: b\nSubject: c\n\nhi") == ("email", True)
    assert genre(spark, "Team meeting notes", "Attendees: x\nAgenda\nAction items\nNext meeting Monday") == ("meeting", True)
    assert genre(spark, "A walk", "It rained on the hills all day.") == (None, False)


def test_settled_genre(spark):
    weak = F.struct(F.lit("news").alias("genre"), F.lit(False).alias("strong"))
    assert one(spark, classify.settled_genre(weak, F.col("m")), m="Research Paper") == "paper"
    assert one(spark, classify.settled_genre(weak, F.col("m")), m="poem") == "news"


def test_goals(spark):
    goal = lambda t, x: one(spark, classify.suggest_goal(F.col("t"), F.col("x")), t=t, x=x)
    assert goal("Assignment 1", "please submit the report") == "execute"
    assert goal("Notes", "the delay was due to rain") is None
    assert goal("Re: lunch", "Dear Bob, could you let me know") == "communicate"
    assert goal("Roadmap", "milestones and timeline") == "plan"


def test_tokens(spark):
    assert one(spark, evidence.content_tokens(F.col("x")), x="The submission was submitted by 1,500 people; it's Anna's") == ["submi", "1", "500", "peopl", "it", "anna"]


def test_numbers(spark):
    inside = lambda t, s: one(spark, evidence.number_in(F.col("t"), F.col("s")), t=t, s=s)
    assert inside("5", "5 of them") and inside("1,500", "about 1500 men") and inside("3", "three offices") and inside("40", "Forty")
    assert not inside("5", "25%") and not inside("20", "2025") and not inside("5", "1.5")
    assert inside("million", "2 million") and not inside("billion", "2 million")


def test_dates(spark):
    ok = lambda i, s: one(spark, evidence.dates_ok(F.col("i"), F.col("s")), i=i, s=s)
    assert ok("Fri 3 May", "friday, 3 may") and ok("by March", "12/03/2025") and ok("they may sat down", "x")
    assert not ok("Monday", "friday") and not ok("3 May", "3 June")


def test_resolve(spark):
    r = lambda i, s: one(spark, evidence.resolve_date(F.col("i"), F.col("s"), F.lit("2025-06-10").cast("date")), i=i, s=s)
    assert tuple(r("2025-11-14", "due 14 November 2025")) == ("2025-11-14", False)
    assert tuple(r("11-14", "due 14 November 2026")) == ("2026-11-14", False)
    assert tuple(r("03-01", "on 1 March")) == ("2026-03-01", True)
    assert r("2025-11-15", "due 14 November 2025") is None and r("2024-11-14", "14 November 2025") is None


def test_parse_iso(spark):
    p = lambda i: one(spark, evidence.parse_iso(F.col("i"), F.lit("2024-01-10").cast("date")), i=i)
    assert tuple(p("--02-29")) == (date(2024, 2, 29), True) and p("2025-02-30") is None and p("soon") is None


def test_times(spark):
    t = lambda h, s: one(spark, evidence.time_in(F.col("h"), F.col("s")), h=h, s=s)
    assert t("17:00", "at 5 pm") and t("17:00", "17:00") and t("09:30", "9.30am") and t("00:00", "midnight")
    assert not t("17:00", "at 5 am") and not t("25:00", "25:00")


def test_qualifier(spark):
    q = one(spark, evidence.qualifier_dropped(F.col("i"), F.col("c")), i="Late work is accepted", c="Late work is not accepted. Something else.")
    assert q.qualifier == "not" and q.sentence.startswith("Late work")
    assert one(spark, evidence.qualifier_dropped(F.col("i"), F.col("c")), i="Late work is never accepted", c="Late work is not accepted.") is None
