"""Queries over claims made from the orders table: what sentences about orders say, against those sentences as the passages cited.

Each order is a passage ("Ann Smith to pay 1,234 dollars by Friday 5 January 1996 at 5 pm."). Claims repeat it, every few of them with a
number, a day, a month, a date or a time that is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions import evidence as E
from leafloom.functions import text as T
from leafloom.functions.classify import essential_rank, is_task_like, settled_genre, valid_genre
from leafloom.operators import claims

TODAY = "1995-01-01"
NAMES = ("Ann Smith", "Bob Jones", "Cleo Lane")
LABELS = ("Deadline", "Deliverable", "First step", "Amount", "amount:")

_MADE = """made AS (SELECT *, who || ' to pay ' || amount || ' dollars by ' || dayname(d) || ' ' || day(d) || ' ' || monthname(d) || CASE WHEN k % 3 = 0 THEN '' ELSE ' ' || year(d) END AS passage_,
    ' at ' || CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || CASE WHEN h < 12 THEN ' am' ELSE ' pm' END || '.' AS tail FROM (
  SELECT o_orderkey AS k, o_custkey AS tree_id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 24 AS h, CAST(floor(o_totalprice) AS BIGINT) AS p, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS amount,
    ['Ann Smith', 'Bob Jones', 'Cleo Lane'][o_orderkey % 3 + 1] AS who FROM orders)),
said AS (SELECT *, passage_ || tail AS source, CASE k % 4 WHEN 0 THEN CAST(p AS VARCHAR) WHEN 1 THEN CAST(p + 1 AS VARCHAR) WHEN 2 THEN amount ELSE CAST(p * 10 AS VARCHAR) END AS number,
  dayname(d + CAST(k % 2 AS INTEGER)) AS weekday, CASE WHEN k % 5 = 0 THEN monthname(d + INTERVAL 40 DAY) ELSE monthname(d) END AS month_,
  right(strftime(d + CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INTEGER), '%Y-%m-%d'), CASE WHEN k % 3 < 2 THEN 5 ELSE 10 END) AS iso, lpad(CAST(CASE WHEN k % 6 = 0 THEN (h + 1) % 24 ELSE h END AS VARCHAR), 2, '0') || ':00' AS hhmm FROM made),
seen AS (SELECT *, [regexp_replace(t, '[.,]+$', '') FOR t IN regexp_extract_all(source, '[0-9][0-9,.]*')] AS raw, CASE WHEN k % 3 > 0 THEN year(d) END AS told FROM said),
dated AS (SELECT *, [replace(t, ',', '') FOR t IN raw] AS numbers, CASE WHEN length(iso) = 10 THEN CAST(iso AS DATE) ELSE coalesce(TRY_CAST('1995-' || iso AS DATE), TRY_CAST('1996-' || iso AS DATE)) END AS parsed, length(iso) < 10 AS inferred FROM seen),
judged AS (SELECT *, list_contains(numbers, replace(number, ',', '')) AS number_ok, weekday = dayname(d) AS day_ok, month_ = monthname(d) AS month_ok, CAST(left(hhmm, 2) AS BIGINT) = h AS time_ok,
  list_contains(raw, CAST(day(parsed) AS VARCHAR)) AND month(parsed) = month(d) AS date_ok FROM dated)"""


def _made(orders: DataFrame) -> DataFrame:
    k, d, p = F.col("k"), F.col("d"), F.col("p")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    x = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("tree_id"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 24).alias("h"), F.floor("o_totalprice").cast("long").alias("p"))
    x = x.withColumns({"amount": F.format_number("p", 0), "who": pick(NAMES)})
    h12 = F.when(F.col("h") % 12 == 0, 12).otherwise(F.col("h") % 12)
    source = F.concat(
        "who", F.lit(" to pay "), "amount", F.lit(" dollars by "), F.date_format(d, "EEEE d MMMM"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.year(d))),
        F.lit(" at "), h12, F.when(F.col("h") < 12, " am").otherwise(" pm"), F.lit("."),
    )
    number = F.when(k % 4 == 0, p.cast("string")).when(k % 4 == 1, (p + 1).cast("string")).when(k % 4 == 2, F.col("amount")).otherwise((p * 10).cast("string"))
    moved = F.when(k % 7 == 0, F.date_add(d, 1)).otherwise(d)
    return x.withColumns({
        "source": source, "number": number, "weekday": F.date_format(F.date_add(d, (k % 2).cast("int")), "EEEE"), "month": F.date_format(F.when(k % 5 == 0, F.date_add(d, 40)).otherwise(d), "MMMM"),
        "iso": F.when(k % 3 < 2, F.date_format(moved, "MM-dd")).otherwise(F.date_format(moved, "yyyy-MM-dd")),
        "hhmm": F.concat(F.lpad(F.when(k % 6 == 0, (F.col("h") + 1) % 24).otherwise(F.col("h")).cast("string"), 2, "0"), F.lit(":00")),
    })


def claim_checks(orders):
    """Numbers, days, months, dates and times of claims against their passages."""
    x = _made(orders)
    today, s = F.lit(TODAY).cast("date"), F.col("source")
    p = E.parse_iso(F.col("iso"), today)
    item = F.concat_ws(" ", "weekday", F.dayofmonth("d"), "month")
    r = E.resolve_date(F.col("iso"), s, today)
    return x.select(
        "k", E.number_in(F.col("number"), s).alias("number_ok"), E.dates_ok(item, s).alias("dates_ok"), E.supported(F.concat_ws(" ", "number", "weekday"), s).alias("supported"), p["date"].alias("parsed"), p["year_inferred"].alias("inferred"),
        E.date_in(p["date"], s).alias("date_ok"), E.time_in(F.col("hhmm"), s).alias("time_ok"), F.get(E.years_in(s), F.lit(0)).alias("year"), r["iso"].alias("resolved"), r["year_inferred"].alias("resolved_inferred"), T.date_phrase(s)["phrase"].alias("phrase"), T.date_phrase(s)["iso"].alias("phrase_iso"),
    )


def _leaves(x: DataFrame) -> DataFrame:
    return x.select("tree_id", F.col("k").cast("string").alias("leaf_id"), F.col("source").alias("text"))


def _cites(k):
    """Every ninth claim cites nothing real; others cite a passage that is there, after one that is not."""
    return F.when(k % 9 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("none"), k.cast("string")))


def claim_key_facts(orders):
    """Key facts that their passages support."""
    x = _made(orders)
    facts = x.select("tree_id", F.col("k").alias("claim_id"), F.concat("number", F.lit(" dollars")).alias("big"), F.concat(F.lit("To pay "), "number", F.lit(" dollars on a "), "weekday").alias("detail"), _cites(F.col("k")).alias("cites"))
    return claims.key_facts(facts, _leaves(x)).select("tree_id", "claim_id", "big", "detail", F.array_join("cites", ",").alias("cites"), F.col("warning").isNotNull().alias("warned"))


def claim_essentials(orders):
    """Essentials of each customer: supported ones, the first of each label, what to act on first at the top."""
    x = _made(orders)
    k = F.col("k")
    label = F.get(F.array(*map(F.lit, LABELS)), (k % len(LABELS)).cast("int"))
    items = x.select("tree_id", k.alias("claim_id"), k.alias("pos"), label.alias("label"), F.when(k % 11 == 0, "not stated").otherwise(F.concat(F.lit("pay "), "number", F.lit(" dollars"))).alias("value"), _cites(k).alias("cites"))
    return claims.essentials(items, _leaves(x)).select("tree_id", "claim_id", "label", "value", "place")


def claim_steps_and_sizes(orders):
    """First steps and sizes of jobs that passages support."""
    x = _made(orders)
    k = F.col("k")
    steps = claims.first_steps(x.select("tree_id", k.alias("claim_id"), F.concat(F.lit("Pay "), "number", F.lit(" dollars")).alias("text"), _cites(k).alias("cites")), _leaves(x))
    sizes = claims.job_sizes(x.select("tree_id", k.alias("claim_id"), F.lit("an hour").alias("text"), F.concat(F.lit("dollars to pay: "), "number").alias("basis"), _cites(k).alias("cites")), _leaves(x))
    return steps.select("tree_id", "claim_id", F.lit("step").alias("kind")).unionByName(sizes.select("tree_id", "claim_id", F.lit("size").alias("kind")))


def claim_deadlines(orders):
    """Deadlines whose dates passages name, with times that they name too."""
    x = _made(orders)
    k = F.col("k")
    items = x.select("tree_id", k.alias("claim_id"), "iso", F.col("hhmm").alias("time"), F.lit("Payment").alias("label"), _cites(k).alias("cites"))
    return claims.deadlines(items, _leaves(x), F.lit(TODAY).cast("date")).select("tree_id", "claim_id", "iso", "time", "year_inferred")


def claim_actions(orders):
    """Actions of people that passages name, twelve a customer, earliest first."""
    x = _made(orders)
    k = F.col("k")
    who = F.when(k % 10 == 0, "Zoe Ward").otherwise(F.col("who"))
    what = F.concat(F.lit("pay "), "number", F.lit(" dollars"))
    items = x.select("tree_id", k.alias("claim_id"), k.alias("pos"), who.alias("who"), what.alias("what"), F.lit(None).cast("string").alias("due"), F.col("iso").alias("due_iso"), _cites(k).alias("cites"))
    return claims.actions(items, _leaves(x), F.lit(TODAY).cast("date")).select("tree_id", "claim_id", "who", "what", "due_iso", "year_inferred", "place")


def extracted_actions(orders):
    """Who is to do what, by when, as the passages say it."""
    x = _made(orders)
    text = F.concat("who", F.lit(" to pay "), F.col("p").cast("string"), F.lit(" dollars by "), F.date_format("d", "EEEE d MMMM yyyy"), F.lit(". Nothing else."))
    return claims.extract_actions(x.select("tree_id", F.col("k").alias("leaf_id"), text.alias("text"))).select("tree_id", "leaf_id", "pos", "who", "what", "due")


def title_cleaners(customers):
    """Labels, keys, points and replies as they are cleaned."""
    name = F.concat(F.lit("The "), "c_mktsegment", F.lit(" of\tcustomer "), F.col("c_custkey").cast("string"), F.lit(" and the"))
    reply = F.concat(F.when(F.col("c_custkey") % 3 == 0, "```json\n").otherwise("Here: "), F.lit('{"k": '), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("}"), F.when(F.col("c_custkey") % 3 == 0, "\n```").otherwise(" ok"))
    points = F.array(F.lit(""), F.col("c_mktsegment"), F.lit(" "), F.lit("two"), F.lit(None).cast("string"), F.lit("three"), F.lit("four"), F.lit("five"))
    return customers.select(
        "c_custkey", T.clean_label(name).alias("label"), T.truncate_title(F.concat(name, F.lit(" very long title indeed")), 7).alias("title"), T.clean_short_title(F.col("c_mktsegment")).alias("short_title"),
        F.variant_get(T.json_object(reply), "$.k", "long").alias("reply_k"), F.array_join(T.clean_points(points), "|").alias("points"), T.lower_safe(F.concat("c_mktsegment", F.lit("É x"))).alias("low"),
        valid_genre(F.when(F.col("c_custkey") % 2 == 0, "Paper ").otherwise(F.col("c_mktsegment"))).alias("genre"), is_task_like(F.when(F.col("c_custkey") % 2 == 0, "meeting"), F.when(F.col("c_custkey") % 3 == 0, "plan")).alias("task"),
        settled_genre(F.struct(F.when(F.col("c_custkey") % 2 == 0, "news").alias("genre"), (F.col("c_custkey") % 4 == 0).alias("strong")), F.when(F.col("c_custkey") % 3 == 0, "legal")).alias("settled"),
        essential_rank(F.get(F.array(*map(F.lit, LABELS)), (F.col("c_custkey") % 5).cast("int"))).alias("rank"),
    )


def _sql(tokens: str) -> dict[str, str]:
    """tokens: SQL of content_tokens() with @ for its text."""
    enough = lambda item: f"len(list_intersect({tokens.replace('@', item)}, {tokens.replace('@', 'source')})) >= 0.35 * len({tokens.replace('@', item)})"
    made = f"WITH {_MADE}"
    supported = "(number_ok)"
    return {
        "claim_checks": made + """ SELECT k, number_ok, day_ok AND month_ok AS dates_ok, number_ok AND day_ok AS supported, parsed, inferred, date_ok, time_ok, CAST(told AS INTEGER) AS year, CASE WHEN NOT date_ok THEN NULL WHEN inferred AND told IS NOT NULL THEN strftime(TRY_CAST(told || strftime(parsed, '-%m-%d') AS DATE), '%Y-%m-%d')
  WHEN told IS NULL OR told = year(parsed) THEN strftime(parsed, '%Y-%m-%d') END AS resolved, CASE WHEN NOT date_ok THEN NULL WHEN inferred AND told IS NOT NULL THEN CASE WHEN TRY_CAST(told || strftime(parsed, '-%m-%d') AS DATE) IS NOT NULL THEN false END WHEN told IS NULL THEN true WHEN told = year(parsed) THEN inferred END AS resolved_inferred,
  day(d) || ' ' || monthname(d) || CASE WHEN k % 3 = 0 THEN '' ELSE ' ' || year(d) END AS phrase, right(strftime(d, '%Y-%m-%d'), CASE WHEN k % 3 = 0 THEN 5 ELSE 10 END) AS phrase_iso FROM judged""",
        "claim_key_facts": made + f""", f AS (SELECT *, number || ' dollars' AS big, 'To pay ' || number || ' dollars on a ' || weekday AS detail, number || ' dollars To pay ' || number || ' dollars on a ' || weekday AS both_ FROM judged)
SELECT tree_id, k AS claim_id, big, detail, CAST(k AS VARCHAR) AS cites, false AS warned FROM f WHERE k % 9 > 0 AND number_ok AND day_ok AND {enough('both_')}""",
        "claim_essentials": made + f""", i AS (SELECT *, ['Deadline', 'Deliverable', 'First step', 'Amount', 'amount'][k % 5 + 1] AS label, CASE WHEN k % 11 = 0 THEN 'not stated' ELSE 'pay ' || number || ' dollars' END AS value, [1, 2, 3, 4, 4][k % 5 + 1] AS rank_, CASE WHEN k % 9 = 0 THEN '' ELSE source END AS src FROM judged),
ok AS (SELECT * FROM i WHERE (k % 11 = 0 OR (k % 9 > 0 AND number_ok)) AND (k % 11 = 0 OR k % 9 = 0 OR {enough('value')})),
one AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY tree_id, lower(label) ORDER BY k) = 1), most AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY k) <= 7)
SELECT tree_id, k AS claim_id, label, value, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY rank_, k) AS INTEGER) AS place FROM most""",
        "claim_steps_and_sizes": made + f""" SELECT tree_id, k AS claim_id, 'step' AS kind FROM judged WHERE k % 9 > 0 AND {supported} AND {enough("('Pay ' || number || ' dollars')")}
UNION ALL SELECT tree_id, k, 'size' FROM judged WHERE k % 9 > 0 AND {supported} AND {enough("('dollars to pay: ' || number)")}""",
        "claim_deadlines": made + """, r AS (SELECT *, CASE WHEN NOT date_ok THEN NULL WHEN inferred AND told IS NOT NULL THEN strftime(TRY_CAST(told || strftime(parsed, '-%m-%d') AS DATE), '%Y-%m-%d') WHEN told IS NULL OR told = year(parsed) THEN strftime(parsed, '%Y-%m-%d') END AS resolved FROM judged)
SELECT tree_id, k AS claim_id, resolved AS iso, CASE WHEN time_ok THEN hhmm END AS time, CASE WHEN inferred AND told IS NOT NULL THEN false WHEN told IS NULL THEN true ELSE inferred END AS year_inferred FROM r WHERE k % 9 > 0 AND resolved IS NOT NULL""",
        "claim_actions": made + f""", r AS (SELECT *, 'pay ' || number || ' dollars' AS what, CASE WHEN NOT date_ok THEN NULL WHEN inferred AND told IS NOT NULL THEN strftime(TRY_CAST(told || strftime(parsed, '-%m-%d') AS DATE), '%Y-%m-%d') WHEN told IS NULL OR told = year(parsed) THEN strftime(parsed, '%Y-%m-%d') END AS due_iso FROM judged),
ok AS (SELECT * FROM r WHERE k % 9 > 0 AND k % 10 > 0 AND number_ok AND {enough('what')}), one AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY tree_id, lower(who), lower(what) ORDER BY k) = 1), most AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY k) <= 12)
SELECT tree_id, k AS claim_id, who, what, due_iso, CASE WHEN due_iso IS NULL THEN false WHEN inferred AND told IS NOT NULL THEN false WHEN told IS NULL THEN true ELSE inferred END AS year_inferred, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY due_iso NULLS LAST, k) AS INTEGER) AS place FROM most""",
        "extracted_actions": made + " SELECT tree_id, k AS leaf_id, CAST(0 AS INTEGER) AS pos, who, 'pay ' || p || ' dollars' AS what, dayname(d) || ' ' || day(d) || ' ' || monthname(d) || ' ' || year(d) AS due FROM made",
        "title_cleaners": """WITH n AS (SELECT *, 'The ' || c_mktsegment || ' of' || chr(9) || 'customer ' || c_custkey || ' and the' AS name FROM customer)
SELECT c_custkey, replace(name, chr(9), ' ') AS label, 'The ' || c_mktsegment || ' of customer' AS title, c_mktsegment AS short_title, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS reply_k, c_mktsegment || '|two|three|four' AS points, lower(c_mktsegment) || 'é x' AS low,
  CASE WHEN c_custkey % 2 = 0 THEN 'paper' END AS genre, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS task, CASE WHEN c_custkey % 4 = 0 THEN 'news' WHEN c_custkey % 3 = 0 THEN 'legal' WHEN c_custkey % 2 = 0 THEN 'news' ELSE 'other' END AS settled,
  CAST(least(3, c_custkey % 5) AS INTEGER) AS rank FROM n""",
    }


OVER_ORDERS = (claim_checks, claim_key_facts, claim_essentials, claim_steps_and_sizes, claim_deadlines, claim_actions, extracted_actions)
OVER_CUSTOMERS = (title_cleaners,)
