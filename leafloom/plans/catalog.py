"""The named queries of the reading engine over the tables of one folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions import classify, evidence, repair, text, units
from leafloom.functions.chunking import leaves as chunk_leaves
from leafloom.operators import claims, events, ledger, tree, zoom
from leafloom.sources.files import dealt, read_extracted, recent_trees
from leafloom.sources.shared import bounded_batches, written
from leafloom.sources.sinks import report_lines

from . import claim_queries, log_queries, mail_queries, overview_queries, page_queries, tree_queries
from .tree_sql import LEAVES
from .tree_sql import words as tree_sql_words

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Tables whose rows cost more to work on than to move.
TEXTS = ("documents", "pages")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(t) if name in TEXTS else t


W, C, P = units.WHITE, units.CJK, units.CJK_PUNCTUATION
_WORDS = f"CASE WHEN regexp_matches(text, '[{C}]') THEN len([u for u in regexp_extract_all(text, '{units.UNIT}') if NOT regexp_matches(u, '^[{P}]+$')]) ELSE len(regexp_extract_all(text, '{units.WORD}')) END"
_STRIP = lambda c: f"regexp_replace({c}, '^[{W}]+|[{W}]+$', '', 'g')"

# ---------------------------------------------------------------- units, genre


@query(f"SELECT doc_id, CAST({_WORDS} AS INTEGER) AS words, CAST(greatest(1, floor({_WORDS} / 238.0 + 0.5)) AS BIGINT) AS minutes, array_to_string(regexp_extract_all(text, '{units.WORD}')[1:25], ' ') AS head FROM documents")
def doc_reading_time(spark, sf_dir):
    n = units.word_count(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", n.alias("words"), units.reading_minutes(n).alias("minutes"), units.head_words(F.col("text"), 25).alias("head"))


_TITLE_LINE = f"[x for x in [{_STRIP('l')} for l in string_split(text, chr(10))] if x <> ''][1]"
_TITLE = f"""(SELECT CASE WHEN line IS NULL THEN 'Untitled' WHEN regexp_matches(line, '^#{{1,6}}[{W}]+') THEN line
  WHEN length(line) <= 90 THEN line ELSE regexp_replace(CASE WHEN position(' ' IN substr(line, 1, 90)) > 0 THEN regexp_replace(substr(line, 1, 90), ' [^ ]*$', '') ELSE substr(line, 1, 90) END, '[ ,;:\\-–]+$', '') || '…' END)"""


@query(f"SELECT doc_id, {_TITLE} AS title, {_STRIP(f'''CASE WHEN regexp_extract(text, '^[^.!?。！？{chr(10)}]{{1,80}}') <> '' THEN regexp_extract(text, '^[^.!?。！？{chr(10)}]{{1,80}}') ELSE text END''')} AS clause FROM (SELECT *, {_TITLE_LINE} AS line FROM documents)")
def doc_title(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.title_from_text(F.col("text")).alias("title"), text.first_clause(F.col("text")).alias("clause"))


def _count_sql(patterns, where: str, flags: str = "im") -> str:
    flags = flags.replace("m", "m")
    return " + ".join(f"CAST(regexp_matches({where}, '(?{flags}){p}') AS INTEGER)" for p in patterns)


_RX = lambda p: p.replace("'", "''")
_HEAD, _LONG = "(title || chr(10) || substr(text, 1, 3500))", "(substr(text, 1, 6000) || chr(10) || headings)"
_PLACES = {"announced": "(title || chr(10) || substr(headings, 1, 1500))", "opening": "substr(text, 1, 3000)", "title": "title"}


def _genre_sql() -> str:
    scores = []
    for g, cues in classify.CUES.items():
        s = _count_sql(map(_RX, cues), _LONG if g in ("paper", "technical") else _HEAD)
        if g in classify.BOOSTS:
            place, pattern, points = classify.BOOSTS[g]
            s += f" + CASE WHEN regexp_matches({_PLACES[place]}, '(?{'im' if place == 'opening' else 'i'}){pattern}') THEN {points} ELSE 0 END"
        scores.append(f"({s}) AS {g}")
    rows = ", ".join(f"struct_pack(m := -{g}, k := {k}, need := {classify.POINTS_NEEDED[g]}, genre := '{g}')" for k, g in enumerate(classify.CUES))
    return f"""
WITH d AS (SELECT *, {_TITLE} AS title FROM (SELECT *, {_TITLE_LINE} AS line, array_to_string([l for l in string_split(text, chr(10)) if starts_with({_STRIP('l')}, '#')], chr(10)) AS headings FROM documents)),
s AS (SELECT *, {", ".join(scores)}, len(list_distinct([lower(x) for x in regexp_extract_all(substr(text, 1, 1500), '{classify.FIELD}', 1)])) AS fields FROM d),
r AS (SELECT *, list_sort([{rows}]) AS ranked FROM s),
p AS (SELECT *, -ranked[1].m AS points, -ranked[2].m AS second, ranked[1].need AS need, ranked[1].genre AS best FROM r)
SELECT doc_id, lang, CASE WHEN fields >= 2 THEN 'email' WHEN points >= need AND points >= second + 2 THEN best WHEN points >= greatest(2, need - 2) AND points > second THEN best
  WHEN regexp_matches({_HEAD}, '(?i)\\bthe (?:meeting|minutes)\\b') AND meeting >= 2 THEN 'meeting' END AS genre,
  (fields >= 2 OR (points >= need AND points >= second + 2)) AS strong FROM p"""


def _genres(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    found = classify.detect_genre(text.title_from_text(F.col("text")), F.col("text"))
    return d.withColumn("g", found)


@query(_genre_sql())
def doc_genre(spark, sf_dir):
    return _genres(spark, sf_dir).select("doc_id", "lang", F.col("g.genre").alias("genre"), F.col("g.strong").alias("strong"))


@query(f"""SELECT lang, genre, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, avg(words) AS words_mean, median(words) AS words_median, min(words) AS words_min, max(words) AS words_max
FROM (SELECT g.lang, coalesce(g.genre, 'other') AS genre, CAST({_WORDS} AS INTEGER) AS words FROM ({_genre_sql()}) g JOIN documents USING (doc_id)) GROUP BY ALL""")
def genre_by_lang(spark, sf_dir):
    """Reading load by language and genre: scan, projection, classification and aggregation in one native plan."""
    x = _genres(spark, sf_dir).select("lang", F.coalesce("g.genre", F.lit("other")).alias("genre"), units.word_count(F.col("text")).alias("words"))
    return x.groupBy("lang", "genre").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.avg("words").alias("words_mean"), F.median("words").alias("words_median"), F.min("words").alias("words_min"), F.max("words").alias("words_max"))


def _goal_sql() -> str:
    rows = []
    for k, goal in enumerate(("execute", "communicate", "decide", "plan", "reference", "learn")):
        parts = []
        for p, w in classify.GOALS[goal]:
            for where, n in (("title", 2 * w), ("start", w)):
                if "(?!" in p:  # no lookahead in this dialect: take the excluded phrase out first
                    parts.append(f"CASE WHEN regexp_matches(regexp_replace({where}, '(?i)\\bdue\\s+to\\b', '', 'g'), '(?i)\\bdue\\b') THEN {n} ELSE 0 END")
                else:
                    parts.append(f"CASE WHEN regexp_matches({where}, '(?i){_RX(p)}') THEN {n} ELSE 0 END")
        rows.append(f"struct_pack(m := -({' + '.join(parts)}), k := {k}, goal := '{goal}')")
    return f"""WITH d AS (SELECT doc_id, {_TITLE} AS title, substr(text, 1, 2000) AS start FROM (SELECT *, {_TITLE_LINE} AS line FROM documents)),
r AS (SELECT doc_id, list_sort([{", ".join(rows)}])[1] AS best FROM d) SELECT doc_id, CASE WHEN -best.m >= 3 THEN best.goal END AS goal FROM r"""


@query(_goal_sql())
def doc_goal(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", classify.suggest_goal(text.title_from_text(F.col("text")), F.col("text")).alias("goal"))


# ---------------------------------------------------------------- text


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, [x for x in string_split(text, chr(10)) if {_STRIP('x')} <> ''] AS full_ FROM documents),
p AS (SELECT *, [len(regexp_extract_all(x, '{units.WORD}')) for x in full_] AS n, [x for x in full_ if NOT regexp_matches(x, '^[{W}]*(?:#{{1,6}}[{W}]|[-*+][{W}]|[0-9]{{1,3}}[.)][{W}]|>|\||```|~~~)') AND NOT regexp_matches(x, '^[{W}]*[{text.BULLETS}]')] AS prose FROM l)
SELECT doc_id, (len(n) >= 20 AND len([k for k in n if k <= 2]) / len(n) >= 0.85 AND list_median(n) <= 1) AS word_per_line,
 coalesce(len(prose) >= 8 AND list_median([length(x) for x in prose]) BETWEEN 25 AND 110 AND list_avg([len(regexp_extract_all(x, '{units.WORD}')) for x in prose]) >= 5
  AND len([x for x in prose if NOT regexp_matches(x, '[.!?]["'')\]”’]*$')]) / len(prose) >= 0.55 AND 1 - len(full_) / greatest(1, len(lines)) < 0.25, false) AS hard_wrapped FROM p""")
def doc_shape_flags(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", text.looks_word_per_line(F.col("text")).alias("word_per_line"), text.looks_hard_wrapped(F.col("text")).alias("hard_wrapped"))


@query(rf"SELECT doc_id, len(t) AS n_numbers, array_to_string(t, ' ') AS numbers, array_to_string([x for x in [regexp_replace(y, '[.,]+$', '') for y in t] if x <> ''], ' ') AS prose_numbers FROM (SELECT doc_id, regexp_extract_all(text, '{evidence.NUMBER}') AS t FROM documents)")
def doc_number_tokens(spark, sf_dir):
    c = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(evidence.number_tokens(c)).cast("long").alias("n_numbers"), F.array_join(evidence.number_tokens(c), " ").alias("numbers"), F.array_join(evidence.prose_numbers(c), " ").alias("prose_numbers"))


@query("SELECT substr(sha256('objective:learn' || chr(10) || 'm' || chr(10) || text), 1, 16) AS tree_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_tree_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(text.tree_id(F.col("text"), "learn", "m").alias("tree_id"), "doc_id")
    return d.groupBy("tree_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"""SELECT doc_id, md5(array_to_string([CASE WHEN {_STRIP('l')} = '' THEN '' ELSE replace(regexp_extract(l, '^[ \t]*'), chr(9), '    ') || regexp_replace({_STRIP('l')}, '[ \t]+', ' ', 'g') END
  for l in string_split(replace(replace(regexp_replace(translate(text, '{text.HYPHENS}{text.ODD_SPACES}{text.DROPPED}', '---       '), chr(13) || chr(10) || '?', chr(10), 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(10))], chr(10))) AS cleaned_md5 FROM documents""")
def doc_clean_characters(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_characters(F.col("text"))).alias("cleaned_md5"))


@query(f"""SELECT doc_id, CASE WHEN len(w) <= 18 THEN {_STRIP('text')} ELSE array_to_string(w[1:18], ' ') END AS point, CASE WHEN length(s) <= 100 THEN s
  ELSE regexp_replace(CASE WHEN position(' ' IN substr(s, 1, 100)) > 0 AND 100 - position(' ' IN reverse(substr(s, 1, 100))) > 50 THEN substr(s, 1, 100 - position(' ' IN reverse(substr(s, 1, 100)))) ELSE substr(s, 1, 100) END, '[ ,;:\\-–]+$', '') END AS capped
FROM (SELECT doc_id, text, regexp_extract_all(text, '{units.WORD}') AS w, {_STRIP('text')} AS s FROM documents)""")
def doc_caps(spark, sf_dir):
    c = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncate_words(c, 18).alias("point"), text.cap_chars(c, 100).alias("capped"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\x{a0}]+', ' ', 'g'), '[@W]*\n[@W]*', chr(10), 'g'), '^[@W]+|[@W]+$', '', 'g') AS text FROM pages""".replace("@W", W))
def page_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, CASE WHEN regexp_matches({_STRIP('bare')}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') OR {_STRIP('bare')} = '' THEN {_STRIP('bare')} ELSE 'https://' || {_STRIP('bare')} END AS url, regexp_matches(bare, '^[A-Za-z0-9_-]{{1,64}}$') AS safe FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS bare FROM pages)")
def page_urls(spark, sf_dir):
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", text.clean_url(bare).alias("url"), text.safe_id(bare).alias("safe"))


@query()
def doc_normalised(spark, sf_dir):
    """Repaired text of every document: email noise out, wrapped and broken lines joined."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(repair.ingested(F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, true AS settled, true AS squeezed, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents")
def normalise_checks(spark, sf_dir):
    """What holds for repaired texts: repairing again changes nothing, no blank space is left over, and no letter is lost or made."""
    once = _t(spark, sf_dir, "documents").select("doc_id", repair.normalised(F.col("text")).alias("t"))
    x = once.withColumn("again", repair.normalised(F.col("t")))
    squeezed = ~F.col("t").rlike(r"\n{3,}|[ \t]\n|^\s|\s\z")
    return x.select("doc_id", (F.col("t") == F.col("again")).alias("settled"), squeezed.alias("squeezed"), F.length(F.regexp_replace("t", "[^A-Za-z]", "")).cast("long").alias("letters"))


_SAID = "regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,]+', ' ', 'g'), ' +', ' ', 'g')"
_MAIL = ("From: a@b.c\nTo: x@y.z\nSubject: news\n\n", "\n\nBest regards,\nAnn Smith\n+44 123 456 789\n\nOn Monday 5 May, Bob Jones\nwrote:\n> old text\n> more of it\n", "\n\nSent from my phone\n-----Original Message-----\nFrom: q@r.s\n\nold")


def _lit_sql(t: str) -> str:
    return " || chr(10) || ".join(f"'{x}'" for x in t.split("\n"))


def _said():
    return F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 .,]+", " "), " +", " ")


@query(f"""WITH s AS (SELECT conv_id, turn, {_SAID} AS t FROM conversations), m AS (SELECT *, {_lit_sql(_MAIL[0])} || t || CASE WHEN turn % 2 = 0 THEN {_lit_sql(_MAIL[1])} ELSE {_lit_sql(_MAIL[2])} END AS mail FROM s)
SELECT conv_id, turn, CASE WHEN len({tree_sql_words('t')}) >= 8 THEN {_lit_sql(_MAIL[0])} || regexp_replace(t, ' +$', '') ELSE mail END AS newest FROM m""")
def mail_noise(spark, sf_dir):
    """Turns sent as mail, with signatures and quoted history: the new message alone where it says something."""
    c = _t(spark, sf_dir, "conversations")
    mail = F.concat(F.lit(_MAIL[0]), _said(), F.when(F.col("turn") % 2 == 0, _MAIL[1]).otherwise(_MAIL[2]))
    return c.select("conv_id", "turn", repair.without_email_noise(mail).alias("newest"))


@query(f"""SELECT conv_id, turn, 'What was said' || chr(10) || chr(10) || '- ' || t || chr(10) || '- Second point' || chr(10) || chr(10) || 'End of it.' AS repaired, t AS cell FROM (SELECT conv_id, turn, {_STRIP(_SAID)} AS t FROM conversations) WHERE t <> ''""")
def list_repair(spark, sf_dir):
    """Bullets of pasted text as list items set apart, and tables of one cell unwrapped."""
    x = _t(spark, sf_dir, "conversations").select("conv_id", "turn", units.strip(_said()).alias("t")).where("t <> ''")
    pasted = F.concat(F.lit("What was said\n\u2022 "), "t", F.lit("\n\u2022   Second point \nEnd of it.\n\n\n\n"))
    x = x.select("conv_id", "turn", repair.normalised(pasted).alias("repaired"), F.concat(F.lit("| "), "t", F.lit(" |")).alias("cell"))
    return read_extracted(x, "cell")


# ---------------------------------------------------------------- evidence

_TOKENS = f"""list_distinct([CASE WHEN regexp_matches(w, '[0-9]') THEN replace(w, ',', '') ELSE substr(CASE {" ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 4 THEN substr(w, 1, length(w) - {len(s)})" for s in evidence.SUFFIXES)} ELSE w END, 1, 5) END
  for w in [regexp_replace(regexp_replace(lower(x), '^[''’-]+|[''’-]+$', '', 'g'), '[''’]s$', '') for x in regexp_extract_all(@, '[A-Za-z0-9][A-Za-z0-9''’-]*')
  if NOT list_contains([{", ".join(f"'{s}'" for s in evidence.STOP_WORDS)}], lower(x)) AND (length(x) >= 3 OR regexp_matches(x, '[0-9]'))]])"""


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, {_TOKENS.replace('@', 'text')} AS t FROM documents)")
def doc_content_tokens(spark, sf_dir):
    t = evidence.content_tokens(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query(f"""WITH b AS (SELECT item_id, {_TOKENS.replace('@', 'text')} AS a FROM benchmark), d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {_TOKENS.replace('@', 'text')} AS s FROM documents)
SELECT doc_id, item_id, CAST(len(list_intersect(a, s)) AS INTEGER) AS shared, CAST(len(a) AS INTEGER) AS total, (len(a) = 0 OR len(list_intersect(a, s)) / len(a) >= 0.35) AS ok FROM d JOIN b USING (item_id)""")
def claim_overlap(spark, sf_dir):
    """Each document against one benchmark item: shared content words and whether they are enough."""
    b = _t(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*").alias("n"))  # one row
    d = _t(spark, sf_dir, "documents").join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), F.col("text").alias("source"))
    o = evidence.overlap(F.col("text"), F.col("source"))
    x = d.join(b, "item_id").withColumn("o", o)
    return x.select("doc_id", "item_id", F.col("o.shared").alias("shared"), F.col("o.total").alias("total"), F.when(F.col("o.total") == 0, True).otherwise(F.col("o.shared") / F.col("o.total") >= evidence.OVERLAP_FLOOR).alias("ok"))


# ---------------------------------------------------------------- trees and zoom


@query()
def leaf_split(spark, sf_dir):
    return chunk_leaves(_t(spark, sf_dir, "documents")).select("doc_id", "leaf_no", "words", "span_start", "span_end", "atomic", F.md5("text").alias("text_md5"))


_LINES = f"SELECT doc_id, k - 1 AS leaf_no, CAST(len(regexp_extract_all(line, '{units.WORD}')) AS INTEGER) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)"


@query(f"""WITH l AS ({_LINES}), g AS (SELECT *, least(leaf_no // 3, greatest(0, CAST(ceil((count(*) OVER (PARTITION BY doc_id) - 6) / 3.0) AS BIGINT))) AS grp FROM l)
SELECT doc_id, CAST(grp AS INTEGER) AS grp, count(*) AS n_children, CAST(sum(words) AS BIGINT) AS child_words, CAST(greatest(1, round_even(sum(words) / 3.0, 0)) AS BIGINT) AS target, CAST(min(leaf_no) AS INTEGER) AS first_child FROM g GROUP BY doc_id, grp""")
def first_level_groups(spark, sf_dir):
    """Lines as leaves, grouped into the first level of a tree."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("leaf_no", "line"))
    x = d.select("doc_id", "leaf_no", F.size(units.words(F.col("line"))).alias("words"), F.lit(0).alias("span_start"), F.lit(0).alias("span_end"))
    return tree.level_aggregate(tree.first_level_groups(x)).select("doc_id", "grp", "n_children", "child_words", "target", "first_child")


@query()
def doc_trees(spark, sf_dir):
    """Shape of every document's summary tree."""
    n = tree.build_trees(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return n.groupBy("tree_id").agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("max_depth"), F.max(F.when(F.col("parent").isNull(), F.col("words"))).alias("root_words"))


@query()
def tree_sections(spark, sf_dir):
    n = tree.build_trees(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return tree.sections(written(n.select("tree_id", "node_id", "depth", "doc_pos"), "nodes"))


@query()
def tree_zoom_steps(spark, sf_dir):
    return zoom.document_steps(_t(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def tree_search(spark, sf_dir):
    return zoom.search(tree.build_trees(_t(spark, sf_dir, "documents").select("doc_id", "text")), tree_queries.SOUGHT)


def _over(f, name: str):
    def run(spark, sf_dir):
        return f(_t(spark, sf_dir, name))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


for _name, _fs in (("documents", tree_queries.QUERIES), ("orders", claim_queries.OVER_ORDERS), ("customer", claim_queries.OVER_CUSTOMERS), ("events", log_queries.OVER_EVENTS), ("conversations", (mail_queries.mail_by_account,)), ("pages", (page_queries.link_checks,)), ("documents", (page_queries.corpus_search, page_queries.build_actions)), *overview_queries.OVER):
    for _f in _fs:
        query()(_over(_f, _name))
_SQL |= {"mail_by_account": mail_queries.MAIL_SQL, "link_checks": page_queries.LINK_SQL, "corpus_search": page_queries.SEARCH_SQL, "build_actions": page_queries.BUILDS_SQL} | tree_queries.TREE_SQL | claim_queries._sql(_TOKENS) | log_queries.LOG_SQL | overview_queries.OVERVIEW_SQL


# ---------------------------------------------------------------- events


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS length_us FROM s GROUP BY user_id, session_no""")
def session_islands(spark, sf_dir):
    x = events.sessions(_t(spark, sf_dir, "events").withColumn("seq", F.col("event_id")), "user_id", "ts", 1800)
    return x.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("length_us"))


def _log(spark, sf_dir):
    """The events table read as a reading log: sign-ups start a phase, errors end it, purchases are outcomes, clicks close sessions."""
    e = _t(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    kind = F.when(F.col("event_type").isin("signup", "error"), "experiment").when(F.col("event_type") == "purchase", "outcome").when(F.col("event_type") == "click", "close").otherwise("dial")
    null = F.lit(None)
    return e.select(
        "user_id", F.col("event_id").alias("seq"), kind.alias("type"), F.when(F.col("event_type") == "error", "end").alias("action"), F.when(F.col("event_type") == "signup", F.get(F.array(*map(F.lit, events.PHASES)), k.cast("int"))).alias("phase"),
        null.cast("string").alias("condition"), F.when((F.col("event_type") == "signup") & (F.col("event_id") % 3 > 0), F.concat(F.lit("doc"), F.col("event_id") % 3)).alias("doc_label"), F.concat(F.lit("t"), F.col("event_id") % 2).alias("tree_id"),
        F.when(F.col("event_type") == "purchase", F.round("value", 2)).alias("minutes_to_know"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 6).alias("checklist_score"), null.cast("double").alias("minutes_to_first_action"),
        *[F.when(F.col("event_type") == "purchase", ((F.col("event_id") + i) % 101).cast("double")).alias(c) for i, c in enumerate(events.TLX)], null.cast("boolean").alias("missed_later"), (F.col("event_id") % 2 == 0).alias("started_within_24h"),
        F.when(F.col("event_type") == "click", F.round(F.col("value") * 10)).alias("session_ms"), null.cast("double").alias("first_zoom_ms"), ((F.col("event_id") % 100) / 100).alias("max_z"), F.col("event_id").alias("source_checks"), (F.col("event_id") % 5 == 0).alias("did_it_help"), null.cast("boolean").alias("value"),
    )


_LOG_SQL = """WITH log AS (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'error') THEN 'experiment' WHEN event_type = 'purchase' THEN 'outcome' WHEN event_type = 'click' THEN 'close' ELSE 'dial' END AS type,
  event_type = 'error' AS ends, CASE WHEN event_type = 'signup' THEN ['A1', 'B1', 'A2', 'B2'][event_id % 4 + 1] END AS phase, CASE WHEN event_type = 'signup' AND event_id % 3 > 0 THEN 'doc' || event_id % 3 END AS label, 't' || event_id % 2 AS tree_id,
  event_type, event_id, value FROM events),
i AS (SELECT *, sum(CAST(ends AS INTEGER)) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM log),
c AS (SELECT *, last_value(phase IGNORE NULLS) OVER w AS phase_of, coalesce(last_value(label IGNORE NULLS) OVER w, tree_id) AS label_of FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, substr(phase_of, 1, 1) AS condition_of FROM c WHERE type <> 'experiment')"""


@query(_LOG_SQL + " SELECT user_id, seq, type, phase_of, condition_of, label_of FROM k")
def phase_carry_forward(spark, sf_dir):
    return events.carry_experiment(_log(spark, sf_dir), ["user_id"]).select("user_id", "seq", "type", "phase_of", "condition_of", "label_of")


_DOCS_SQL = _LOG_SQL + """, d AS (SELECT user_id, phase_of AS phase, label_of AS doc_label, arg_min(condition_of, seq) AS condition,
  arg_max(round(value, 2), seq) FILTER (event_type = 'purchase') AS minutes_to_know, arg_max(event_id % 6, seq) FILTER (event_type = 'purchase') AS checklist_score,
  arg_max((event_id % 101 + (event_id + 1) % 101 + (event_id + 2) % 101 + (event_id + 3) % 101 + (event_id + 4) % 101 + (event_id + 5) % 101) / 6.0, seq) FILTER (event_type = 'purchase') AS tlx_raw,
  arg_max(event_id % 2 = 0, seq) FILTER (event_type = 'purchase') AS started_within_24h, count(*) FILTER (event_type = 'click') AS sessions, sum(round(value * 10)) FILTER (event_type = 'click') AS session_ms,
  max((event_id % 100) / 100.0) FILTER (event_type = 'click') AS max_z, CAST(sum(event_id) FILTER (event_type = 'click') AS DOUBLE) AS source_checks, arg_max(event_id % 5 = 0, seq) FILTER (event_type = 'click') AS did_it_help
  FROM k WHERE phase_of IS NOT NULL GROUP BY user_id, phase_of, label_of)"""


@query(_DOCS_SQL + " SELECT user_id, phase, doc_label, condition, minutes_to_know, checklist_score, tlx_raw, started_within_24h, sessions, session_ms, max_z, source_checks, did_it_help FROM d")
def experiment_documents(spark, sf_dir):
    d = events.documents_report(events.carry_experiment(_log(spark, sf_dir), ["user_id"]), ["user_id"])
    return d.select("user_id", "phase", "doc_label", "condition", "minutes_to_know", "checklist_score", "tlx_raw", "started_within_24h", "sessions", "session_ms", "max_z", "source_checks", "did_it_help")


@query(_DOCS_SQL + """ SELECT user_id, phase, count(*) AS documents, CAST(sum(sessions) AS BIGINT) AS sessions, count(minutes_to_know) AS minutes_to_know_n, avg(minutes_to_know) AS minutes_to_know_mean, median(minutes_to_know) AS minutes_to_know_median,
  min(minutes_to_know) AS minutes_to_know_min, max(minutes_to_know) AS minutes_to_know_max, count(*) FILTER (started_within_24h) AS started_within_24h_yes, count(*) FILTER (NOT started_within_24h) AS started_within_24h_no FROM d GROUP BY user_id, phase""")
def experiment_phases(spark, sf_dir):
    c = events.carry_experiment(_log(spark, sf_dir), ["user_id"])
    p = events.phases_report(events.documents_report(c, ["user_id"]), c, ["user_id"])
    return p.select("user_id", "phase", "documents", "sessions", *[f"minutes_to_know_{x}" for x in ("n", "mean", "median", "min", "max")], "started_within_24h_yes", "started_within_24h_no")


@query(_DOCS_SQL + """, m AS (SELECT user_id, phase, list_position(['A1', 'B1', 'A2', 'B2'], phase) AS k, median(minutes_to_know) AS centre FROM d WHERE minutes_to_know IS NOT NULL GROUP BY user_id, phase),
 s AS (SELECT *, lag(centre) OVER (PARTITION BY user_id ORDER BY k) AS b FROM m)
 SELECT user_id, count(*) AS phases, array_to_string(list(CASE WHEN centre = b THEN 'same' WHEN centre < b THEN 'better' ELSE 'worse' END ORDER BY k) FILTER (b IS NOT NULL), ',') AS changes,
  CASE WHEN count(*) = 4 THEN max(centre) FILTER (phase = 'B1') < max(centre) FILTER (phase = 'A1') AND max(centre) FILTER (phase = 'B2') < max(centre) FILTER (phase = 'A2') END AS b_beat_a_twice FROM s GROUP BY user_id HAVING count(*) >= 2""")
def experiment_pattern(spark, sf_dir):
    c = events.carry_experiment(_log(spark, sf_dir), ["user_id"])
    p = events.pattern_report(events.phases_report(events.documents_report(c, ["user_id"]), c, ["user_id"]), ["user_id"]).where("metric = 'minutes_to_know'")
    return p.select("user_id", "phases", F.array_join("changes", ",").alias("changes"), "b_beat_a_twice")


@query("SELECT event_type, count(value) AS value_n, avg(value) AS value_mean, median(value) AS value_median, min(value) AS value_min, max(value) AS value_max, count(*) FILTER (event_id % 3 = 0) AS third_yes, count(*) FILTER (event_id % 3 <> 0) AS third_no FROM events GROUP BY event_type")
def event_metric_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("third", F.col("event_id") % 3 == 0)
    return e.groupBy("event_type").agg(*events.stats("value"), *events.yes_no("third"))


@query("SELECT event_id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS checklist_score, json_type(props) = 'OBJECT' AS is_object FROM events")
def event_json_clean(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.replace("props", F.lit('"k"'), F.lit('"checklist_score"')).alias("value"))
    kept = events.clean_events(events.parse_lines(e)).select(F.col("seq").alias("event_id"), "checklist_score")
    return e.select(F.col("seq").alias("event_id")).join(kept.withColumn("is_object", F.lit(True)), "event_id", "left").select("event_id", "checklist_score", F.coalesce("is_object", F.lit(False)).alias("is_object"))


@query("""WITH m AS (SELECT user_id, ts, max(value) AS checkin FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(m.ts) <= 14400000000 THEN m.checkin END AS checkin FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts WHERE e.event_type = 'view'""")
def checkin_asof(spark, sf_dir):
    """Views with the check-in (a sign-up here) of the four hours before."""
    e = _t(spark, sf_dir, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("checkin"))
    return events.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "checkin", 14_400).select("event_id", "checkin")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_top20(spark, sf_dir):
    """The latest entry of each user, newest twenty."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("tree_id"), F.struct("ts", "event_id").alias("saved_at"))
    return recent_trees(e).select("saved_at.event_id", F.col("tree_id").alias("user_id"), "saved_at.ts")


@query("SELECT quality, toxic, count(*) AS documents, avg(n_chars) AS chars_mean, median(n_chars) AS chars_median, min(n_chars) AS chars_min, max(n_chars) AS chars_max FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def quality_by_length(spark, sf_dir):
    x = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("chars")), "doc_id")
    return x.groupBy("quality", "toxic").agg(F.count("*").alias("documents"), *events.stats("chars")[1:])


@query("""SELECT conv_id, turn, row_number() OVER w AS place, coalesce(role <> lag(role) OVER w, true) AS new_speaker, lead(role) OVER w AS next_role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) AS BIGINT) AS chars_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conv_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"), F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("new_speaker"), F.lead("role").over(w).alias("next_role"), (upto - F.length("text")).alias("chars_before"))


@query(_DOCS_SQL + " SELECT user_id, condition, count(*) AS documents, CAST(sum(sessions) AS BIGINT) AS sessions, array_to_string([x FOR x IN ['A1', 'B1', 'A2', 'B2'] IF list_contains(list(phase), x)], ',') AS phases FROM d GROUP BY user_id, condition")
def experiment_conditions(spark, sf_dir):
    d = events.documents_report(events.carry_experiment(_log(spark, sf_dir), ["user_id"]), ["user_id"])
    return events.by_condition(d, ["user_id"]).select("user_id", "condition", "documents", "sessions", F.array_join("phases", ",").alias("phases"))


def _figure_sql(c: str) -> str:
    tenths = f"CAST(round({c} * 10) AS BIGINT)"
    return f"coalesce(CAST({tenths} // 10 AS VARCHAR) || CASE WHEN {tenths} % 10 > 0 THEN '.' || {tenths} % 10 ELSE '' END, '-')"


@query(_DOCS_SQL + f""", p AS (SELECT user_id, phase, min(condition) AS condition, count(*) AS n, CAST(sum(sessions) AS BIGINT) AS sessions, median(minutes_to_know) AS know, count(minutes_to_know) AS know_n, avg(checklist_score) AS score, count(checklist_score) AS score_n, avg(tlx_raw) AS tlx, count(tlx_raw) AS tlx_n,
  count(*) FILTER (started_within_24h) AS y24, count(*) FILTER (NOT started_within_24h) AS n24 FROM d GROUP BY user_id, phase),
 h AS (SELECT user_id, phase_of AS phase, count(*) FILTER (event_id % 5 = 0) AS yes, count(*) FILTER (event_id % 5 <> 0) AS no FROM k WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, phase, phase || '  condition ' || condition || '  ' || n || ' document(s), ' || sessions || ' session(s)' || chr(10) || '    Minutes to know what to do: median ' || {_figure_sql('know')} || ' (n=' || know_n || ')' || chr(10)
  || '    Checklist score (0 to 5): mean ' || {_figure_sql('score')} || ' (n=' || score_n || ')' || chr(10) || '    Effort (0 to 100): mean ' || {_figure_sql('tlx')} || ' (n=' || tlx_n || ')' || CASE WHEN y24 + n24 > 0 THEN chr(10) || '    Started within 24 hours: yes ' || y24 || ', no ' || n24 ELSE '' END
  || CASE WHEN yes + no > 0 THEN chr(10) || '    Did it help: yes ' || yes || ', no ' || no ELSE '' END AS text FROM p LEFT JOIN h USING (user_id, phase)""")
def experiment_report_lines(spark, sf_dir):
    """The report's lines for each phase of a reader."""
    c = events.carry_experiment(_log(spark, sf_dir), ["user_id"])
    p = events.phases_report(events.documents_report(c, ["user_id"]), c, ["user_id"])
    return report_lines(p, ["user_id"])


@query(_LOG_SQL + " SELECT count(*) FILTER (phase_of IS NULL) AS unassigned_events FROM k")
def experiment_unassigned(spark, sf_dir):
    return events.unassigned(events.carry_experiment(_log(spark, sf_dir), ["user_id"]))


# ---------------------------------------------------------------- ledger

_ASSUMPTIONS = "VALUES ('A1', map('plan', 'Y', 'learn', 'C')), ('A2', map('plan', '?')), ('A3', map('plan', 'N', 'learn', 'Y'))"
_FINDINGS = "VALUES ('F1', array('A1'), 'supports', 'f1'), ('F2', array('A1', 'A2'), 'opposes', 'f1'), ('F3', array('A3', 'A9'), 'supports', 'f2'), ('F4', array(), 'parameterises', 'f2')"


def _ledger(spark):
    a = spark.sql(f"SELECT id, id AS text, 'axis' AS axis, holds FROM ({_ASSUMPTIONS}) t(id, holds)")
    f = spark.sql(f"SELECT id, cast(assumptions AS array<string>) AS assumptions, array(named_struct('text', '', 'features', array(feature), 'effect', effect)) AS implications FROM ({_FINDINGS}) t(id, assumptions, effect, feature)")
    return a, f, spark.sql("SELECT * FROM VALUES ('plan'), ('learn') t(id)")


_LEDGER_SQL = """WITH h AS (SELECT * FROM (VALUES ('A1', 'plan', 0), ('A1', 'learn', 1), ('A2', 'plan', 2), ('A2', 'learn', 2), ('A3', 'plan', 3), ('A3', 'learn', 0)) t(a, objective, r)),
f AS (SELECT * FROM (VALUES ('F1', ['A1'], 'supports', 'f1'), ('F2', ['A1', 'A2'], 'opposes', 'f1'), ('F3', ['A3', 'A9'], 'supports', 'f2'), ('F4', [], 'parameterises', 'f2')) t(finding, aa, effect, feature)),
s AS (SELECT finding, objective, effect, feature, coalesce((SELECT max(r) FROM h WHERE h.objective = o.objective AND list_contains(f.aa, h.a)), 0) AS r FROM f CROSS JOIN (VALUES ('plan'), ('learn')) o(objective))"""


@query(_LEDGER_SQL + " SELECT finding, objective, ['Y', 'C', '?', 'N'][r + 1] AS status FROM s")
def ledger_status(spark, sf_dir):
    a, f, o = _ledger(spark)
    return ledger.finding_status(f, o, ledger.holds(a, o)).select("finding", "objective", "status")


@query(_LEDGER_SQL + """ SELECT feature, objective, coalesce(['Y', 'C', '?', 'N'][min(r) FILTER (effect <> 'opposes') + 1], '-') AS status, count(*) FILTER (effect <> 'opposes') AS supporting,
 coalesce(string_agg(finding, ',' ORDER BY finding) FILTER (effect = 'opposes' AND r <= 1), '') AS opposed_by FROM s GROUP BY feature, objective""")
def ledger_features(spark, sf_dir):
    a, f, o = _ledger(spark)
    x = ledger.feature_status(f, ledger.finding_status(f, o, ledger.holds(a, o)))
    return x.select("feature", "objective", "status", "supporting", F.array_join("opposed_by", ",").alias("opposed_by"))


@query(_LEDGER_SQL + """, p AS (SELECT * FROM s WHERE objective = 'plan'), k AS (SELECT p.finding, p.r AS worst, h.a, h.r FROM p JOIN f USING (finding) JOIN h ON h.objective = 'plan' AND list_contains(f.aa, h.a))
SELECT 'status' AS section, n.item, NULL AS told, (SELECT count(*) FROM p WHERE ['Y', 'C', '?', 'N'][r + 1] = n.item) AS findings, '' AS names FROM (VALUES ('Y'), ('C'), ('?'), ('N')) n(item)
UNION ALL SELECT 'queue', a, a, count(*), string_agg(finding, ',' ORDER BY finding) FROM k WHERE worst = 2 AND r = 2 GROUP BY a
UNION ALL SELECT 'fails', finding, string_agg(a || '=N', ', ' ORDER BY a) FILTER (r = 3), 1, '' FROM k WHERE worst = 3 GROUP BY finding
UNION ALL SELECT 'feature', feature, coalesce(['Y', 'C', '?', 'N'][min(r) FILTER (effect <> 'opposes') + 1], '-'), count(*) FILTER (effect <> 'opposes'), coalesce(string_agg(finding, ',' ORDER BY finding) FILTER (effect = 'opposes' AND r <= 1), '') FROM p GROUP BY feature""")
def ledger_impact(spark, sf_dir):
    """What one objective means for findings, assumptions and features."""
    a, f, o = _ledger(spark)
    x = ledger.impact(f, a, ledger.finding_status(f, o, ledger.holds(a, o)), "plan")
    return x.withColumn("names", F.array_join("names", ","))


@query(_LEDGER_SQL + """ SELECT finding, objective, ['Y', 'C', '?', 'N'][r + 1] AS status, (SELECT string_agg(h.a || '=' || ['Y', 'C', '?', 'N'][h.r + 1], ' ' ORDER BY h.a) FROM h, f WHERE f.finding = s.finding AND h.objective = s.objective AND h.r > 0 AND list_contains(f.aa, h.a)) AS blockers
 FROM s WHERE finding = 'F2'""")
def ledger_finding(spark, sf_dir):
    a, f, o = _ledger(spark)
    x = ledger.finding_view(f, ledger.finding_status(f, o, ledger.holds(a, o)), "F2")
    return x.select("finding", "objective", "status", F.array_join("blockers", " ").alias("blockers"))


@query(_LEDGER_SQL + """, b AS (SELECT s.objective, h.a AS assumption FROM s JOIN f USING (finding) JOIN h ON h.objective = s.objective AND list_contains(f.aa, h.a) WHERE s.r = 2 AND h.r = 2)
 SELECT objective, assumption, count(*) AS findings FROM b GROUP BY ALL""")
def ledger_queue(spark, sf_dir):
    """Unknown assumptions by how many findings they block."""
    a, f, o = _ledger(spark)
    return ledger.research_queue(ledger.finding_status(f, o, ledger.holds(a, o)))


@query("""WITH h AS (SELECT * FROM (VALUES ('A1', 'plan', 'Y'), ('A1', 'learn', 'C'), ('A2', 'plan', 'C'), ('A3', 'plan', 'N'), ('A3', 'learn', 'Y')) t(assumption, objective, status))
SELECT assumption, coalesce(max(status) FILTER (objective = 'plan'), '?') AS plan, coalesce(max(status) FILTER (objective = 'learn'), '?') AS learn FROM h GROUP BY assumption""")
def ledger_matrix(spark, sf_dir):
    """Assumptions by objectives, with one of them overridden."""
    a, f, o = _ledger(spark)
    return ledger.matrix(ledger.holds(a, o, spark.sql("SELECT 'A2' AS assumption, 'plan' AS objective, 'C' AS status")), ["plan", "learn"])


@query(_LEDGER_SQL + """, c AS (SELECT feature, objective, coalesce(['Y', 'C', '?', 'N'][min(r) FILTER (effect <> 'opposes') + 1], '-') || CASE WHEN count(*) FILTER (effect = 'opposes' AND r <= 1) > 0 THEN '!' ELSE '' END AS cell FROM s GROUP BY ALL)
 SELECT n.feature, coalesce(max(cell) FILTER (objective = 'plan'), '-') AS plan, coalesce(max(cell) FILTER (objective = 'learn'), '-') AS learn FROM (VALUES ('f1'), ('f2'), ('f3')) n(feature) LEFT JOIN c USING (feature) GROUP BY n.feature""")
def ledger_feature_matrix(spark, sf_dir):
    a, f, o = _ledger(spark)
    by = ledger.feature_status(f, ledger.finding_status(f, o, ledger.holds(a, o)))
    return ledger.feature_matrix(spark.sql("SELECT * FROM VALUES ('f1'), ('f2'), ('f3') t(id)"), by, ["plan", "learn"])


@query(_LEDGER_SQL + " SELECT 'A2' AS assumption, 'plan' AS objective, (SELECT count(*) FROM f WHERE list_contains(aa, 'A2')) AS findings")
def ledger_todo(spark, sf_dir):
    a, f, o = _ledger(spark)
    return ledger.open_cells(a, f)


@query("SELECT o_orderkey, CASE WHEN d = 0 THEN 'Due today' WHEN d = 1 THEN 'Due tomorrow' WHEN d > 1 THEN 'Due in ' || d || ' days' WHEN d = -1 THEN 'Overdue by 1 day' ELSE 'Overdue by ' || -d || ' days' END AS wording, CAST(round_even(greatest(0, least(1, (o_orderkey % 150 - 20) / 100.0)) * 37, 0) AS INTEGER) AS k FROM (SELECT o_orderkey, date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)")
def due_and_dial(spark, sf_dir):
    """Wording of due dates on a fixed day, and dial positions as steps."""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", zoom.due_wording(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1996-01-01").cast("date")).alias("wording"), zoom.k_for_z((F.col("o_orderkey") % 150 - 20) / 100, F.lit(37)).alias("k"))


@query(rf"""WITH RECURSIVE {LEAVES}, s AS (SELECT doc_id, leaf_no, unnest(range(0, len(p))) AS pos, unnest(p) AS s FROM (SELECT *, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM leaves)),
t AS (SELECT *, regexp_replace({_STRIP('s')}, '^[-*]+\s*', '') AS x FROM s)
SELECT doc_id AS tree_id, CAST(leaf_no AS INTEGER) AS leaf_id, CAST(pos AS INTEGER) AS pos, nullif(regexp_extract(x, '{claims.ACTION}', 1), '') AS who, regexp_replace({_STRIP(f"regexp_extract(x, '{claims.ACTION}', 2)")}, '[.]+$', '') AS what,
  nullif(regexp_extract(x, '{claims.ACTION}', 3), '') AS due, {overview_queries.iso(f"regexp_extract(x, '{claims.ACTION}', 3)")} AS due_iso FROM t WHERE regexp_matches(x, '{claims.ACTION}')""")
def doc_actions(spark, sf_dir):
    """Sentences of all leaves that say who is to do what."""
    x = chunk_leaves(_t(spark, sf_dir, "documents")).select(F.col("doc_id").alias("tree_id"), F.col("leaf_no").alias("leaf_id"), "text")
    return claims.extract_actions(x).drop("cites")
