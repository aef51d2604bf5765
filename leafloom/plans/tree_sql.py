"""SQL that builds the passages and summary trees of the documents table, for the twins of the tree queries.

It states the rules for texts such as the tables hold: no blank lines, headings, fences, tables, procedures or CJK text; display
maths is set apart. Levels are written out up to LEVELS, enough for two million leaves.
"""

from __future__ import annotations

from leafloom.functions import chunking, units
from leafloom.operators import tree

LEVELS = 12
_W = units.WHITE
_ABBREVIATIONS = ", ".join(f"'{x}'" for x in sorted(chunking.ABBREVIATIONS))
_MOST = chunking.LEAF_WORDS


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '{units.WORD}')"


_FITS = f"""CASE WHEN @ + {_MOST} >= n THEN n ELSE coalesce(list_max([e FOR e IN sentences IF e > @ AND e <= @ + {_MOST}]),
  list_max([e FOR e IN clauses IF e > @ AND e <= @ + {_MOST}]), @ + {_MOST}) END"""

#: leaves(doc_id, leaf_no, words, span_start, span_end, atomic, text)
LEAVES = f"""docs AS (SELECT doc_id, {strip('text')} AS bare, len({words('text')}) AS n FROM documents),
split_ AS (SELECT doc_id, string_split(regexp_replace(bare, '(?s)\\$\\$.*?\\$\\$', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM docs WHERE n > {chunking.TINY_WORDS}),
parts AS (SELECT doc_id, k, coalesce(list_sum([length(x) FOR x IN parts[1 : k - 1]]), 0) AS at_, {strip('parts[k]')} AS part, k % 2 = 0 AS atomic FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM split_)),
told AS (SELECT *, len({words('part')}) AS n FROM parts WHERE part <> ''),
long_ AS (SELECT doc_id, k, unnest({words('part')}) AS word, unnest(regexp_extract_all(part, '[{_W}]+')) AS gap, unnest(range(1, n + 1)) AS i FROM told WHERE n > {_MOST} AND NOT atomic),
placed AS (SELECT *, coalesce(sum(length(word) + coalesce(length(gap), 0)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_,
  substr(coalesce(lead(word) OVER (PARTITION BY doc_id, k ORDER BY i), ' '), 1, 1) AS after_, regexp_replace(word, '["'')\\]”’]+$', '') AS core FROM long_),
marked AS (SELECT *, CASE WHEN after_ IN ('”', '’', '」', '』', '）', '】', '〕', '〉', '》', '］', '｝') THEN 0
  WHEN right(core, 1) IN ('.', '!', '?') AND NOT regexp_matches(after_, '\\p{{Ll}}') AND lower(core) NOT IN ({_ABBREVIATIONS}) AND NOT regexp_full_match(lower(core), '[0-9]{{1,3}}[.]|[a-z][.]') THEN 2
  WHEN right(core, 1) IN (',', ';', ':') AND regexp_matches(after_, '\\p{{Ll}}') THEN 1 ELSE 0 END AS mark FROM placed),
ends AS (SELECT doc_id, k, max(i) AS n, coalesce(list(i) FILTER (mark = 2), []) AS sentences, coalesce(list(i) FILTER (mark = 1), []) AS clauses FROM marked GROUP BY doc_id, k),
cuts(doc_id, k, a, b) AS (SELECT doc_id, k, CAST(0 AS BIGINT), CAST({_FITS.replace('@', '0')} AS BIGINT) FROM ends
  UNION ALL SELECT c.doc_id, c.k, c.b, CAST({_FITS.replace('@', 'c.b')} AS BIGINT) FROM cuts c JOIN ends e ON c.doc_id = e.doc_id AND c.k = e.k WHERE c.b < n),
pieces AS (SELECT c.doc_id, c.k, c.a, c.b - c.a AS n, t.at_ + x.at_ AS s, t.at_ + y.at_ + length(y.word) AS e, substr(t.part, CAST(x.at_ + 1 AS BIGINT), CAST(y.at_ + length(y.word) - x.at_ AS BIGINT)) AS piece, false AS atomic
  FROM cuts c JOIN told t ON c.doc_id = t.doc_id AND c.k = t.k JOIN marked x ON x.doc_id = c.doc_id AND x.k = c.k AND x.i = c.a + 1 JOIN marked y ON y.doc_id = c.doc_id AND y.k = c.k AND y.i = c.b
  UNION ALL SELECT doc_id, k, 0, n, at_, at_ + length(part), part, atomic FROM told WHERE atomic OR n <= {_MOST}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, a) AS r FROM pieces),
packed(doc_id, r, pack, held, atomic) AS (SELECT doc_id, r, CAST(1 AS BIGINT), CAST(n AS BIGINT), atomic FROM ranked WHERE r = 1
  UNION ALL SELECT p.doc_id, q.r, CASE WHEN q.atomic OR p.atomic OR p.held + q.n > {_MOST} THEN p.pack + 1 ELSE p.pack END, CAST(CASE WHEN q.atomic OR p.atomic OR p.held + q.n > {_MOST} THEN q.n ELSE p.held + q.n END AS BIGINT), q.atomic
  FROM packed p JOIN ranked q ON p.doc_id = q.doc_id AND q.r = p.r + 1),
leaves AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pack) - 1 AS leaf_no, n AS words, s AS span_start, e AS span_end, atomic, text FROM (
    SELECT p.doc_id, p.pack, sum(r.n) AS n, min(r.s) AS s, arg_max(r.e, r.r) AS e, bool_or(r.atomic) AS atomic, string_agg(r.piece, chr(10) || chr(10) ORDER BY r.r) AS text FROM packed p JOIN ranked r ON p.doc_id = r.doc_id AND p.r = r.r GROUP BY p.doc_id, p.pack)
  UNION ALL SELECT doc_id, 0, n, 0, length(bare), false, bare FROM docs WHERE n <= {chunking.TINY_WORDS})"""


def _level(k: int) -> str:
    below = "l0" if k == 1 else f"l{k - 1}"
    going = f"SELECT doc_id FROM {below} GROUP BY doc_id HAVING count(*) > 1 OR {'min(total) > ' + str(chunking.TINY_WORDS) if k == 1 else 'min(words) > ' + str(tree.GIST_STOP)}"
    return f"""g{k} AS (SELECT x.*, least(pos // 3, greatest(0, CAST(ceil((count(*) OVER (PARTITION BY doc_id) - 6) / 3.0) AS BIGINT))) AS grp FROM {below} x WHERE doc_id IN ({going})),
l{k} AS (SELECT doc_id, total, grp AS pos, CAST(greatest(1, round_even(sum(words) / 3.0, 0)) AS BIGINT) AS target, least(400, CAST(greatest(1, round_even(sum(words) / 3.0, 0)) AS BIGINT)) AS words, min(span_start) AS span_start, max(span_end) AS span_end,
  flatten(list(told ORDER BY pos)) AS every, flatten(list(told ORDER BY pos))[1 : least(400, CAST(greatest(1, round_even(sum(words) / 3.0, 0)) AS BIGINT))] AS told FROM g{k} GROUP BY doc_id, total, grp)"""


_ALL = "\n  UNION ALL ".join(f"SELECT doc_id, {k} AS level, pos, words, span_start, span_end, told, every, target, count(*) OVER (PARTITION BY doc_id) AS wide FROM l{k}" for k in range(LEVELS + 1))

#: nodes(doc_id, level, pos, node_id, parent, depth, is_leaf, words, span_start, span_end, text, title, hook_words, target words, first six words told, points array), without the levels that a lone node passes through.
NODES = f"""{LEAVES},
l0 AS (SELECT doc_id, (SELECT n FROM docs d WHERE d.doc_id = v.doc_id) AS total, leaf_no AS pos, CAST(0 AS BIGINT) AS target, words, span_start, span_end, {words('text')} AS every, {words('text')} AS told FROM leaves v),
{",".join(chr(10) + _level(k) for k in range(1, LEVELS + 1))},
every_level AS ({_ALL}),
tops AS (SELECT doc_id, max(level) AS top FROM every_level GROUP BY doc_id),
kept AS (SELECT e.*, t.top FROM every_level e JOIN tops t ON e.doc_id = t.doc_id WHERE e.wide > 1 OR e.level IN (0, t.top)),
steps AS (SELECT doc_id, level, wide, lead(level) OVER (PARTITION BY doc_id ORDER BY level) AS next_, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) - 1 AS depth FROM (SELECT DISTINCT doc_id, level, wide FROM kept)),
name_ AS (SELECT k.*, s.depth, s.next_, 'n' || lpad(CAST(k.level AS VARCHAR), 2, '0') || '-' || lpad(CAST(k.pos AS VARCHAR), 6, '0') AS node_id,
  CASE WHEN s.next_ = k.top THEN 0 ELSE least(k.pos // 3, greatest(0, CAST(ceil((k.wide - 6) / 3.0) AS BIGINT))) END AS parent_pos FROM kept k JOIN steps s ON k.doc_id = s.doc_id AND k.level = s.level),
nodes AS (SELECT n.doc_id, n.level, n.pos, n.node_id, CASE WHEN n.next_ IS NOT NULL THEN 'n' || lpad(CAST(n.next_ AS VARCHAR), 2, '0') || '-' || lpad(CAST(n.parent_pos AS VARCHAR), 6, '0') END AS parent, n.depth, n.level = 0 AS is_leaf,
  n.words, n.span_start, n.span_end, CASE WHEN n.level = 0 THEN v.text ELSE array_to_string(n.told, ' ') END AS text,
  CASE WHEN n.level > 0 THEN array_to_string(n.every[1:5], ' ') END AS title, CASE WHEN n.level > 0 THEN least(15, len(n.every)) ELSE n.words END AS hook_words, n.target, n.every[1:6] AS six, CASE WHEN n.level = 0 THEN [] ELSE [x FOR x IN [array_to_string(n.every[1:4], ' '), array_to_string(n.every[5:8], ' ')] IF x <> ''] END AS points
  FROM name_ n LEFT JOIN leaves v ON n.level = 0 AND v.doc_id = n.doc_id AND v.leaf_no = n.pos)"""

#: up(doc_id, node_id, ancestor, distance): every node's ancestors, itself at 0.
UP = """up(doc_id, node_id, ancestor, distance) AS (SELECT doc_id, node_id, node_id, 0 FROM nodes
  UNION ALL SELECT u.doc_id, u.node_id, n.parent, u.distance + 1 FROM up u JOIN nodes n ON u.doc_id = n.doc_id AND u.ancestor = n.node_id WHERE n.parent IS NOT NULL)"""
#: sections(doc_id, node_id, section_no)
SECTIONS = """sections AS (SELECT n.doc_id, n.node_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.span_start, n.pos) AS section_no FROM nodes n
  JOIN (SELECT doc_id, min(depth) AS depth FROM (SELECT doc_id, depth FROM nodes WHERE depth >= 1 GROUP BY doc_id, depth HAVING count(*) >= 2) GROUP BY doc_id) f ON n.doc_id = f.doc_id AND n.depth = f.depth)"""


def with_nodes(select: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([NODES, *more])}\n{select}"
