"""Web pages to markdown, and markdown to blocks: chains of patterns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.units import strip

#: Elements that are no part of what a page says.
NO_CONTENT = ("head", "script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "button", "iframe")
#: What holds a page's content, best first.
CONTENT = ("article", "main", "body")
BLOCK_TAGS = "p|div|section|article|main|ul|ol|dl|dd|dt|table|blockquote|pre|figure|figcaption|hr"
#: Entities that are resolved; others stay as they are written.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}

#: (pattern, what is put there), in order; both engines read them alike.
DROPPED = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in NO_CONTENT) + r'|<div\b[^>]*class="(?:ad|ads|advert|banner|cookie|menu|sidebar)"[^>]*>.*?</div>'
MARKUP = (
    (r"[\r\n\t ]+", " "),
    *((rf"(?i)<h{k}\b[^>]*>", "\n\n" + "#" * k + " ") for k in range(1, 7)),
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\b[^>]*>|<tr\b[^>]*>", "\n"),
    (r"(?i)</t[dh]\s*>", " "),
    (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n\n"),
    (r"<[^>]*>", ""),
)
SQUEEZED = (("[  ]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"))


def html_markdown(html: Column) -> Column:
    """Headings, list items and paragraphs of a page's content as markdown; null and empty pages give an empty text.

    Content is the article, else main, else the body; menus, scripts, forms and footers go. Line breaks inside `pre` become blanks.
    """
    page = F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, " ")
    part = lambda t: F.nullif(F.regexp_extract(page, rf"(?is)<{t}\b[^>]*>(.*)</{t}\s*>", 1), F.lit(""))
    out = F.coalesce(*map(part, CONTENT), page)
    for rx, put in MARKUP:
        out = F.regexp_replace(out, rx, put)
    for name, put in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(put))
    for rx, put in SQUEEZED:
        out = F.regexp_replace(out, rx, put)
    return strip(out)


_NAMED = (r'(?is)<meta\b[^>]*property="og:title"[^>]*content="([^"]*)"', r"(?is)<title\b[^>]*>(.*?)</title\s*>", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>")


def html_title(html: Column) -> Column:
    """The page's title by its metadata, else its title element, else its first heading; null if it has none."""

    def found(rx: str) -> Column:
        t = F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), rx, 1), r"<[^>]*>", "")
        for name, put in ENTITIES.items():
            t = F.replace(t, F.lit(name), F.lit(put))
        return F.nullif(strip(F.regexp_replace(t, "[\\r\\n\\t  ]+", " ")), F.lit(""))

    return F.coalesce(*map(found, _NAMED))


# ---------------------------------------------------------------- blocks

HEADING, BULLET, NUMBER = r"^(#{1,6})\s+(.*)$", r"^\s*[-*+]\s+", r"^\s*\d{1,3}[.)]\s+"


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no from 1, kind, level, items): headings (h), runs of bullets (ul) or numbers (ol), and paragraphs (p).

    A heading stands alone; a blank line or a line of another kind ends a run. items holds the entries of a list, else one text.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)).alias("_at", "_line"))
    line = F.col("_line")
    kind = F.when(strip(line) == "", "").when(line.rlike(HEADING), "h").when(line.rlike(BULLET), "ul").when(line.rlike(NUMBER), "ol").otherwise("p")
    said = F.when(F.col("_kind") == "h", F.regexp_extract(line, HEADING, 2)).when(F.col("_kind") == "p", strip(line)).otherwise(F.regexp_replace(line, rf"{BULLET}|{NUMBER}", ""))
    order = Window.partitionBy(key).orderBy("_at")
    x = lines.withColumn("_kind", kind)
    starts = (F.col("_kind") == "h") | F.coalesce(F.lag("_kind").over(order) != F.col("_kind"), F.lit(True))
    x = x.withColumn("_new", (starts & (F.col("_kind") != "")).cast("int")).withColumn("block_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where("_kind <> ''").withColumns({"_said": said, "_level": F.length(F.regexp_extract(line, HEADING, 1))})
    got = x.groupBy(key, "block_no").agg(F.first("_kind").alias("kind"), F.max("_level").alias("level"), F.array_sort(F.collect_list(F.struct("_at", "_said"))).alias("_l"))
    every = F.transform("_l", lambda s: s["_said"])
    return got.select(key, F.col("block_no").cast("int").alias("block_no"), "kind", F.when(F.col("kind") == "h", F.col("level")).alias("level"), F.when(F.col("kind") == "p", F.array(F.array_join(every, " "))).otherwise(every).alias("items"))


# Fixed value: characters that a line must hold for two columns to be worth it.
MIN_CPL = 45


def column_plan(inner: Column, char: Column, gap: Column, pad: Column, most: Column | None = None, least: int = MIN_CPL) -> Column:
    """struct<two, cpl, cpl_two, cpl_one>: whether a page of that width takes two columns, and the characters of a line."""
    wide = lambda w: w if most is None else F.least(w, most)
    cpl = lambda w: F.when(char > 0, F.greatest(F.lit(0.0), (w - pad) / char)).otherwise(F.lit(99.0))
    two, one = cpl(wide((inner - gap) / 2)), cpl(wide(inner))
    return F.struct((two >= least).alias("two"), F.when(two >= least, two).otherwise(one).alias("cpl"), two.alias("cpl_two"), one.alias("cpl_one"))
