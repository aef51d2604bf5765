"""What a reader sees first: hints on the size and date of a job, the assembled overview, and what a summariser is asked."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions.chunking import word_count
from leafloom.functions.classify import is_task_like, valid_genre
from leafloom.functions.text import cap_chars, date_phrase, truncate_words
from leafloom.functions.units import head_words, strip

from .claims import overview_line
from .tree import Request, Summariser

# Words and characters of an overview's title and kind; share by which a summary may miss its length.
TITLE, KIND, LENGTH_TOLERANCE = (16, 200), (4, 40), 0.35
PROVISIONAL_WORDS, PROVISIONAL_HEADINGS = 3000, 30

# ---------------------------------------------------------------- hints from the passages

_SIZE, _DUE, _CLOCK = r"\b([0-9][0-9,]*)[- ]words?\b", r"(?i)\b(due|deadline)\b", r"(?i)\b([0-9]{1,2})(?::([0-9]{2}))?\s*(am|pm)\b"


def clock_time(c: Column) -> Column:
    """HH:MM of the first time with am or pm; null without one."""
    part = lambda k: F.regexp_extract(c, _CLOCK, k)
    hour = part(1).try_cast("int") % 12 + F.when(F.lower(part(3)) == "pm", 12).otherwise(0)
    return F.when(part(1) != "", F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.when(part(2) == "", "00").otherwise(part(2))))


def job_hints(leaves: DataFrame) -> DataFrame:
    """(tree_id, start_text, start_leaf, size_basis, size_leaf, due_iso, due_time, due_leaf) from passages (tree_id, leaf_id, text), leaf_id in reading order.

    The size is that of the first passage with a count of words, else the document's first five words stand for it. The date is the first
    of passages that speak of a deadline, else the first of all; without a year it stays MM-DD. One grouping, merged before it is moved.
    """
    t = F.coalesce("text", F.lit(""))
    size, date = F.regexp_extract(t, _SIZE, 1), date_phrase(t)
    x = leaves.select("tree_id", "leaf_id", t.alias("t"), size.alias("size"), date.alias("date"))
    leaf = F.col("leaf_id")
    due = F.struct((~F.col("t").rlike(_DUE)).alias("later"), leaf.alias("leaf"), F.col("date.iso").alias("iso"), clock_time(F.col("t")).alias("time"))
    got = x.groupBy("tree_id").agg(
        F.min(F.struct(leaf.alias("leaf"), head_words(F.col("t"), 8).alias("eight"), head_words(F.col("t"), 5).alias("five"))).alias("first"),
        F.min(F.when(F.col("size") != "", F.struct(leaf.alias("leaf"), "size"))).alias("sized"),
        F.min(F.when(F.col("date").isNotNull(), due)).alias("due"),
    )
    said = F.col("first.five") != ""
    return got.select(
        "tree_id", F.when(said, F.col("first.eight")).alias("start_text"), F.when(said, F.col("first.leaf")).alias("start_leaf"),
        F.when(F.col("sized").isNotNull(), F.concat(F.lit("a "), "sized.size", F.lit(" words limit"))).when(said, F.col("first.five")).alias("size_basis"),
        F.coalesce("sized.leaf", F.when(said, F.col("first.leaf"))).alias("size_leaf"), F.col("due.iso").alias("due_iso"), F.col("due.time").alias("due_time"), F.col("due.leaf").alias("due_leaf"),
    )


# ---------------------------------------------------------------- assembly


def assembled(raw: DataFrame, trees: DataFrame, essentials: DataFrame, starts: DataFrame, sizes: DataFrame, deadlines: DataFrame, actions: DataFrame) -> DataFrame:
    """One row for each tree with a title and a kind: (tree_id, genre, overview struct).

    raw (tree_id, doc_title, doc_kind, what_it_is, genre) is a reply; trees (tree_id, source_text, genre, objective). The others are claims
    that were checked already: essentials and actions with `place`, starts, sizes and deadlines with `claim_id` (the first counts).
    What starts a job, its size and deadline are shown for tasks only, actions for meetings only. A tree's genre stays; else the reply's
    counts if it is one, else `other`.
    """
    title, kind = strip(F.col("doc_title")), F.regexp_replace(strip(F.col("doc_kind")), "[.]+$", "")
    x = raw.withColumnRenamed("genre", "_said").join(trees, "tree_id").where((title != "") & (strip(F.col("doc_kind")) != ""))
    kind = cap_chars(truncate_words(kind, KIND[0]), KIND[1])
    x = x.select(
        "tree_id", cap_chars(truncate_words(title, TITLE[0]), TITLE[1]).alias("doc_title"), kind.alias("doc_kind"), overview_line(kind, F.col("what_it_is"), F.col("source_text")).alias("what_it_is"),
        F.coalesce("genre", valid_genre(F.col("_said")), F.lit("other")).alias("genre"), "objective",
    )

    def listed(items: DataFrame, name: str, *fields: str) -> DataFrame:
        got = items.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("_l"))  # a handful for each tree: the checks cap them
        return got.select("tree_id", F.transform("_l", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))

    def first(items: DataFrame, name: str, *fields: str) -> DataFrame:
        return items.groupBy("tree_id").agg(F.min_by(F.struct(*fields), "claim_id").alias(name))

    parts = (
        listed(essentials, "essentials", "label", "value", "cites"), listed(actions, "actions", "who", "what", "due", "due_iso", "cites"), first(starts, "start_here", "text", "cites"),
        first(sizes, "size_of_job", "text", "basis", "cites"), first(deadlines, "deadline", "iso", "time", "label", "cites"),
    )
    for p in parts:
        x = x.join(p, "tree_id", "left")
    task, none = is_task_like(F.col("genre"), F.col("objective")), lambda c: F.array().cast(x.schema[c].dataType)
    shown = [F.coalesce("essentials", none("essentials")).alias("essentials"), *[F.when(task, F.col(c)).alias(c) for c in ("start_here", "size_of_job", "deadline")]]
    meant = F.coalesce(F.when(F.col("genre") == "meeting", F.col("actions")), none("actions")).alias("actions")
    return x.select("tree_id", "genre", F.struct("doc_title", "doc_kind", "what_it_is", *shown, meant).alias("overview"))


# ---------------------------------------------------------------- what a summariser is asked

# The goals and kinds of documents, and the first line of each block. What follows says which of a node's fields matter there.
GOAL_FOCUS = {
    "execute": "Reader's goal: execute\nFill `steps`; put what would make the work fail into the key points.",
    "learn": "Reader's goal: learn\nLet key points explain each other; choose a key fact that surprises.",
    "decide": "Reader's goal: decide\nGive every option a key point of its own with its price.",
    "reference": "Reader's goal: reference\nPrefer titles that one would search for; keep values next to their names.",
    "plan": "Reader's goal: plan\nOrder key points by time; say what waits for what.",
    "communicate": "Reader's goal: communicate\nBegin with the question to be answered and its sender.",
}
GENRE_FOCUS = {
    "assignment": "Document genre: assignment\nThe key fact is a limit or a date; `steps` hold what is handed in.",
    "paper": "Document genre: paper\nThe key fact is the result, with its uncertainty beside it.",
    "news": "Document genre: news\nTie every statement to its source in the same key point.",
    "email": "Document genre: email\nThe title is the request; skip what only greets.",
    "meeting": "Document genre: meeting\nOne key point for each decision; people go into `steps` with what they took on.",
    "legal": "Document genre: legal\nNever trade a `must` for a `should`; conditions stay in the sentence they limit.",
    "technical": "Document genre: technical\nQuote names and commands unchanged; `steps` keep their order.",
    "article": "Document genre: article\nThe title is the claim, the key fact its evidence.",
}
FOCUS_TAIL = "\nNothing may be added that the parts do not say."


def with_focus(system: Column, goal: Column, genre: Column) -> Column:
    """A prompt with the blocks of the document's genre and the reader's goal after it, where they are known."""
    of = lambda blocks, c: F.element_at(F.create_map(*[F.lit(x) for k, v in blocks.items() for x in (k, v + FOCUS_TAIL)]), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n\n", system, of(GENRE_FOCUS, genre), of(GOAL_FOCUS, goal))


def provisional_prompt(title: Column, text: Column) -> Column:
    """What the quick first summary is made from: the title, the first words, and the lines that are headings."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), strip)
    heads = F.slice(F.filter(lines, lambda x: x.startswith("#")), 1, PROVISIONAL_HEADINGS)
    named = F.when(F.size(heads) > 0, F.concat(F.lit("\n\nHeadings:\n"), F.array_join(heads, "\n"))).otherwise("")
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), head_words(text, PROVISIONAL_WORDS), named)


class ReplyError(ValueError):
    """A model gave no JSON, twice."""


def _reply(said: str | None) -> dict | None:
    """The JSON object in a reply, with or without a fence around it or words before and after."""
    found = re.search(r"\{.*\}", said or "", re.DOTALL)
    try:
        got = json.loads(found[0], parse_constant=lambda _: None) if found else None  # NaN and infinities say nothing
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


#: Characters and entries of any one value of a reply that travel on: far more than a field may keep, and a bound on what a model can make us carry.
CARRIED_CHARS, CARRIED_ITEMS = 4_000, 1_000


def _carried(v, depth: int = 0):
    # strings are cut where they lie in lists and objects, as most values are strings
    if isinstance(v, str):
        return v[:CARRIED_CHARS]
    if isinstance(v, list):
        return [x[:CARRIED_CHARS] if type(x) is str else _carried(x, depth + 1) for x in v[:CARRIED_ITEMS]] if depth < 3 else None
    if isinstance(v, dict):
        return {str(k)[:100]: x[:CARRIED_CHARS] if type(x) is str else _carried(x, depth + 1) for k, x in islice(v.items(), CARRIED_ITEMS)} if depth < 3 else None
    return v


def asking(ask: Callable[[str, str], str | None], system: str = "") -> Summariser:
    """A summariser for build_trees() from a function (prompt, system) -> reply.

    The prompt names every part and every citable passage by its id (Request.prompt). A reply that is no JSON is asked for once more, then the
    build fails with ReplyError; a summary that misses its length by more than LENGTH_TOLERANCE is asked for once more and taken as it comes.
    Only text and cites are used while the tree is built; the other fields travel in `reply` and are read by replies.told().
    """

    def summarise(request: list[str], target: int) -> dict:
        body = request.prompt() if isinstance(request, Request) else "\n\n".join(request)
        prompt = f"Target length: about {target} words\n\n{body}"
        got = _reply(ask(prompt, system))
        if got is None:
            got = _reply(ask(prompt + "\n\nThat was no valid JSON. Answer with one JSON object and nothing else.", system))
        if got is None:
            raise ReplyError("the model gave no usable reply, even when asked again")
        text = got["text"].strip() if isinstance(got.get("text"), str) else ""
        n = word_count(text)
        if target > 0 and n > 0 and abs(n - target) / target > LENGTH_TOLERANCE:
            again = _reply(ask(f"{prompt}\n\nThat had {n} words; come closer to {target} ({target - n:+d}).", system))
            if again is not None:
                retold = again["text"].strip() if isinstance(again.get("text"), str) else ""
                got, text = again, retold or text
        cites = got["cites"] if isinstance(got.get("cites"), list) else []
        return {"text": text, "cites": [c for c in cites if isinstance(c, str)], "reply": _carried({k: v for k, v in got.items() if k not in ("text", "cites")})}

    return summarise
