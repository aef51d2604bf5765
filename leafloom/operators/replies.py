"""A model's replies as fields of a tree's nodes: read as variants, each field kept only where it has the kind it should have, cut to its
caps. What it says of children and passages reaches them by their ids, where the tree is built. Whatever does not fit is left out; no reply fails a build."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text
from leafloom.functions.units import head_words, let, strip
from leafloom.sources.shared import written
from leafloom.sources.sinks import missing_short_titles

from . import claims, tree
from .overview import asking

_KIND = F.schema_of_variant
_VARIANTS = "map<string,variant>"


def _string(v: Column) -> Column:
    return F.when(_KIND(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _strings(v: Column) -> Column:
    """The strings of a list, in order; null where it is none."""
    return F.filter(F.transform(F.when(_KIND(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), _string), lambda x: x.isNotNull())


def _of_children(v: Column, children: Column) -> Column:
    """The entries of an object whose name is a child's id, as a map."""
    return F.map_filter(F.when(_KIND(v).startswith("OBJECT"), F.try_variant_get(v, "$", _VARIANTS)), lambda k, _: F.array_contains(children, k))


def _share(v: Column) -> Column:
    """A number, or a string that is one, brought to 0 to 1; null for anything else."""
    number = _KIND(v).isin("BIGINT", "DOUBLE", "FLOAT") | _KIND(v).startswith("DECIMAL")
    x = F.when(number, F.try_variant_get(v, "$", "double")).otherwise(_string(v).try_cast("double"))
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _said_as(v: Column, name: str, clean: Callable[[Column], Column]) -> Column:
    """A field of a reply that is text, made fit; null where it is none."""
    return clean(let(_at(v, name), _string))


def _key_fact(v: Column, cites: Column, source: Column) -> Column:
    """struct<big, detail, cites> of a reply's key fact, if it cites anything and its passages bear it out: see claims.fact_held()."""
    fact = F.struct(*[_said_as(v, f"key_fact.{c}", lambda x, c=c: claims.capped(x, c)).alias(c) for c in ("big", "detail")])
    whole = lambda f: f["big"].isNotNull() & f["detail"].isNotNull()
    told = lambda f: F.when(claims.fact_held(f["big"], f["detail"], source), F.struct(f["big"].alias("big"), f["detail"].alias("detail"), cites.alias("cites")))
    return F.when(F.size(cites) > 0, let(fact, lambda f: F.when(whole(f), told(f))))


#: Fields of nodes that come from replies alone, so that they need not leave Python.
FROM_REPLIES = ("title", "short_title", "hook", "key_points")


def told(nodes: DataFrame, fields: Sequence[str] = tree.NODE_FIELDS) -> DataFrame:
    """nodes of build_trees(replies=True) with the fields of their replies: title, short_title, hook, key_points, steps, key_fact; and, from
    their parent's reply, importance, title and short title. Of a node's fields only those named are told. What a node takes from others came with it, so nothing is joined.

    A leaf that took the place of a summary has its importance and, where it has none of its own, its titles. A key fact (struct big, detail,
    cites) must cite a passage that its prompt showed and stand in it.
    """
    said, of, was, was_of = (F.col(c) for c in ("_said", "_of", "_was", "_was_of"))
    x = nodes.withColumn("_reply", F.try_parse_json("reply"))
    x = x.withColumns({"_said": _at(F.col("_reply"), "own.said"), "_of": _at(F.col("_reply"), "of"), "_was": _at(F.col("_reply"), "before.said"), "_was_of": _at(F.col("_reply"), "before_of")}).drop("_reply", "reply")
    # what the parent says comes first; `_was` is null where no place was taken
    named = lambda mine, theirs, own, others, clean: F.coalesce(_said_as(theirs, others, clean), _said_as(mine, own, clean))
    none = lambda t: was_of.isNotNull() & (F.coalesce(t, F.lit("")) == "")
    titled = lambda *names: let(named(said, of, *names), lambda t: F.when(none(t), named(was, was_of, *names)).otherwise(t))
    rated = F.when(was_of.isNull(), let(_at(of, "importance"), _share)).otherwise(let(_at(was_of, "importance"), _share))
    made = {
        "importance": F.coalesce(rated, "importance"), "title": titled("title", "child_titles", text.clean_title), "short_title": titled("short_title", "child_short_titles", text.clean_short_title),
        "hook": _said_as(said, "hook", text.clean_hook), "key_points": text.clean_points(let(_at(said, "key_points"), _strings)), "steps": text.clean_steps(let(_at(said, "steps"), _strings)),
        "key_fact": _key_fact(said, F.col("fact_cites"), F.col("fact_source")),
    }
    return x.select("tree_id", *[made[f].alias(f) if f in made else F.col(f) for f in (*fields, "steps", "key_fact")])


def asked_trees(docs: DataFrame, ask: Callable[[str, str], str | None], system: str = "", id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = tree.NODE_FIELDS) -> DataFrame:
    """Trees of documents whose summaries a model makes, ask(prompt, system) -> reply: the columns of build_trees() with steps and key_fact.

    Only what `fields` names is kept of a node. The rows are written once, so that a model is asked once however often they are read.
    """
    built = [f for f in fields if f not in FROM_REPLIES]
    return written(told(tree.build_trees(docs, id_col, text_col, asking(ask, system), replies=True, fields=built), fields), "asked-nodes")


LABEL_SYSTEM = "Name each part below for a small map, in three words or fewer and at most 24 characters. Answer with one JSON object from id to name and nothing else."


def asked_labels(nodes: DataFrame, section_depth: DataFrame, ask: Callable[[str, str], str | None], limit: int = 400) -> DataFrame:
    """nodes (tree_id, node_id, doc_pos, depth, title, hook, text, short_title) with short titles where they had none: one request for each tree, for
    the first `limit` of its nodes from the section level down. section_depth (tree_id, depth).

    Names that are too long, empty or no text are dropped, and so are ids that were not asked for; a reply without JSON names nothing.
    """
    key = ["tree_id", "node_id"]
    asked = missing_short_titles(nodes, section_depth, limit).join(nodes.select(*key, "doc_pos", "title", "hook", "text"), key)
    squeeze = lambda c: F.regexp_replace(strip(c), "\\s+", " ")
    given = lambda a, b: F.when(F.coalesce(strip(F.col(a)), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    line = F.concat(F.lit("["), "node_id", F.lit("] "), head_words(given("title", "text"), 12), F.lit(": "), F.substring(squeeze(given("hook", "text")), 1, 140))
    prompts = asked.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("doc_pos", "node_id", line.alias("line")))).alias("l"))
    prompts = prompts.select("tree_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"), F.transform("l", lambda x: x["node_id"]).alias("ids"))
    kind = nodes.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tree_id": b["tree_id"], "ids": b["ids"], "reply": [ask(p, LABEL_SYSTEM) for p in b["prompt"]]})

    said = written(prompts.mapInPandas(run, f"tree_id {kind}, ids array<string>, reply string"), "labels")  # a model is asked once
    body = F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0))
    named = _of_children(F.coalesce(F.try_variant_get(body, "$.titles", "variant"), body), F.col("ids"))
    names = said.select("tree_id", F.explode(F.transform_values(named, lambda _, x: text.clean_short_title(_string(x)))).alias("node_id", "_name"))
    own = F.when(F.coalesce(F.col("short_title"), F.lit("")) != "", F.col("short_title"))
    return nodes.join(names.where("_name is not null"), key, "left").withColumn("short_title", F.coalesce(own, "_name")).drop("_name")
