"""Mining a vocabulary from text, and writing placeholders where its words stand."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.categories import CATEGORIES
from quillspark.functions.text import normalise_term, strip

#: Categories whose words are replaced in negative templates only. Fixed value.
NEGATIVE_ONLY = {"style_negative"}


def text_sources(templates: DataFrame, prompts: DataFrame) -> DataFrame:
    """(text) of enabled positive templates, all negative ones, and the original prompt and labelled fields in the
    prompts' metadata; metadata that is no JSON gives nothing."""
    positive = templates.where("enabled and positive <> ''").select(F.col("positive").alias("text"))
    negative = templates.where("negative is not null and negative <> ''").select(F.col("negative").alias("text"))
    meta = prompts.where("metadata is not null and metadata <> '{}'").select(F.from_json("metadata", "original_prompt string, structured_fields map<string,string>").alias("m"))
    original = meta.where("m.original_prompt <> ''").select(F.col("m.original_prompt").alias("text"))
    fields = meta.select(F.explode(F.map_values("m.structured_fields")).alias("text"))
    return positive.unionByName(negative).unionByName(original).unionByName(fields)


def term_counts(texts: DataFrame, categories: dict[str, list[str]] | None = None, at_least: int = 2) -> DataFrame:
    """(category, term, n): matches of every pattern of every category over all texts, terms of more than two letters found
    so often. Equal texts are searched once and count as often as they occur; one projection finds all, and counts are
    combined before the shuffle."""
    found = [_tagged(F.col("low"), p, c) for c, patterns in (categories or CATEGORIES).items() for p in patterns]
    each = texts.where("text is not null").groupBy(F.lower("text").alias("low")).agg(F.count("*").alias("times"))
    each = each.select("times", F.explode(F.flatten(F.array(*found))).alias("f")).select("f.category", "f.term", "times")
    return each.where(F.length("term") > 2).groupBy("category", "term").agg(F.sum("times").alias("n")).where(F.col("n") >= at_least)


def _tagged(low: Column, pattern: str, category: str) -> Column:
    """What a pattern finds; it is tried only where one of the letters that its alternatives begin with occurs."""
    found = F.transform(F.regexp_extract_all(low, F.lit("(?U)" + pattern), 0), lambda x: F.struct(F.lit(category).alias("category"), strip(x).alias("term")))
    heads = beginnings(pattern)
    if not heads:
        return found
    there = low.contains(heads[0])
    for h in heads[1:]:
        there = there | low.contains(h)
    return F.when(there, found).otherwise(F.array().cast("array<struct<category:string,term:string>>"))


def beginnings(pattern: str) -> list[str]:
    """The letters that every match of a pattern `\\b(one|two|...)\\b` begins with one of; empty if some alternative begins
    otherwise, or the pattern is of another form."""
    if not (pattern.startswith(r"\b(") and pattern.endswith(r")\b")):
        return []
    body, depth, parts = pattern[3:-3], 0, [""]
    for k, c in enumerate(body):
        inside = k and body[k - 1] == "\\"
        depth += (c in "([") * (not inside) - (c in ")]") * (not inside)
        if depth < 0:
            return []
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    heads = [re.match(r"(?:[\w\- ](?![?*{]))*", p)[0] for p in parts]
    heads = sorted({h for h in heads})
    if "" in heads:
        return []
    return [h for h in heads if not any(h != o and o in h for o in heads)]


def vocabulary(counts: DataFrame) -> DataFrame:
    """(category, term, n, weight): terms after normalising, of those that fall together the larger count; a fifth of the
    count as weight, 2 at most."""
    n = counts.select("category", normalise_term(F.col("term")).alias("term"), "n").groupBy("category", "term").agg(F.max("n").alias("n"))
    return n.withColumn("weight", F.round(F.least(F.col("n") / 5.0, F.lit(2.0)), 2))


def top_terms(vocab: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent terms of each category, ties by term."""
    r = F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "term"))
    return vocab.withColumn("rank", r).where(F.col("rank") <= k)


def grouped_values(definitions: DataFrame, values: DataFrame) -> DataFrame:
    """(wildcard_key, values): the sorted values of every active definition."""
    v = values.join(definitions.where("status = 'active'"), "definition_id")
    return v.groupBy("wildcard_key").agg(F.sort_array(F.collect_set("value")).alias("values"))


class Rewriter:
    """Replaces values in text by the placeholder of their key, the longest first. Only values of several words take part;
    of a value in two keys the later key in order holds; neighbouring hits of one key become one.

    Values are looked up in a dictionary at the starts of words, by how long values with the same first letters are, so time
    does not grow with the vocabulary."""

    def __init__(self, pairs: list[tuple[str, str]], negative: bool = False) -> None:
        kept = [(v, k) for v, k in pairs if (" " in v or "-" in v) and (negative or k not in NEGATIVE_ONLY)]
        self.keys = {_low(v): k for v, k in sorted(kept, key=lambda x: x[1])}
        self.lengths: dict[str, list[int]] = {}
        for v in self.keys:
            self.lengths.setdefault(v[:3], []).append(len(v))
        self.lengths = {head: sorted(set(n), reverse=True) for head, n in self.lengths.items()}

    def hits(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, key) of the values in a text, leftmost first, of those that begin alike the longest."""
        low, edges, done = _low(text), [m.start() for m in _EDGE.finditer(text)], 0
        ends = set(edges)
        for s in edges:
            if s < done:
                continue
            for n in self.lengths.get(low[s : s + 3], ()):
                if s + n in ends and (key := self.keys.get(low[s : s + n])):
                    yield s, s + n, key
                    done = s + n
                    break

    def __call__(self, text: str | None) -> tuple[str | None, list[str]]:
        if not text or not self.keys:
            return text, []
        out, used, last, end = [], set(), None, 0
        for s, e, key in self.hits(text):
            between, end = text[end:s], e
            if key == last and not between.strip():
                continue
            out += [between, "{" + key + "}"]
            used.add(key)
            last = key
        return "".join([*out, text[end:]]), sorted(used)


_EDGE = re.compile(r"\b")


def _low(text: str) -> str:
    """Lower case, letter by letter, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def retrofit(templates: DataFrame, definitions: DataFrame, values: DataFrame, most_values: int = 1_000_000) -> DataFrame:
    """(template_id, prompt_id, positive, negative, keys) of templates after rewriting. Every worker holds the vocabulary, so
    its size is checked: more than most_values values raise an error."""
    v = values.join(definitions.where("status = 'active'"), "definition_id").select("value", "wildcard_key").distinct()
    pairs = sorted((r[0], r[1]) for r in v.limit(most_values + 1).collect())
    if len(pairs) > most_values:
        raise ValueError(f"more than {most_values} values: rewrite category by category")
    shared = templates.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        positive, negative = Rewriter(shared.value), Rewriter(shared.value, negative=True)
        for b in batches:
            p, n = [positive(t) for t in b["positive"]], [negative(t) for t in b["negative"]]
            yield pd.DataFrame({"template_id": b["template_id"], "prompt_id": b["prompt_id"], "positive": [x for x, _ in p], "negative": [x for x, _ in n], "keys": [sorted({*a, *c}) for (_, a), (_, c) in zip(p, n)]})

    return templates.where("enabled").select("template_id", "prompt_id", "positive", "negative").mapInPandas(run, "template_id bigint, prompt_id bigint, positive string, negative string, keys array<string>")


def new_bindings(rewritten: DataFrame, definitions: DataFrame, bindings: DataFrame) -> DataFrame:
    """(prompt_id, definition_id) for keys that rewriting brought in and that are not bound yet."""
    k = rewritten.select("prompt_id", F.explode("keys").alias("wildcard_key")).distinct().join(definitions, "wildcard_key")
    return k.select("prompt_id", "definition_id").join(bindings.select("prompt_id", "definition_id"), ["prompt_id", "definition_id"], "left_anti")
