"""Rendering templates: a seeded weighted choice for each wildcard, then substitution; all prompts at once.

With a seed every wildcard is chosen by the first number of a generator started anew with that seed, so all share one
number u: the choice is the first value, by id, whose running weight exceeds u times the total.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import substitute


def choose_values(definitions: DataFrame, values: DataFrame, u: float | Column) -> DataFrame:
    """(definition_id, wildcard_key, value) chosen for every active definition with values; null weights count as 1, and
    where all weights are 0 there is no choice."""
    active = definitions.where(F.col("status") == "active").select("definition_id", "wildcard_key")
    v = values.select("definition_id", "value_id", "value", F.coalesce("weight", F.lit(1.0)).alias("weight")).join(active, "definition_id")
    line = W.partitionBy("definition_id").orderBy("value_id")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = v.withColumn("run", F.sum("weight").over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("weight").over(whole))
    point = (F.lit(u) if isinstance(u, float) else u) * F.col("total")
    first = F.min(F.when(F.col("run") > point, F.struct("value_id", "value")))
    picked = v.where("total > 0").groupBy("definition_id", "wildcard_key").agg(F.coalesce(first, F.max(F.struct("value_id", "value"))).alias("p"))
    return picked.select("definition_id", "wildcard_key", F.col("p.value").alias("value"))


def render(prompts: DataFrame, templates: DataFrame, profiles: DataFrame, bindings: DataFrame, definitions: DataFrame, values: DataFrame, seed: int, style: str | None = None, all_styles: bool = False, overrides: dict[str, str] | None = None) -> DataFrame:
    """(id, style, positive_prompt, negative_prompt, chosen) of every prompt.

    style: the named style's template, even a disabled one; all_styles: every enabled template; else the enabled template
    with the first syntax family, the smallest template id among equals. Overrides hold for bound keys only. Keys are filled in the order
    of their definitions, the concept last."""
    picked = choose_values(definitions, values, random.Random(seed).random())
    bound = bindings.join(picked.select("definition_id", "value"), "definition_id", "left")
    if overrides:
        given = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        bound = bound.withColumn("value", F.coalesce(F.try_element_at(given, F.col("wildcard_key")), "value"))
    entry = F.struct("definition_id", F.col("wildcard_key").alias("key"), "value")
    per_prompt = bound.where("value is not null").groupBy(F.col("prompt_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    t = templates.join(profiles, "style_id").select("template_id", F.col("prompt_id").alias("id"), "style", "syntax_family", "positive", "negative", "enabled")
    if style is not None:
        t = t.where(F.col("style") == style)
    else:
        t = t.where("enabled")
        if not all_styles:
            first = F.row_number().over(W.partitionBy("id").orderBy("syntax_family", "template_id"))
            t = t.withColumn("_n", first).where("_n = 1")
    own = F.struct(F.lit("concept").alias("key"), F.coalesce("concept", F.lit("None")).alias("value"))
    entries = F.concat(F.transform(F.coalesce("entries", F.array().cast("array<struct<definition_id:bigint,key:string,value:string>>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), F.array(own))
    b = t.join(prompts.select("id", "concept"), "id").join(per_prompt, "id", "left").withColumn("e", entries)
    chosen = F.array_join(F.transform(F.filter("e", lambda e: e["key"] != "concept"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return b.select("id", "style", substitute(F.col("positive"), F.col("e")).alias("positive_prompt"), substitute(F.coalesce("negative", F.lit("")), F.col("e")).alias("negative_prompt"), chosen.alias("chosen"))
