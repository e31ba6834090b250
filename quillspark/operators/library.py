"""Listing, searching, validating and comparing a template library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalise_key, placeholder_keys

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(c: Column) -> Column:
    """Letters A to Z in lower case, all else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def list_prompts(prompts: DataFrame, status: str | None = None) -> DataFrame:
    """(identifier, concept, status) by identifier."""
    p = prompts if status is None else prompts.where(F.col("status") == status)
    return p.select("identifier", "concept", "status").orderBy("identifier")


def list_wildcards(definitions: DataFrame, values: DataFrame) -> DataFrame:
    """(wildcard_key, status, n_values) of every definition, also of those without values."""
    n = values.groupBy("definition_id").agg(F.count("*").alias("n_values"))
    return definitions.join(n, "definition_id", "left").select("wildcard_key", "status", F.coalesce("n_values", F.lit(0)).alias("n_values"))


def search(prompts: DataFrame, query: str) -> DataFrame:
    """(identifier, concept, status) where query occurs in concept or identifier; % and _ in it are wild, and only ASCII
    letters match in either case."""
    like = lambda c: fold_ascii(F.coalesce(c, F.lit(""))).like("%" + query.translate(str.maketrans(_UPPER, _LOWER)) + "%")
    return prompts.where(like(F.col("concept")) | like(F.col("identifier"))).select("identifier", "concept", "status")


def unbound_keys(templates: DataFrame, bindings: DataFrame) -> DataFrame:
    """(template_id, prompt_id, missing): enabled templates that use keys not bound to their prompt."""
    bound = bindings.groupBy("prompt_id").agg(F.collect_set("wildcard_key").alias("bound"))
    used = templates.where("enabled").select("template_id", "prompt_id", placeholder_keys(F.col("positive"), keep_concept=False).alias("used")).where(F.size("used") > 0)
    missing = F.sort_array(F.array_except("used", F.coalesce("bound", F.array().cast("array<string>"))))
    return used.join(bound, "prompt_id", "left").select("template_id", "prompt_id", missing.alias("missing")).where(F.size("missing") > 0)


def diff_prompts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(identifier, action): updated if it is stored, changed or not, else new."""
    there = stored.select("identifier").distinct().withColumn("_there", F.lit(True))
    return incoming.select("identifier").distinct().join(there, "identifier", "left").select("identifier", F.when(F.col("_there"), "updated").otherwise("new").alias("action"))


def diff_keys(incoming: DataFrame, definitions: DataFrame) -> DataFrame:
    """(wildcard_key, action) for incoming raw keys after normalising."""
    there = definitions.select("wildcard_key").distinct().withColumn("_there", F.lit(True))
    keys = incoming.select(normalise_key(F.col("raw")).alias("wildcard_key")).distinct()
    return keys.join(there, "wildcard_key", "left").select("wildcard_key", F.when(F.col("_there"), "existing").otherwise("new").alias("action"))


def in_set(prompts: DataFrame, members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Active prompts that are an enabled member of the named set."""
    m = members.where("enabled").join(sets.where(F.col("name") == name).select("set_id"), "set_id", "left_semi")
    return prompts.where(F.col("status") == "active").join(m.select(F.col("prompt_id").alias("id")), "id", "left_semi")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose reference has no parent; null references are none."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")
