"""The library's logical tables as views over the project's tables, for Spark and as common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import table

#: Which part type stands in for which wildcard key.
KEYS = {"MEDIUM": "lighting", "PROMO": "mood", "STANDARD": "camera", "ECONOMY": "subject", "LARGE": "style_modifier", "SMALL": "texture"}


class Library:
    """The tables of a template library."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def records(self) -> DataFrame:
        return self.t("lexica_cleaned")

    @property
    def prompts(self) -> DataFrame:
        return self.records.select(F.col("record_id").alias("id"), "identifier", "concept", F.lower("status").alias("status"), "metadata", "wildcard_refs")

    @property
    def profiles(self) -> DataFrame:
        return self.t("prompt_style_profiles").select(F.col("id").alias("style_id"), F.col("identifier").alias("style"), "syntax_family")

    @property
    def templates(self) -> DataFrame:
        """One template a record in its own style, for every third record one in the next style too. Templates carry
        placeholders for the record's references."""
        refs = F.array_join(F.transform("wildcard_refs", lambda r: F.concat(F.lit(" {"), r, F.lit("}"))), "")
        base = self.records.join(F.broadcast(self.profiles), "syntax_family").select(
            "record_id", "style_id", F.concat(F.coalesce("positive_template", F.lit("")), F.coalesce(refs, F.lit(""))).alias("positive"), F.coalesce("negative_template", F.lit("")).alias("negative")
        )
        own = base.select(F.col("record_id").alias("template_id"), F.col("record_id").alias("prompt_id"), "style_id", "positive", "negative", (F.col("record_id") % 7 != 0).alias("enabled"))
        other = base.where("record_id % 3 = 0").select((F.col("record_id") + 1_000_000_000).alias("template_id"), F.col("record_id").alias("prompt_id"), (F.col("style_id") % 8 + 1).alias("style_id"), "positive", F.lit("").alias("negative"), F.lit(True).alias("enabled"))
        return own.unionByName(other)

    @property
    def definitions(self) -> DataFrame:
        rows = [(i + 1, k, "deprecated" if k == "mood" else "active") for i, k in enumerate(KEYS.values())] + [(99, "unused", "active")]
        return self.spark.createDataFrame(rows, "definition_id bigint, wildcard_key string, status string")

    @property
    def values(self) -> DataFrame:
        """Distinct (definition, value), the first by part key."""
        keys = self.spark.createDataFrame(list(KEYS.items()), "p_type string, wildcard_key string")
        p = self.t("part").join(F.broadcast(keys), "p_type").join(F.broadcast(self.definitions), "wildcard_key")
        first = p.withColumn("n", F.row_number().over(W.partitionBy("definition_id", "p_name").orderBy("p_partkey"))).where("n = 1")
        return first.select(F.col("p_partkey").alias("value_id"), "definition_id", F.col("p_name").alias("value"), (F.col("p_size") / 10.0).alias("weight"))

    @property
    def bindings(self) -> DataFrame:
        each = self.records.select(F.col("record_id").alias("prompt_id"), F.explode("wildcard_refs").alias("wildcard_key")).distinct()
        return each.join(F.broadcast(self.definitions), "wildcard_key").select("prompt_id", "definition_id", "wildcard_key")


_KEY_ROWS = ", ".join(f"({i + 1}, '{t}', '{k}', '{'deprecated' if k == 'mood' else 'active'}')" for i, (t, k) in enumerate(KEYS.items()))
BASE = f"""
WITH key_rows(definition_id, p_type, wildcard_key, status) AS (VALUES {_KEY_ROWS}, (99, '-', 'unused', 'active')),
definitions AS (SELECT definition_id, wildcard_key, status FROM key_rows),
prompts AS (SELECT record_id AS id, identifier, concept, lower(status) AS status, metadata, wildcard_refs FROM lexica_cleaned),
profiles AS (SELECT id AS style_id, identifier AS style, syntax_family FROM prompt_style_profiles),
tbase AS (SELECT record_id, style_id,
  coalesce(positive_template, '') || coalesce(array_to_string(list_transform(wildcard_refs, lambda x: ' {{' || x || '}}'), ''), '') AS positive,
  coalesce(negative_template, '') AS negative FROM lexica_cleaned JOIN profiles USING (syntax_family)),
templates AS (SELECT record_id AS template_id, record_id AS prompt_id, style_id, positive, negative, record_id % 7 <> 0 AS enabled FROM tbase
  UNION ALL SELECT record_id + 1000000000, record_id, style_id % 8 + 1, positive, '', true FROM tbase WHERE record_id % 3 = 0),
wvalues AS (SELECT value_id, definition_id, value, weight FROM (SELECT p_partkey AS value_id, definition_id, p_name AS value, p_size / 10.0 AS weight,
  row_number() OVER (PARTITION BY definition_id, p_name ORDER BY p_partkey) AS n FROM part JOIN key_rows USING (p_type)) WHERE n = 1),
bindings AS (SELECT DISTINCT record_id AS prompt_id, definition_id, wildcard_key FROM (SELECT record_id, unnest(wildcard_refs) AS wildcard_key FROM lexica_cleaned) JOIN definitions USING (wildcard_key))
"""
