"""Registry of the core queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.functions import text as T
from quillspark.operators.evalset import top_per_domain
from quillspark.session import spread, table

from . import relational_queries, source_queries, text_queries

_PARTS = [text_queries.R, relational_queries.R, source_queries.R]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cleaned, rejected ones left out, scored, the best 50 of each domain: one scan and one shuffle.

    The cleaned text passes through a generator so that the optimiser does not write the whole chain into each of its
    many uses."""
    r = spread(table(spark, sf_dir, "lexica_cleaned").where("original_prompt is not null").select("record_id", "original_prompt", "wildcard_refs"))
    positive, _ = T.split_negative(F.col("original_prompt"))
    r = r.select("record_id", F.explode(F.array(T.clean_positive(positive))).alias("cleaned"), F.coalesce("wildcard_refs", F.array().cast("array<string>")).alias("keys"))
    r = r.where(T.reject_reason(F.col("cleaned")).isNull()).select("*", T.concept(F.col("cleaned")).alias("concept"))
    s = S.score_frame(r, F.concat_ws(" ", "concept", "cleaned"), F.col("keys")).where(F.col("score") >= S.LEAST_SCORE)
    s = s.select("record_id", "concept", "domain", F.round("score", 6).alias("score"))
    return top_per_domain(s, 50)


_FLAGSHIP = f"""WITH rec AS (SELECT record_id, wildcard_refs, original_prompt AS raw FROM lexica_cleaned WHERE original_prompt IS NOT NULL),
cc AS (SELECT record_id, wildcard_refs, {source_queries._chain("positive")} AS cleaned FROM (SELECT *, {source_queries._POSITIVE} AS positive FROM rec)),
ct AS (SELECT *, {source_queries._STRIP.format("cleaned")} AS t FROM cc),
clean AS (SELECT record_id, wildcard_refs, cleaned AS positive_template, {text_queries._CONCEPT.format("cleaned")} AS concept FROM ct WHERE ({text_queries._REASON}) IS NULL),
{text_queries.SCORED.replace("FROM lexica_cleaned", "FROM clean")}
SELECT * FROM (SELECT record_id, concept, domain, score, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, record_id) AS INT) AS rank FROM scored JOIN clean USING (record_id) WHERE score >= {S.LEAST_SCORE}) WHERE rank <= 50"""


def queries() -> dict:
    return {"flagship": flagship} | {k: f for r in _PARTS for k, f in r.queries.items()}


def oracle_sql() -> dict:
    return {"flagship": _FLAGSHIP} | {k: s for r in _PARTS for k, s in r.sql.items()}
