"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of new batches with the earliest record they repeat."""
    from .history import check_new

    found = check_new(table(spark, sf_dir, "lexica_cleaned"), table(spark, sf_dir, "manifest"))
    return found.select("first_id", "record_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise found in scanned pages."""
    from .scan import defects

    return defects(table(spark, sf_dir, "inbox_pages"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    from .scan import repair

    return repair(table(spark, sf_dir, "inbox_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose two fields say the same as an earlier record's but for format."""
    from .formatdup import collapse

    found = collapse(table(spark, sf_dir, "lexica_cleaned"), "record_id", ["original_prompt", "positive_template"])
    return found.where("record_id <> first_id").select("first_id", "record_id").distinct()


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group of copies with the number of its copies."""
    from .formatdup import collapse

    found = collapse(table(spark, sf_dir, "lexica_cleaned"), "record_id", ["original_prompt", "positive_template"])
    return found.where("record_id = first_id").select("first_id", "copies").distinct()


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each varied set."""
    from .varied import fill_sets

    return fill_sets(table(spark, sf_dir, "lexica_cleaned"), table(spark, sf_dir, "prompt_sets"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subjects import assign

    return assign(table(spark, sf_dir, "lexica_cleaned"), table(spark, sf_dir, "subject_labels"), "record_id", ["positive_template", "concept"], table(spark, sf_dir, "subject_areas"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of every record."""
    return _subjects(spark, sf_dir)


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each subject in the corpus."""
    from .subjects import composition

    return composition(table(spark, sf_dir, "lexica_cleaned"), _subjects(spark, sf_dir), "record_id", "positive_template")


def _content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are scored for content: (table_name, record_id, source, text)."""
    a = table(spark, sf_dir, "lexica_cleaned").select(
        F.lit("lexica_cleaned").alias("table_name"), "record_id", F.col("original_source").alias("source"), F.col("positive_template").alias("text")
    )
    b = table(spark, sf_dir, "civitai_rejected").select(
        F.lit("civitai_rejected").alias("table_name"), F.col("rejected_id").alias("record_id"), F.col("original_source").alias("source"), F.col("original_prompt").alias("text")
    )
    return a.unionByName(b)


def _content_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .abuse import fit_on, score

    texts = _content_texts(spark, sf_dir)
    return texts, score(texts, fit_on(table(spark, sf_dir, "content_labels"), texts))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts flagged as abusive, hateful or sexual."""
    return _content_scores(spark, sf_dir)[1].where("flagged").select("table_name", "record_id", "category").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each source are flagged."""
    from .abuse import rates

    return rates(*_content_scores(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    from .leak import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for each mix and how often each is taken."""
    from .mixture import apportion

    return apportion(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source in each mix, wanted and reached."""
    from .mixture import apportion

    return apportion(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))[1]


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that is longer than a limit."""
    from .split import pieces

    return pieces(table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_limits"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict:
    from . import sql

    return {"p1_found": sql.P1_FOUND, "p3_found": sql.P3_FOUND, "p3_copies": sql.P3_COPIES}
