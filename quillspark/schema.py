"""The stored tables: columns, keys and checked values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import SYNTAX_FAMILIES

#: Table: (schema, key columns).
TABLES = {
    "prompts": ("id bigint, identifier string, concept string, status string, metadata string, created_at timestamp, updated_at timestamp", ["identifier"]),
    "prompt_style_profiles": ("id bigint, identifier string, syntax_family string, negative_prompt_strategy string, ordering_notes string, metadata string, created_at timestamp", ["identifier"]),
    "prompt_templates": ("id bigint, prompt_id bigint, style_profile_id bigint, positive_template string, negative_template string, enabled boolean, notes string, created_at timestamp, updated_at timestamp", ["prompt_id", "style_profile_id"]),
    "wildcard_definitions": ("id bigint, wildcard_key string, status string, notes string, metadata string, created_at timestamp, updated_at timestamp", ["wildcard_key"]),
    "wildcard_values": ("id bigint, wildcard_definition_id bigint, value string, weight double, notes string, created_at timestamp", ["wildcard_definition_id", "value"]),
    "prompt_wildcard_bindings": ("id bigint, prompt_id bigint, wildcard_definition_id bigint, required boolean, default_strategy string", ["prompt_id", "wildcard_definition_id"]),
    "prompt_versions": ("id bigint, prompt_id bigint, version int, change_type string, changed_by string, change_reason string, diff_summary string, created_at timestamp", ["id"]),
    "prompt_template_versions": ("id bigint, template_id bigint, version int, positive_template string, negative_template string, change_type string, changed_by string, created_at timestamp", ["id"]),
    "prompt_sets": ("id bigint, name string, description string, status string, tags array<string>, metadata string, created_at timestamp", ["name"]),
    "prompt_set_members": ("set_id bigint, prompt_id bigint, position int, enabled boolean", ["set_id", "prompt_id"]),
    "style_generation_jobs": ("id bigint, prompt_id bigint, style_profile_id bigint, source_template_id bigint, task_payload string, response_payload string, status string, error_log string, attempt_count int, completed_at timestamp", ["prompt_id", "style_profile_id"]),
    "imports": ("id bigint, source_file string, status string, rows_imported bigint, rows_skipped bigint, error_log string, started_at timestamp, completed_at timestamp", ["id"]),
    "exports": ("id bigint, output_file string, format string, rows_exported bigint, created_at timestamp", ["id"]),
}
#: Values a column may hold.
ALLOWED = {
    ("prompts", "status"): ["draft", "active", "deprecated", "archived"],
    ("prompt_style_profiles", "syntax_family"): SYNTAX_FAMILIES,
    ("wildcard_definitions", "status"): ["active", "deprecated", "archived"],
    ("prompt_sets", "status"): ["active", "archived"],
    ("style_generation_jobs", "status"): ["pending", "running", "completed", "failed", "skipped"],
}


def violation(table: str) -> Column:
    """What is wrong with a row of a table, null if nothing."""
    out = F.lit(None).cast("string")
    for (t, c), values in ALLOWED.items():
        if t == table:
            out = F.coalesce(out, F.when(F.col(c).isNull() | ~F.col(c).isin(values), F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit("null")))))
    return out


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with a reason)."""
    marked = df.withColumn("reason", violation(table))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys of a table that occur more than once."""
    return df.groupBy(*TABLES[table][1]).count().where("count > 1")
