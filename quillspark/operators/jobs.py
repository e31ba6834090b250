"""Planning, building, checking and tracking jobs that fill missing (prompt, style) cells."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import placeholder_keys

# The order in which a source template is preferred.
PREFERRED = ["comma-separated", "kkwprompt-raw", "everyday-speech", "structured-fields", "enhanced-prompt", "lisp-like"]
REQUIRED = ["positive_template", "negative_template", "notes"]


def missing_cells(prompts: DataFrame, targets: DataFrame, templates: DataFrame, profiles: DataFrame, jobs: DataFrame, include_existing: bool = False, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """(prompt_id, style_id, ord, source_id, source_style) of each active prompt and target style (style_id, ord) without an
    enabled template and without a job that blocks it, in order of prompt and style, with its preferred source
    template in another style. Cells without a source are left out. Targets are a short list and broadcast as one."""
    cells = prompts.where("status = 'active'").select(F.col("id").alias("prompt_id")).crossJoin(F.broadcast(targets))
    if not include_existing:
        cells = cells.join(templates.where("enabled").select("prompt_id", "style_id").distinct(), ["prompt_id", "style_id"], "left_anti")
    blocking = ["running", "completed", "skipped", *([] if retry_failed else ["failed"])]
    cells = cells.join(jobs.where(F.col("status").isin(blocking)).select("prompt_id", "style_id").distinct(), ["prompt_id", "style_id"], "left_anti")
    rank = F.lit(100)
    for k, s in reversed(list(enumerate(PREFERRED))):
        rank = F.when(F.col("source_style") == s, k).otherwise(rank)
    sources = templates.where("enabled").select("prompt_id", F.col("style_id").alias("source_style_id"), F.col("template_id").alias("source_id"))
    sources = sources.join(profiles.select(F.col("style_id").alias("source_style_id"), F.col("style").alias("source_style")), "source_style_id").withColumn("rank", rank)
    found = cells.join(sources, "prompt_id").where("source_style_id <> style_id")
    best = found.groupBy("prompt_id", "style_id", "ord").agg(F.min(F.struct("rank", "source_id", "source_style")).alias("b"))
    out = best.select("prompt_id", "style_id", "ord", "b.source_id", "b.source_style")
    return out if limit is None else out.orderBy("prompt_id", "ord").limit(limit)


def build_tasks(cells: DataFrame, prompts: DataFrame, templates: DataFrame, styles: DataFrame) -> DataFrame:
    """(prompt_id, style_id, task): the task of each cell as JSON. styles: (style_id, style, syntax_family, strategy,
    description)."""
    s = templates.select(F.col("template_id").alias("source_id"), "positive", "negative")
    p = prompts.select(F.col("id").alias("prompt_id"), "identifier", "concept")
    b = cells.join(s, "source_id").join(p, "prompt_id").join(styles, "style_id")
    task = F.struct(
        F.lit("rewrite_prompt_style_variant").alias("task"), F.col("identifier").alias("prompt_identifier"), "concept",
        F.struct(F.col("style").alias("identifier"), "syntax_family", F.col("strategy").alias("negative_prompt_strategy"), "description").alias("target_style"),
        "source_style", F.col("positive").alias("source_positive_template"), F.col("negative").alias("source_negative_template"),
        placeholder_keys(F.col("positive"), keep_concept=False).alias("required_wildcards"),
        F.struct(F.lit("json").alias("format"), F.array(*[F.lit(k) for k in REQUIRED]).alias("required_keys")).alias("output_contract"),
    )
    return b.select("prompt_id", "style_id", F.to_json(task).alias("task"))


def write_tasks(tasks: DataFrame, path: str) -> None:
    """One JSON file a task, under prompt_id=.../style_id=...; the files of one prompt are written by one task."""
    tasks.repartition("prompt_id").sortWithinPartitions("prompt_id", "style_id").write.mode("overwrite").partitionBy("prompt_id", "style_id").text(path)


def response_error(response: Column, required: Column, allow_drop: bool = False) -> Column:
    """What is wrong with a response (JSON text), null if nothing: not an object, a missing key, a value that is no
    string, placeholders that were not asked for, or asked for and left out."""
    v = F.try_parse_json(response)
    out = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object"))
    kind = F.schema_of_variant(v)
    for k in REQUIRED:
        out = out.when(~kind.rlike(rf"[<, ]{k}: "), F.lit(f"missing key: {k}")).when(~kind.rlike(rf"[<, ]{k}: STRING"), F.lit(f"not a string: {k}"))
    get = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    positive = placeholder_keys(get("positive_template"), keep_concept=False)
    extra = F.array_except(F.array_union(positive, placeholder_keys(get("negative_template"), keep_concept=False)), required)
    out = out.when(F.size(extra) > 0, F.concat(F.lit("unbound: "), F.array_join(F.sort_array(extra), ",")))
    if not allow_drop:
        gone = F.array_except(required, positive)
        out = out.when(F.size(gone) > 0, F.concat(F.lit("omitted: "), F.array_join(F.sort_array(gone), ",")))
    return out


def fold_states(events: DataFrame) -> DataFrame:
    """(job_id, status, attempt_count, completed_at) from events (job_id, status, ts, seq): the last status, how often it
    ran, when it was last completed."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count_if(F.col("status") == "running").alias("attempt_count"), F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at")
    )


def run_worker(tasks: DataFrame, worker: Callable[[str], str]) -> DataFrame:
    """(prompt_id, style_id, response, error): worker takes a task's JSON and returns a response's; what it raises becomes
    the error of its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, s, task in zip(b["prompt_id"], b["style_id"], b["task"]):
                try:
                    rows.append((p, s, worker(task), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, s, None, str(e)))
            yield pd.DataFrame(rows, columns=["prompt_id", "style_id", "response", "error"])

    return tasks.select("prompt_id", "style_id", "task").mapInPandas(run, "prompt_id bigint, style_id bigint, response string, error string")


def command_worker(argv: list[str]) -> Callable[[str], str]:
    """A worker that gives the task to a command's standard input and reads its standard output as JSON."""

    def work(task: str) -> str:
        done = subprocess.run(argv, input=task, text=True, capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.strip() or f"command exited {done.returncode}")
        json.loads(done.stdout)
        return done.stdout

    return work


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    n = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq")))
    return events.withColumn("_n", n).where("_n = 1").drop("_n")
