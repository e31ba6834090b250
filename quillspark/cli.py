"""Command line: init, reset, import, diff, render, list-prompts, list-styles, list-wildcards, search, validate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import library, render
from .plans.pipelines import import_file
from .session import get_spark, release
from .sources.files import import_document


def _tables(c: Catalog) -> dict:
    t = c.load("prompt_templates").select(F.col("id").alias("template_id"), "prompt_id", F.col("style_profile_id").alias("style_id"), F.col("positive_template").alias("positive"), F.col("negative_template").alias("negative"), "enabled")
    d = c.load("wildcard_definitions").select(F.col("id").alias("definition_id"), "wildcard_key", "status")
    return {
        "prompts": c.load("prompts"), "templates": t, "definitions": d,
        "profiles": c.load("prompt_style_profiles").select(F.col("id").alias("style_id"), F.col("identifier").alias("style"), "syntax_family", "negative_prompt_strategy"),
        "values": c.load("wildcard_values").select(F.col("id").alias("value_id"), F.col("wildcard_definition_id").alias("definition_id"), "value", "weight"),
        "bindings": c.load("prompt_wildcard_bindings").select("prompt_id", F.col("wildcard_definition_id").alias("definition_id")).join(d.select("definition_id", "wildcard_key"), "definition_id"),
    }


def _listed(df: DataFrame) -> int:
    """Prints all rows as JSON lines, a partition at a time, and returns how many."""
    n = 0
    for line in df.toJSON().toLocalIterator():
        print(line)
        n += 1
    return n


def main(argv: list[str] | None = None) -> int:
    """Runs one command and deletes what it wrote in between."""
    try:
        return _run(argv)
    finally:
        if spark := SparkSession.getActiveSession():
            release(spark)


def _run(argv: list[str] | None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("--root", default="library", help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "reset", "list-styles", "list-wildcards", "validate"):
        sub.add_parser(name)
    for name in ("import", "diff"):
        s = sub.add_parser(name)
        s.add_argument("file")
        s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("list-prompts")
    s.add_argument("--status")
    s = sub.add_parser("search")
    s.add_argument("query")
    s = sub.add_parser("render")
    s.add_argument("identifier")
    s.add_argument("--style")
    s.add_argument("--all-styles", action="store_true")
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    a = p.parse_args(argv)
    c = Catalog(get_spark(), a.root)
    if a.command in ("init", "reset"):
        (c.initialise if a.command == "init" else c.reset)()
        return 0
    if a.command == "import":
        _listed(import_file(c, a.file, a.dry_run)["actions"].groupBy("action").count())
        return 0
    t = _tables(c)
    if a.command == "diff":
        values, prompts = import_document(c.spark, a.file)
        _listed(library.diff_prompts(prompts, t["prompts"]))
        _listed(library.diff_keys(values.select(F.col("raw_key").alias("raw")), t["definitions"]))
    elif a.command == "list-prompts":
        _listed(library.list_prompts(t["prompts"], a.status))
    elif a.command == "list-styles":
        _listed(t["profiles"].orderBy("style"))
    elif a.command == "list-wildcards":
        _listed(library.list_wildcards(t["definitions"], t["values"]).orderBy("wildcard_key"))
    elif a.command == "search":
        _listed(library.search(t["prompts"], a.query).orderBy("identifier"))
    elif a.command == "validate":
        bad = library.unbound_keys(t["templates"], t["bindings"])
        _listed(bad)
        return int(not bad.isEmpty())
    elif a.command == "render":
        one = t["prompts"].where(F.col("identifier") == a.identifier)
        given = dict(x.split("=", 1) for x in a.set)
        out = render.render(one, t["templates"], t["profiles"], t["bindings"], t["definitions"], t["values"], a.seed, a.style, a.all_styles, given)
        if not _listed(out):
            print(json.dumps({"error": f"no template found for prompt {a.identifier!r}"}))
            return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
