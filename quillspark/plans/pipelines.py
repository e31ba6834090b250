"""Pipelines made of the operators: cleaning a text, importing a document, packs and inboxes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.catalog import Catalog
from quillspark.functions import text as T
from quillspark.operators.merge import insert_or_ignore, keep_first, number_within, upsert, with_ids
from quillspark.schema import quarantine
from quillspark.session import materialise, spread
from quillspark.sources import parsers as P
from quillspark.sources.files import import_document


def clean_records(records: DataFrame, structured: Column | None = None) -> DataFrame:
    """Records (doc_id, idx, raw) with everything the cleaner derives: positive, negative_raw, is_json, cleaned, reject_reason,
    concept, identifier, variants and flags; structured says which are labelled records. One stage without a shuffle; kept
    and rejected rows are two filters."""
    positive, negative = T.split_negative(F.col("raw"))
    none = F.struct(F.lit(None).cast("string").alias("concept"), F.create_map().cast("map<string,string>").alias("fields"))
    held = none if structured is None else F.when(structured, P.fields(F.col("raw"))).otherwise(none)
    # through generators, so that what is used many times is worked out once
    b = records.select("*", F.explode(F.array(F.struct(positive.alias("positive"), negative.alias("negative_raw"), held.alias("held")))).alias("_r"))
    b = b.select("*", "_r.positive", "_r.negative_raw", F.col("_r.held.fields").alias("fields"), F.col("_r.held.concept").alias("field_concept"), T.is_json_object(F.col("_r.positive")).alias("is_json")).drop("_r")
    has_fields = F.size("fields") > 0
    b = b.select("*", F.explode(F.array(F.when(F.col("is_json") | has_fields, T.strip(F.col("positive"))).otherwise(T.clean_positive(F.col("positive"))))).alias("cleaned"))
    concept = F.when(F.col("is_json"), F.lit("structured json prompt")).when(has_fields & (F.col("field_concept") != ""), F.col("field_concept")).otherwise(T.concept(F.col("cleaned")))
    b = b.withColumn("reject_reason", T.reject_reason(F.col("cleaned"))).withColumn("concept", concept)
    name = F.when(F.col("is_json"), T.identifier(F.lit(""), F.col("idx"), "structured_")).otherwise(T.identifier(F.col("concept"), F.col("idx")))
    b = b.withColumn("identifier", name).withColumn("variants", T.style_variants(F.col("cleaned"), F.col("raw"), F.col("is_json"), F.col("fields")))
    return b.select("*", *[c.alias(k) for k, c in T.clean_flags(F.col("positive")).items()])


def clean_documents(docs: DataFrame) -> DataFrame:
    """All documents (doc_id, text) of the three generic formats, each by its detected format. Documents are read once and
    nothing is shuffled: format and records are worked out side by side in one projection."""
    # through a generator, so that the format is worked out once and not again for each use
    d = spread(docs.where("text is not null").select("doc_id", "text")).select("doc_id", "text", F.explode(F.array(P.detect_format(F.col("text")))).alias("format"))
    text, form = F.col("text"), F.col("format")
    texts = F.when(form == "raw", P.block_texts(text)).when(form == "sectioned", P.section_texts(text)).when(form == "structured", P.record_texts(text))
    records = d.select("doc_id", "format", F.posexplode(texts).alias("idx", "raw"))
    cols = ["doc_id", "idx", "format", "raw", "cleaned", "negative_raw", "is_json", "reject_reason", "concept", "identifier", "variants"]
    return clean_records(records, F.col("format") == "structured").select(*cols)


def pack_rows(lines: DataFrame, existing: DataFrame, slug: str) -> DataFrame:
    """(idx, identifier, outcome, cleaned, concept, negative): lines (idx, line, negative) of a pack. outcome is skipped for a line
    whose content id is stored or came before, rejected with its reason, or imported."""
    b = lines.withColumn("identifier", F.concat(F.lit(f"{slug}_"), F.substring(F.sha1("line"), 1, 16)))
    nth = F.row_number().over(W.partitionBy("identifier").orderBy("idx"))
    b = b.withColumn("nth", nth).join(existing.select("identifier", F.lit(True).alias("stored")).distinct(), "identifier", "left")
    b = b.withColumn("cleaned", T.clean_positive(T.sanitise_braces(F.col("line"))))
    reason = T.reject_reason(F.col("cleaned"))
    outcome = F.when(F.col("stored") | (F.col("nth") > 1), "skipped").when(reason.isNotNull(), "rejected").otherwise("imported")
    return b.select("idx", "identifier", outcome.alias("outcome"), reason.alias("reject_reason"), "cleaned", T.concept(F.col("cleaned")).alias("concept"), "negative")


def import_pack(catalog: Catalog, lines: DataFrame, slug: str, commit_every: int = 5_000) -> list[tuple[int, int, int]]:
    """Imports a pack's lines (idx, line, negative) into a catalog, commit_every lines a commit, and returns for each commit
    made (first idx, imported, not imported). Every commit adds a part to the tables and rewrites none; what is stored
    already is skipped, so an import that broke off goes on where it stood when it is run again."""
    lines = materialise(lines.select("idx", "line", "negative"), "pack-lines")
    done, top = [], lines.agg(F.max("idx")).first()[0]
    for lo in range(0, (-1 if top is None else top) + 1, commit_every):
        started, now, stored = datetime.now(), F.current_timestamp(), catalog.load("prompts")
        rows = materialise(pack_rows(lines.where(F.col("idx").between(lo, lo + commit_every - 1)), stored, slug), "pack-rows")
        n = {r[0]: r[1] for r in rows.groupBy("outcome").count().collect()}
        good = rows.where("outcome = 'imported'")
        if n.get("imported"):
            prompts = good.select("identifier", "concept", F.lit("draft").alias("status"), F.to_json(F.struct(F.lit(slug).alias("original_source"), F.col("idx").alias("source_index"))).alias("metadata"), "idx", "cleaned", "negative")
            prompts = materialise(with_ids(prompts, stored, "id", ["idx"]), "pack-prompts")
            templates = prompts.select(F.col("id").alias("prompt_id"), F.lit(1).cast("bigint").alias("style_profile_id"), F.col("cleaned").alias("positive_template"), F.coalesce("negative", F.lit("")).alias("negative_template"), F.lit(True).alias("enabled"))
            # prompts last: they say what is stored, so a commit that broke off is made again
            catalog.append("prompt_templates", with_ids(templates, catalog.load("prompt_templates"), "id", ["prompt_id"]).withColumn("created_at", now).withColumn("updated_at", now))
            catalog.append("prompts", prompts.withColumn("created_at", now).withColumn("updated_at", now))
        total = sum(n.values())
        if n.get("imported"):
            catalog.ledger(f"{slug}#{lo}", "completed", n["imported"], total - n["imported"], None, started)
            done.append((lo, n["imported"], total - n["imported"]))
    return done


def inbox_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, block, outcome, identifier, cleaned, reject_reason): blocks that look like prompts, the first of equal ones
    in a document; accepted ones are numbered in order. docs: (doc_id, slug, text)."""
    b = P.inbox_blocks(docs.select("doc_id", "text")).where(T.looks_like_prompt(F.col("block")))
    b = keep_first(b.withColumn("key", F.lower(T.normalise_line(F.col("block")))), ["doc_id", "key"], ["idx"]).drop("key")
    positive, negative = T.split_negative(F.col("block"))
    b = b.withColumn("cleaned", T.clean_positive(positive)).withColumn("negative_raw", negative)
    b = b.withColumn("reject_reason", T.reject_reason(F.col("cleaned")))
    accepted = F.col("reject_reason").isNull()
    before = F.sum(accepted.cast("int")).over(W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("number", F.coalesce(before, F.lit(0))).join(docs.select("doc_id", "slug"), "doc_id")
    name = F.concat("slug", F.lit("_"), F.when(F.col("number") > 99999, F.col("number").cast("string")).otherwise(F.lpad(F.col("number").cast("string"), 5, "0")))
    return b.select("doc_id", "idx", "block", F.when(accepted, "accepted").otherwise("rejected").alias("outcome"), F.when(accepted, name).alias("identifier"), "cleaned", "reject_reason", "number")


def inbox_manifest(docs: DataFrame, entries: DataFrame, chunk: int = 500) -> DataFrame:
    """(slug, prompts, rejected, chunks) of each document, also of those without a prompt."""
    n = entries.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "accepted").alias("p"), F.count_if(F.col("outcome") == "rejected").alias("r"))
    j = docs.select("doc_id", "slug").join(n, "doc_id", "left")
    p = F.coalesce("p", F.lit(0))
    return j.select("doc_id", "slug", p.alias("prompts"), F.coalesce("r", F.lit(0)).alias("rejected"), F.ceil(p / chunk).alias("chunks"))


def with_parts(rows: DataFrame, group: str, order: str, chunk: int = 500) -> DataFrame:
    """rows with part: their number, from 1, in groups of chunk rows by order within a group."""
    n = number_within(rows, group, [order], "_number")
    return n.withColumn("part", F.floor((F.col("_number") - 1) / chunk) + 1).drop("_number")


def write_chunks(rows: DataFrame, path: str, group: str, order: str, chunk: int = 500) -> None:
    """JSON files with at most chunk rows for each part of a group; stale parts of the path are replaced."""
    parts = with_parts(rows, group, order, chunk)
    parts.repartition(group, "part").sortWithinPartitions(group, "part", order).write.mode("overwrite").partitionBy(group, "part").json(path)


def import_file(catalog: Catalog, path: str, dry_run: bool = False) -> dict[str, DataFrame]:
    """Imports a JSON document into a catalog and returns what it did, by table; a dry run writes nothing. All tables are
    written after all plans were built, and the ledger last; a failure leaves the old snapshots in place."""
    spark, now = catalog.spark, F.current_timestamp()
    started = datetime.now()
    try:
        values, incoming = import_document(spark, path)
        defs, vals = catalog.load("wildcard_definitions"), catalog.load("wildcard_values")
        keyed = values.withColumn("wildcard_key", T.normalise_key(F.col("raw_key")))
        new_defs = insert_or_ignore(defs, keyed.select("wildcard_key", "raw_key"), ["wildcard_key"], ["raw_key"]).select("wildcard_key", F.lit("active").alias("status"), now.alias("created_at"), now.alias("updated_at"))
        defs2 = defs.unionByName(with_ids(new_defs, defs, "id", ["wildcard_key"]), allowMissingColumns=True)
        v = keyed.join(defs2.select(F.col("id").alias("wildcard_definition_id"), "wildcard_key"), "wildcard_key")
        new_vals = insert_or_ignore(vals, v.select("wildcard_definition_id", "value", "weight", "raw_key", "ord"), ["wildcard_definition_id", "value"], ["raw_key", "ord"])
        vals2 = vals.unionByName(with_ids(new_vals.drop("raw_key").withColumn("created_at", now), vals, "id", ["wildcard_definition_id", "ord"]).drop("ord"), allowMissingColumns=True)

        prompts, versions = catalog.load("prompts"), catalog.load("prompt_versions")
        good, bad = quarantine(incoming.where("identifier is not null and concept is not null"), "prompts")
        known = versions.join(prompts.select(F.col("id").alias("prompt_id"), "identifier"), "prompt_id").select("identifier", "version")
        merged = upsert(prompts.select("identifier", "concept", "status", "metadata"), good.select("identifier", "concept", "status", "metadata", "ord"), ["identifier"], ["concept", "status", "metadata"], ["ord"], known)
        ids = prompts.select("identifier", "id", "created_at")
        fresh = with_ids(good.groupBy("identifier").agg(F.min("ord").alias("ord")).join(prompts.select("identifier"), "identifier", "left_anti"), prompts, "id", ["ord"])
        ids = ids.unionByName(fresh.select("identifier", "id", now.alias("created_at")))
        prompts2 = merged.snapshot.join(ids, "identifier").withColumn("updated_at", now)

        profiles, templates = catalog.load("prompt_style_profiles"), catalog.load("prompt_templates")
        s = good.select(F.col("identifier").alias("owner"), "ord", F.posexplode("style_variations").alias("k", "s")).select("owner", "ord", "k", F.coalesce("s.identifier", "s.syntax_family", F.lit("unknown")).alias("style"), F.coalesce("s.syntax_family", "s.identifier").alias("syntax_family"), F.coalesce("s.positive_template", F.lit("")).alias("positive_template"), F.coalesce("s.negative_template", F.lit("")).alias("negative_template"), F.coalesce("s.negative_prompt_strategy", F.lit("minimal")).alias("negative_prompt_strategy"), "s.notes")
        ok, bad_styles = quarantine(s, "prompt_style_profiles")
        new_prof = insert_or_ignore(profiles, ok.select(F.col("style").alias("identifier"), "syntax_family", "negative_prompt_strategy", "ord", "k"), ["identifier"], ["ord", "k"])
        profiles2 = profiles.unionByName(with_ids(new_prof.withColumn("created_at", now), profiles, "id", ["ord", "k"]).drop("ord", "k"), allowMissingColumns=True)
        t = ok.join(ids.select(F.col("identifier").alias("owner"), F.col("id").alias("prompt_id")), "owner").join(profiles2.select(F.col("identifier").alias("style"), F.col("id").alias("style_profile_id")), "style")
        t = t.select("prompt_id", "style_profile_id", "positive_template", "negative_template", "notes", (F.col("ord") * 10_000 + F.col("k")).alias("ord"))
        tkey = ["prompt_id", "style_profile_id"]
        tver = catalog.load("prompt_template_versions").join(templates.select(F.col("id").alias("template_id"), *tkey), "template_id").select(*tkey, "version")
        tm = upsert(templates.select(*tkey, "positive_template", "negative_template", "notes"), t, tkey, ["positive_template", "negative_template", "notes"], ["ord"], tver)
        told = templates.select(*tkey, "id", "enabled", "created_at")
        tnew = with_ids(t.groupBy(*tkey).agg(F.min("ord").alias("ord")).join(told, tkey, "left_anti"), templates, "id", ["ord"]).select(*tkey, "id", F.lit(True).alias("enabled"), now.alias("created_at"))
        changed = tm.versions.select(*tkey).distinct().withColumn("hit", F.lit(True))
        templates2 = tm.snapshot.join(told.unionByName(tnew), tkey).join(changed, tkey, "left").withColumn("enabled", F.coalesce("hit", "enabled")).drop("hit").withColumn("updated_at", now)

        bindings = catalog.load("prompt_wildcard_bindings")
        refs = good.select("identifier", F.explode("wildcard_refs").alias("r")).select("identifier", T.normalise_key(F.col("r")).alias("wildcard_key")).distinct()
        refs = refs.join(ids.select("identifier", F.col("id").alias("prompt_id")), "identifier").join(defs2.select("wildcard_key", F.col("id").alias("wildcard_definition_id")), "wildcard_key")
        new_b = insert_or_ignore(bindings, refs.select("prompt_id", "wildcard_definition_id"), ["prompt_id", "wildcard_definition_id"], ["prompt_id"])
        new_b = with_ids(new_b, bindings, "id", ["prompt_id", "wildcard_definition_id"]).withColumn("required", F.lit(False)).withColumn("default_strategy", F.lit("random"))
        pv = merged.versions.join(ids.select("identifier", F.col("id").alias("prompt_id")), "identifier").select("prompt_id", F.col("version").cast("int").alias("version"), "change_type", F.lit("import").alias("changed_by"), F.lit("import").alias("change_reason"), now.alias("created_at"))
        tv = tm.versions.join(templates2.select(F.col("id").alias("template_id"), *tkey), tkey).select("template_id", F.col("version").cast("int").alias("version"), "positive_template", "negative_template", "change_type", F.lit("import").alias("changed_by"), now.alias("created_at"))
        out = {
            "wildcard_definitions": defs2, "wildcard_values": vals2, "prompts": prompts2, "prompt_style_profiles": profiles2, "prompt_templates": templates2,
            "prompt_wildcard_bindings": bindings.unionByName(new_b), "prompt_versions": versions.unionByName(with_ids(pv, versions, "id", ["prompt_id", "version"]), allowMissingColumns=True),
            "prompt_template_versions": catalog.load("prompt_template_versions").unionByName(with_ids(tv, catalog.load("prompt_template_versions"), "id", ["template_id", "version"]), allowMissingColumns=True),
        }
        report = {"actions": merged.actions, "rejected": bad.select("identifier", "reason"), "rejected_styles": bad_styles.select("owner", "style", "reason")}
        if not dry_run:
            counts = (good.count(), bad.count())
            # plans read the old snapshots, which stay in place, so the order of writes does not matter
            out = {k: materialise(df, f"import-{k}") for k, df in out.items()}
            for k, df in out.items():
                catalog.save(k, df)
            catalog.ledger(path, "completed", *counts, None, started)
        return out | report
    except Exception as e:
        if not dry_run:
            catalog.ledger(path, "failed", 0, 0, str(e)[:2000], started)
        raise
