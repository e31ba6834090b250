"""Queries for scans, filters, joins, aggregates, ranking and merging, over the library's logical tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.functions import text as T
from quillspark.operators import evalset, jobs, library, merge, mining, render
from quillspark.session import table

from . import pipelines
from .fixtures import BASE, Library
from .registry import Registry
from .text_queries import SCORED, scored

R = Registry()


@R.add("s02_scan_project", "SELECT record_id, concept, status FROM lexica_cleaned WHERE batch_no > 50")
def s02(spark, d):
    return table(spark, d, "lexica_cleaned").where("batch_no > 50").select("record_id", "concept", "status")


@R.add("f01_list_prompts", BASE + "SELECT identifier, concept, status FROM prompts WHERE status = 'active'")
def f01(spark, d):
    return library.list_prompts(Library(spark, d).prompts, "active")


@R.add("f02_list_styles", "SELECT identifier, syntax_family, negative_prompt_strategy FROM prompt_style_profiles")
def f02(spark, d):
    return table(spark, d, "prompt_style_profiles").select("identifier", "syntax_family", "negative_prompt_strategy").orderBy("identifier")


_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@R.add("f03_search", BASE + f"SELECT identifier, concept, status FROM prompts WHERE {_FOLD.format('concept')} LIKE '%sea_stress%' OR {_FOLD.format('identifier')} LIKE '%sea_stress%'")
def f03(spark, d):
    return library.search(Library(spark, d).prompts, "Sea_stress")


@R.add("f04_prefix_like", "SELECT record_id, identifier FROM lexica_cleaned WHERE identifier LIKE 'gentle_%'")
def f04(spark, d):
    return table(spark, d, "lexica_cleaned").where(F.col("identifier").like("gentle_%")).select("record_id", "identifier")


#: Every record is a member of one set, by its source, so one set holds most of them.
_MEMBERS = "members AS (SELECT CAST(CASE WHEN original_source = 'lexica' THEN 2 WHEN original_source IS NULL THEN 3 WHEN original_source < 'd' THEN 4 ELSE 1 END AS BIGINT) AS set_id, record_id AS prompt_id, source_index AS position, negative_template IS NOT NULL AS enabled FROM lexica_cleaned)"


def _members(lib):
    source = F.col("original_source")
    of = F.when(source == "lexica", 2).when(source.isNull(), 3).when(source < "d", 4).otherwise(1).cast("bigint")
    return lib.records.select(of.alias("set_id"), F.col("record_id").alias("prompt_id"), F.col("source_index").alias("position"), F.col("negative_template").isNotNull().alias("enabled"))


@R.add("f09_in_set", BASE + f", {_MEMBERS} SELECT id, identifier FROM prompts WHERE status = 'active' AND EXISTS (SELECT 1 FROM members m JOIN prompt_sets s ON s.id = m.set_id WHERE m.prompt_id = prompts.id AND m.enabled AND s.name = 'varied_200')")
def f09(spark, d):
    lib = Library(spark, d)
    sets = lib.t("prompt_sets").select(F.col("id").alias("set_id"), "name")
    m = _members(lib).withColumn("enabled", F.col("enabled"))
    return library.in_set(lib.prompts, m, sets, "varied_200").select("id", "identifier")


@R.add("j01_templates_profiles_prompts", BASE + "SELECT template_id, identifier, style FROM templates JOIN profiles USING (style_id) JOIN prompts ON prompts.id = prompt_id WHERE enabled")
def j01(spark, d):
    lib = Library(spark, d)
    return lib.templates.where("enabled").join(F.broadcast(lib.profiles), "style_id").join(lib.prompts.select(F.col("id").alias("prompt_id"), "identifier"), "prompt_id").select("template_id", "identifier", "style")


@R.add("j02_active_values", BASE + "SELECT value_id, wildcard_key, value, round(weight, 6) AS weight FROM wvalues JOIN definitions USING (definition_id) WHERE status = 'active'")
def j02(spark, d):
    lib = Library(spark, d)
    return lib.values.join(F.broadcast(lib.definitions.where("status = 'active'")), "definition_id").select("value_id", "wildcard_key", "value", F.round("weight", 6).alias("weight"))


@R.add("j03_bound_keys", BASE + "SELECT prompt_id, wildcard_key FROM bindings")
def j03(spark, d):
    return Library(spark, d).bindings.select("prompt_id", "wildcard_key")


@R.add("j04_list_wildcards", BASE + "SELECT wildcard_key, status, count(value_id) AS n_values FROM definitions LEFT JOIN wvalues USING (definition_id) GROUP BY 1, 2")
def j04(spark, d):
    lib = Library(spark, d)
    return library.list_wildcards(lib.definitions, lib.values)


@R.add("j05_bound_templates", BASE + "SELECT DISTINCT template_id FROM templates JOIN bindings USING (prompt_id) WHERE enabled")
def j05(spark, d):
    lib = Library(spark, d)
    return lib.templates.where("enabled").join(lib.bindings, "prompt_id", "left_semi").select("template_id")


_JOBS = "jobs AS (SELECT record_id AS prompt_id, record_id % 8 + 1 AS style_id, CASE record_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' WHEN 2 THEN 'pending' WHEN 3 THEN 'running' ELSE 'skipped' END AS status FROM lexica_cleaned)"
_TARGETS = "targets(style_id, ord) AS (SELECT CAST(a AS BIGINT), b FROM (VALUES (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (7, 5)) AS t(a, b))"


def _jobs(lib):
    s = F.element_at(F.array(*[F.lit(x) for x in ("failed", "completed", "pending", "running", "skipped")]), (F.col("record_id") % 5 + 1).cast("int"))
    return lib.records.select(F.col("record_id").alias("prompt_id"), (F.col("record_id") % 8 + 1).alias("style_id"), s.alias("status"))


def _targets(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (7, 5)], "style_id bigint, ord int")


@R.add("j07_anti_joins", BASE + f", {_JOBS} SELECT p.id FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM templates t WHERE t.prompt_id = p.id AND t.style_id = 1 AND t.enabled) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.prompt_id = p.id AND j.status IN ('running', 'completed', 'skipped', 'failed'))")
def j07(spark, d):
    lib = Library(spark, d)
    p = lib.prompts.select("id")
    p = p.join(lib.templates.where("enabled and style_id = 1").select(F.col("prompt_id").alias("id")), "id", "left_anti")
    return p.join(_jobs(lib).where("status <> 'pending'").select(F.col("prompt_id").alias("id")), "id", "left_anti")


@R.add("j08_grid", BASE + f", {_TARGETS} SELECT p.id, t.style_id FROM prompts p CROSS JOIN targets t WHERE p.status = 'active'")
def j08(spark, d):
    return Library(spark, d).prompts.where("status = 'active'").select("id").crossJoin(F.broadcast(_targets(spark).select("style_id")))


_PREF = "CASE style " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(jobs.PREFERRED)) + " ELSE 100 END"
_CELLS = f"""cells AS (SELECT prompt_id, style_id, ord, source_id, source_style FROM (SELECT p.id AS prompt_id, g.style_id, g.ord, t.template_id AS source_id, f.style AS source_style,
 row_number() OVER (PARTITION BY p.id, g.style_id ORDER BY {_PREF}, t.template_id) AS n FROM prompts p CROSS JOIN targets g JOIN templates t ON t.prompt_id = p.id AND t.enabled AND t.style_id <> g.style_id JOIN profiles f ON f.style_id = t.style_id
 WHERE p.status = 'active' AND NOT EXISTS (SELECT 1 FROM templates x WHERE x.prompt_id = p.id AND x.style_id = g.style_id AND x.enabled)
 AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.prompt_id = p.id AND j.style_id = g.style_id AND j.status <> 'pending')) WHERE n = 1)"""


def _cells(spark, d, **kw):
    lib = Library(spark, d)
    return jobs.missing_cells(lib.prompts, _targets(spark), lib.templates, lib.profiles, _jobs(lib), **kw)


@R.add("j09_preferred_source", BASE + f", {_TARGETS}, {_JOBS}, {_CELLS} SELECT prompt_id, style_id, source_id FROM cells")
def j09(spark, d):
    return _cells(spark, d).select("prompt_id", "style_id", "source_id")


@R.add("g06_missing_jobs", BASE + f", {_TARGETS}, {_JOBS}, {_CELLS} SELECT prompt_id, style_id, ord, source_id, source_style FROM cells")
def g06(spark, d):
    return _cells(spark, d)


@R.add("t05_job_limit", BASE + f", {_TARGETS}, {_JOBS}, {_CELLS} SELECT prompt_id, style_id FROM cells ORDER BY prompt_id, ord LIMIT 100")
def t05(spark, d):
    return _cells(spark, d, limit=100).select("prompt_id", "style_id")


_KEYS_OF = r"list_distinct(list_concat(regexp_extract_all(positive, '\{([\pL\pN_]+)\}', 1), regexp_extract_all(positive, '__([\pL\pN_]+)__', 1)))"


@R.add("g05_validate", BASE + f"""SELECT template_id, prompt_id, array_to_string(missing, '|') AS missing FROM (SELECT template_id, prompt_id, list_sort(list_filter({_KEYS_OF}, lambda x: x <> 'concept' AND NOT coalesce(list_contains(bound, x), false))) AS missing
 FROM templates LEFT JOIN (SELECT prompt_id, list(wildcard_key) AS bound FROM bindings WHERE wildcard_key <> 'mood' GROUP BY 1) USING (prompt_id) WHERE enabled) WHERE len(missing) > 0""")
def g05(spark, d):
    lib = Library(spark, d)
    bad = library.unbound_keys(lib.templates, lib.bindings.where("wildcard_key <> 'mood'"))
    return bad.select("template_id", "prompt_id", F.array_join("missing", "|").alias("missing"))


@R.add("j11_diff_prompts", "WITH new AS (SELECT DISTINCT identifier FROM lexica_cleaned WHERE batch_no > 80), old AS (SELECT DISTINCT identifier FROM lexica_cleaned WHERE batch_no <= 80) SELECT identifier, CASE WHEN EXISTS (SELECT 1 FROM old WHERE old.identifier = new.identifier) THEN 'updated' ELSE 'new' END AS action FROM new")
def j11(spark, d):
    r = table(spark, d, "lexica_cleaned")
    return library.diff_prompts(r.where("batch_no > 80"), r.where("batch_no <= 80"))


@R.add("j11_diff_keys", BASE + "SELECT k AS wildcard_key, CASE WHEN k IN (SELECT wildcard_key FROM definitions) THEN 'existing' ELSE 'new' END AS action FROM (SELECT DISTINCT replace(replace(lower(trim(r)), '-', '_'), ' ', '_') AS k FROM (SELECT unnest(wildcard_refs) AS r FROM lexica_cleaned UNION ALL SELECT p_type FROM part))")
def j11k(spark, d):
    lib = Library(spark, d)
    raw = lib.records.select(F.explode("wildcard_refs").alias("raw")).unionByName(lib.t("part").select(F.col("p_type").alias("raw")))
    return library.diff_keys(raw.distinct(), lib.definitions)


@R.add("j13_dictionary_join", f"SELECT record_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(positive_template), '[a-z0-9][a-z0-9_-]*')), lambda x: list_contains({S.VISUAL_WORDS}, x))) AS INT) AS n FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def j13(spark, d):
    n = F.size(F.array_intersect(F.array_distinct(S.tokens(F.col("positive_template"))), S.words(S.VISUAL_WORDS)))
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", n.alias("n"))


@R.add("a01_count_with_zero", BASE + "SELECT wildcard_key, count(value_id) AS n FROM definitions LEFT JOIN wvalues USING (definition_id) GROUP BY 1")
def a01(spark, d):
    lib = Library(spark, d)
    return lib.definitions.join(lib.values, "definition_id", "left").groupBy("wildcard_key").agg(F.count("value_id").alias("n"))


@R.add("a02_next_version", "SELECT identifier, coalesce(max(batch_no), 0) + 1 AS version FROM lexica_cleaned GROUP BY 1")
def a02(spark, d):
    return table(spark, d, "lexica_cleaned").groupBy("identifier").agg((F.coalesce(F.max("batch_no"), F.lit(0)) + 1).alias("version"))


@R.add("a03_enabled_count", BASE + "SELECT count(*) AS n FROM templates WHERE enabled")
def a03(spark, d):
    return Library(spark, d).templates.where("enabled").agg(F.count("*").alias("n"))


@R.add("a06_style_counts", "SELECT lower(status) AS status, syntax_family, count(*) AS n FROM lexica_cleaned GROUP BY 1, 2")
def a06(spark, d):
    return table(spark, d, "lexica_cleaned").groupBy(F.lower("status").alias("status"), "syntax_family").agg(F.count("*").alias("n"))


@R.add("a07_category_counts", "SELECT original_source, count(*) AS n, count(DISTINCT concept) AS concepts FROM lexica_cleaned GROUP BY 1")
def a07(spark, d):
    return table(spark, d, "lexica_cleaned").groupBy("original_source").agg(F.count("*").alias("n"), F.countDistinct("concept").alias("concepts"))


@R.add("a08_grouped_values", BASE + "SELECT wildcard_key, array_to_string(list_sort(list(DISTINCT value)), '|') AS vals FROM wvalues JOIN definitions USING (definition_id) WHERE status = 'active' GROUP BY 1")
def a08(spark, d):
    lib = Library(spark, d)
    return mining.grouped_values(lib.definitions, lib.values).select("wildcard_key", F.array_join("values", "|").alias("vals"))


@R.add("a09_keys_per_prompt", BASE + "SELECT prompt_id, array_to_string(list_sort(list(DISTINCT k)), '|') AS keys FROM (SELECT prompt_id, unnest(" + _KEYS_OF + ") AS k FROM templates) GROUP BY 1")
def a09(spark, d):
    k = Library(spark, d).templates.select("prompt_id", F.explode(T.placeholder_keys(F.col("positive"))).alias("k"))
    return k.groupBy("prompt_id").agg(F.array_join(F.sort_array(F.collect_set("k")), "|").alias("keys"))


@R.add("a11_styles_in_output", BASE + "SELECT array_to_string(list_sort(list(DISTINCT style)), '|') AS styles FROM templates JOIN profiles USING (style_id)")
def a11(spark, d):
    lib = Library(spark, d)
    return lib.templates.select("style_id").distinct().join(F.broadcast(lib.profiles), "style_id").agg(F.array_join(F.sort_array(F.collect_set("style")), "|").alias("styles"))


@R.add("a12_run_summary", "SELECT count(*) AS scanned, count(*) FILTER (reason LIKE 'too short%') AS too_short, count(*) FILTER (reason LIKE 'too few%') AS too_few, count(*) FILTER (reason LIKE 'no alpha%') AS no_letters FROM civitai_rejected")
def a12(spark, d):
    c = lambda p: F.count_if(F.col("reason").like(p))
    return table(spark, d, "civitai_rejected").agg(F.count("*").alias("scanned"), c("too short%").alias("too_short"), c("too few%").alias("too_few"), c("no alpha%").alias("no_letters"))


@R.add("a13_multiword_share", BASE + "SELECT count(*) AS n, count(*) FILTER (regexp_matches(value, '[ -]')) AS multi FROM wvalues")
def a13(spark, d):
    return Library(spark, d).values.agg(F.count("*").alias("n"), F.count_if(F.col("value").rlike("[ -]")).alias("multi"))


@R.add("k03_manifest", "SELECT batch_no, count(*) AS prompts, CAST(ceil(count(*) / 10.0) AS BIGINT) AS chunks FROM lexica_cleaned GROUP BY 1")
def k03(spark, d):
    return table(spark, d, "lexica_cleaned").groupBy("batch_no").agg(F.count("*").alias("prompts"), F.ceil(F.count("*") / 10).alias("chunks"))


@R.add("k02_chunk_numbers", "SELECT record_id, (row_number() OVER (PARTITION BY batch_no ORDER BY record_id) - 1) // 10 + 1 AS part FROM lexica_cleaned")
def k02(spark, d):
    return pipelines.with_parts(table(spark, d, "lexica_cleaned").select("record_id", "batch_no"), "batch_no", "record_id", 10).select("record_id", "part")


@R.add("t01_order_by_key", BASE + "SELECT wildcard_key, status FROM definitions ORDER BY wildcard_key")
def t01(spark, d):
    return Library(spark, d).definitions.select("wildcard_key", "status").orderBy("wildcard_key")


@R.add("t02_case_preference", BASE + f"SELECT prompt_id, template_id FROM (SELECT prompt_id, template_id, row_number() OVER (PARTITION BY prompt_id ORDER BY {_PREF}, template_id) AS n FROM templates JOIN profiles USING (style_id) WHERE enabled) WHERE n = 1")
def t02(spark, d):
    lib = Library(spark, d)
    rank = F.lit(100)
    for k, s in reversed(list(enumerate(jobs.PREFERRED))):
        rank = F.when(F.col("style") == s, k).otherwise(rank)
    t = lib.templates.where("enabled").join(F.broadcast(lib.profiles), "style_id")
    return t.groupBy("prompt_id").agg(F.min(F.struct(rank.alias("r"), "template_id")).alias("b")).select("prompt_id", "b.template_id")


@R.add("t03_topk_domain", f"WITH {SCORED} SELECT record_id, domain, score, rank FROM (SELECT record_id, domain, score, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, record_id) AS INT) AS rank FROM scored WHERE n >= 6 AND score >= 8) WHERE rank <= 50")
def t03(spark, d):
    s = scored(spark, d).withColumn("score", F.round("score", 6)).where((F.col("n_tokens") >= 6) & (F.col("score") >= S.LEAST_SCORE))
    return evalset.top_per_domain(s, 50).select("record_id", "domain", "score", "rank")


@R.add("t06_scan_cut", "SELECT record_id FROM lexica_cleaned ORDER BY record_id LIMIT 500")
def t06(spark, d):
    return table(spark, d, "lexica_cleaned").select("record_id").orderBy("record_id").limit(500)


@R.add("t07_longest_first", BASE + "SELECT value, length(value) AS n FROM wvalues JOIN definitions USING (definition_id) WHERE status = 'active' GROUP BY 1, 2")
def t07(spark, d):
    lib = Library(spark, d)
    v = lib.values.join(F.broadcast(lib.definitions.where("status = 'active'")), "definition_id").select("value", F.length("value").cast("bigint").alias("n")).distinct()
    return v.orderBy(F.desc("n"), "value")


@R.add("t08_default_style", BASE + "SELECT prompt_id, template_id, syntax_family FROM (SELECT prompt_id, template_id, syntax_family, row_number() OVER (PARTITION BY prompt_id ORDER BY syntax_family, template_id) AS n FROM templates JOIN profiles USING (style_id) WHERE enabled) WHERE n = 1")
def t08(spark, d):
    lib = Library(spark, d)
    t = lib.templates.where("enabled").join(F.broadcast(lib.profiles), "style_id")
    return t.groupBy("prompt_id").agg(F.min(F.struct("syntax_family", "template_id")).alias("b")).select("prompt_id", "b.template_id", "b.syntax_family")


@R.add("t09_first_slices", "SELECT record_id, array_to_string(list_slice(wildcard_refs, 1, 1), '|') AS refs, substr(original_prompt, 1, 100) AS original FROM lexica_cleaned WHERE wildcard_refs IS NOT NULL")
def t09(spark, d):
    return table(spark, d, "lexica_cleaned").where("wildcard_refs is not null").select("record_id", F.array_join(F.slice("wildcard_refs", 1, 1), "|").alias("refs"), F.substring("original_prompt", 1, 100).alias("original"))


@R.add("u01_insert_or_ignore", "WITH old AS (SELECT DISTINCT identifier FROM lexica_cleaned WHERE batch_no <= 80) SELECT identifier, record_id FROM (SELECT identifier, record_id, row_number() OVER (PARTITION BY identifier ORDER BY record_id) AS n FROM lexica_cleaned WHERE batch_no > 80) WHERE n = 1 AND identifier NOT IN (SELECT identifier FROM old)")
def u01(spark, d):
    r = table(spark, d, "lexica_cleaned")
    return merge.insert_or_ignore(r.where("batch_no <= 80").select("identifier"), r.where("batch_no > 80").select("identifier", "record_id"), ["identifier"], ["record_id"])


@R.add("u02_key_upsert", BASE + "SELECT DISTINCT k AS wildcard_key FROM (SELECT replace(replace(lower(trim(p_type)), '-', '_'), ' ', '_') AS k FROM part) WHERE k NOT IN (SELECT wildcard_key FROM definitions)")
def u02(spark, d):
    lib = Library(spark, d)
    new = lib.t("part").select(T.normalise_key(F.col("p_type")).alias("wildcard_key"))
    return merge.insert_or_ignore(lib.definitions, new, ["wildcard_key"], ["wildcard_key"])


_UPS = """WITH ord AS (SELECT identifier, concept, status, record_id, batch_no, row_number() OVER (PARTITION BY identifier ORDER BY record_id) AS k FROM lexica_cleaned),
 stored AS (SELECT o.identifier, o.concept, o.status FROM ord o WHERE k = 1 AND batch_no <= 60),
 inc AS (SELECT identifier, concept, status, record_id, row_number() OVER (PARTITION BY identifier ORDER BY record_id) AS k, lag(concept) OVER w AS pc, lag(status) OVER w AS ps FROM lexica_cleaned WHERE batch_no > 60 WINDOW w AS (PARTITION BY identifier ORDER BY record_id)),
 act AS (SELECT i.identifier, i.record_id, i.concept, i.status, CASE WHEN k = 1 AND s.identifier IS NULL THEN 'created' WHEN CASE WHEN k > 1 THEN pc ELSE s.concept END IS DISTINCT FROM i.concept OR CASE WHEN k > 1 THEN ps ELSE s.status END IS DISTINCT FROM i.status THEN 'updated' ELSE 'unchanged' END AS action FROM inc i LEFT JOIN stored s USING (identifier))"""


def _upsert(spark, d):
    r = table(spark, d, "lexica_cleaned")
    stored = merge.keep_first(r, ["identifier"], ["record_id"]).where("batch_no <= 60").select("identifier", "concept", "status")
    return merge.upsert(stored, r.where("batch_no > 60").select("identifier", "concept", "status", "record_id"), ["identifier"], ["concept", "status"], ["record_id"])


@R.add("u03_prompt_upsert", _UPS + " SELECT identifier, record_id, action FROM act")
def u03(spark, d):
    return _upsert(spark, d).actions


@R.add("u03_prompt_versions", _UPS + " SELECT identifier, CAST(row_number() OVER (PARTITION BY identifier ORDER BY record_id) AS BIGINT) AS version, action AS change_type FROM act WHERE action <> 'unchanged'")
def u03v(spark, d):
    return _upsert(spark, d).versions.select("identifier", "version", "change_type")


@R.add("u04_template_upsert", _UPS + " SELECT identifier, concept, status FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY record_id DESC) AS l FROM act) WHERE l = 1 UNION ALL SELECT identifier, concept, status FROM stored WHERE identifier NOT IN (SELECT identifier FROM inc)")
def u04(spark, d):
    return _upsert(spark, d).snapshot.select("identifier", "concept", "status")


@R.add("u05_always_version", "SELECT identifier, CAST(row_number() OVER (PARTITION BY identifier ORDER BY record_id) AS BIGINT) AS version FROM lexica_cleaned WHERE batch_no > 60")
def u05(spark, d):
    r = table(spark, d, "lexica_cleaned")
    stored = r.where("false").select("identifier", "concept", "status")
    m = merge.upsert(stored, r.where("batch_no > 60").select("identifier", "concept", "status", "record_id"), ["identifier"], ["concept"], ["record_id"], always=True)
    return m.versions.select("identifier", "version")


@R.add("u06_job_upsert", BASE + f", {_JOBS}, inc AS (SELECT record_id AS prompt_id, (record_id + CASE lower(status) WHEN 'draft' THEN 1 ELSE 0 END) % 8 + 1 AS style_id, record_id * 2 AS source_id FROM lexica_cleaned) SELECT coalesce(j.prompt_id, i.prompt_id) AS prompt_id, coalesce(j.style_id, i.style_id) AS style_id, coalesce(j.status, 'pending') AS status, i.source_id FROM jobs j FULL JOIN inc i USING (prompt_id, style_id)")
def u06(spark, d):
    lib = Library(spark, d)
    stored = _jobs(lib).withColumn("source_id", F.lit(None).cast("bigint"))
    inc = lib.records.select(F.col("record_id").alias("prompt_id"), ((F.col("record_id") + F.when(F.lower("status") == "draft", 1).otherwise(0)) % 8 + 1).alias("style_id"), (F.col("record_id") * 2).alias("source_id"))
    return merge.upsert_jobs(stored, inc, ["prompt_id", "style_id"], ["source_id"])


@R.add("u07_replace_members", BASE + f", {_MEMBERS} SELECT set_id, prompt_id, position, enabled FROM members WHERE set_id <> 2 UNION ALL SELECT 2, id, CAST(row_number() OVER (ORDER BY id DESC) AS INT), true FROM (SELECT id FROM prompts WHERE status = 'active')")
def u07(spark, d):
    lib = Library(spark, d)
    members = _members(lib).select("set_id", "prompt_id", "position", "enabled")
    chosen = lib.prompts.where("status = 'active'").select(F.lit(2).cast("bigint").alias("set_id"), F.col("id").alias("prompt_id"))
    return merge.replace_members(members, chosen.select("set_id"), chosen, [F.desc("prompt_id")])


@R.add(
    "u08_json_patch",
    """WITH o AS (SELECT record_id, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata ELSE '{}' END AS m FROM lexica_cleaned),
    e AS (SELECT record_id, k, json_extract_string(m, '$."' || k || '"') AS v FROM (SELECT record_id, m, unnest(json_keys(m)) AS k FROM o) WHERE k <> 'eval_selection' UNION ALL SELECT record_id, 'eval_selection', 'eval-core' FROM o)
    SELECT record_id, '{' || string_agg(to_json(k) || ':' || coalesce(to_json(v), 'null'), ',' ORDER BY k) || '}' AS metadata FROM e GROUP BY 1""",
)
def u08(spark, d):
    return table(spark, d, "lexica_cleaned").select("record_id", merge.patch_json(F.col("metadata"), "eval_selection", F.lit("eval-core")).alias("metadata"))


@R.add("u09_dedupe_lower", r"SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(positive_template, '[\s\pZ]+', ' ', 'g'))) ORDER BY record_id) AS n FROM lexica_cleaned WHERE positive_template IS NOT NULL) WHERE n = 1")
def u09(spark, d):
    r = table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", F.lower(T.strip(T.squeeze(F.col("positive_template")))).alias("k"))
    return r.groupBy("k").agg(F.min("record_id").alias("record_id")).select("record_id")


@R.add("u10_dedupe_content_id", "SELECT min(rejected_id) AS rejected_id FROM civitai_rejected WHERE original_prompt IS NOT NULL GROUP BY sha1(original_prompt)")
def u10(spark, d):
    return table(spark, d, "civitai_rejected").where("original_prompt is not null").groupBy(F.sha1("original_prompt").alias("k")).agg(F.min("rejected_id").alias("rejected_id")).select("rejected_id")


@R.add("u11_first_template", BASE + "SELECT prompt_id, min(template_id) AS template_id FROM templates GROUP BY 1")
def u11(spark, d):
    return merge.keep_first(Library(spark, d).templates.select("prompt_id", "template_id"), ["prompt_id"], ["template_id"])


@R.add("u12_set_operations", "SELECT record_id, array_to_string(list_sort(list_distinct(list_concat(wildcard_refs, ['mood', 'x']))), '|') AS u, array_to_string(list_sort(list_filter(wildcard_refs, lambda x: x IN ('mood', 'camera'))), '|') AS i, array_to_string(list_sort(list_filter(wildcard_refs, lambda x: x NOT IN ('mood', 'camera'))), '|') AS e FROM lexica_cleaned WHERE wildcard_refs IS NOT NULL")
def u12(spark, d):
    r, s = F.col("wildcard_refs"), lambda *v: F.array(*[F.lit(x) for x in v])
    j = lambda a: F.array_join(F.sort_array(a), "|")
    return table(spark, d, "lexica_cleaned").where("wildcard_refs is not null").select("record_id", j(F.array_union(r, s("mood", "x"))).alias("u"), j(F.array_intersect(r, s("mood", "camera"))).alias("i"), j(F.array_except(r, s("mood", "camera"))).alias("e"))


_SEED_U = __import__("random").Random(7).random()
_PICK = f"""picked AS (SELECT definition_id, wildcard_key, coalesce(min_by(value, value_id) FILTER (run > {_SEED_U!r} * total), max_by(value, value_id)) AS value FROM
 (SELECT definition_id, wildcard_key, value_id, value, sum(weight) OVER (PARTITION BY definition_id ORDER BY value_id ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY definition_id) AS total FROM wvalues JOIN definitions USING (definition_id) WHERE status = 'active') GROUP BY 1, 2)"""


@R.add("m07_seeded_choice", BASE + f", {_PICK} SELECT wildcard_key, value FROM picked")
def m07(spark, d):
    lib = Library(spark, d)
    return render.choose_values(lib.definitions, lib.values, _SEED_U).select("wildcard_key", "value")


_ORDERED = ["lighting", "mood", "camera", "subject", "style_modifier", "texture"]


def _sub(x: str) -> str:
    for k in _ORDERED:
        v = f"CASE WHEN bk_{k} THEN v_{k} END"
        x = f"CASE WHEN ({v}) IS NULL THEN {x} ELSE replace(replace({x}, '{{{k}}}', coalesce({v}, '')), '__{k}__', coalesce({v}, '')) END"
    return f"replace(replace({x}, '{{concept}}', coalesce(concept, 'None')), '__concept__', coalesce(concept, 'None'))"


_RENDER = (
    BASE + f", {_PICK}, pv AS (SELECT " + ", ".join(f"max(CASE WHEN wildcard_key = '{k}' THEN value END) AS v_{k}" for k in _ORDERED) + " FROM picked), bk AS (SELECT prompt_id, "
    + ", ".join(f"bool_or(wildcard_key = '{k}') AS bk_{k}" for k in _ORDERED) + " FROM bindings GROUP BY 1) "
)


@R.add("g01_render_default", _RENDER + f"SELECT t.prompt_id AS id, style, {_sub('positive')} AS positive_prompt FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY syntax_family, template_id) AS n FROM templates JOIN profiles USING (style_id) WHERE enabled) t JOIN prompts p ON p.id = t.prompt_id LEFT JOIN bk USING (prompt_id) CROSS JOIN pv WHERE n = 1")
def g01(spark, d):
    lib = Library(spark, d)
    return render.render(lib.prompts, lib.templates, lib.profiles, lib.bindings, lib.definitions, lib.values, 7).select("id", "style", "positive_prompt")


@R.add("g02_render_all_styles", _RENDER + f"SELECT t.prompt_id AS id, style, {_sub('positive')} AS positive_prompt, {_sub('negative')} AS negative_prompt FROM templates t JOIN profiles USING (style_id) JOIN prompts p ON p.id = t.prompt_id LEFT JOIN bk USING (prompt_id) CROSS JOIN pv WHERE enabled")
def g02(spark, d):
    lib = Library(spark, d)
    return render.render(lib.prompts, lib.templates, lib.profiles, lib.bindings, lib.definitions, lib.values, 7, all_styles=True).select("id", "style", "positive_prompt", "negative_prompt")


@R.add("g08_job_states", "SELECT user_id AS job_id, max_by(st, struct_pack(ts := ts, e := event_id)) AS status, count(*) FILTER (st = 'running') AS attempt_count, max(ts) FILTER (st = 'completed') AS completed_at FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS st FROM events) GROUP BY 1")
def g08(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in (("signup", "pending"), ("click", "running"), ("purchase", "completed"), ("error", "failed"), ("view", "skipped")) for x in kv])
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), kinds[F.col("event_type")].alias("status"), "ts", F.col("event_id").alias("seq"))
    return jobs.fold_states(e)


_RESPONSES = """r AS (SELECT record_id, original_source, concept, negative_template, batch_no, list_sort(list_distinct(list_filter(coalesce(wildcard_refs, []), lambda x: x <> 'concept'))) AS keys FROM lexica_cleaned),
 g AS (SELECT *, list_filter(keys, lambda x: length(x) % 2 = 0) AS gone FROM r)"""


@R.add(
    "g07_response_errors",
    f"""WITH {_RESPONSES} SELECT record_id, CASE WHEN original_source IS NULL THEN 'not an object' WHEN concept IS NULL THEN 'missing key: notes' WHEN negative_template IS NULL THEN 'not a string: notes'
    WHEN batch_no % 7 = 0 THEN 'unbound: zz' WHEN len(gone) > 0 THEN 'omitted: ' || array_to_string(gone, ',') END AS error FROM g""",
)
def g07(spark, d):
    """Responses made of the records: an array where there is no source, notes left out or a number, a placeholder too many, and
    some keys left out."""
    r = table(spark, d, "lexica_cleaned").withColumn("wildcard_refs", F.coalesce("wildcard_refs", F.array().cast("array<string>")))
    kept = F.array_join(F.transform(F.filter("wildcard_refs", lambda x: F.length(x) % 2 != 0), lambda x: F.concat(F.lit(" {"), x, F.lit("}"))), "")
    positive = F.concat(F.regexp_replace(F.coalesce("original_prompt", F.lit("")), r"[{}]|__", " "), kept, F.when(F.col("batch_no") % 7 == 0, F.lit(" {zz}")).otherwise(F.lit("")))
    negative = F.lit("").alias("negative_template")
    text = F.to_json(F.struct(positive.alias("positive_template"), negative, F.col("concept").alias("notes")))
    number = F.to_json(F.struct(positive.alias("positive_template"), negative, F.length("concept").alias("notes")))
    response = F.when(F.col("original_source").isNull(), F.lit("[1]")).when(F.col("negative_template").isNull(), number).otherwise(text)
    required = F.array_remove(F.array_distinct("wildcard_refs"), "concept")
    return r.select("record_id", jobs.response_error(response, required).alias("error"))


@R.add("g07_tasks", BASE + f", {_TARGETS}, {_JOBS}, {_CELLS} SELECT prompt_id, style_id, identifier FROM cells JOIN prompts ON prompts.id = prompt_id")
def g07t(spark, d):
    lib = Library(spark, d)
    styles = lib.t("prompt_style_profiles").select(F.col("id").alias("style_id"), F.col("identifier").alias("style"), "syntax_family", F.col("negative_prompt_strategy").alias("strategy"), F.coalesce("ordering_notes", F.lit("")).alias("description"))
    t = jobs.build_tasks(_cells(spark, d), lib.prompts, lib.templates, styles)
    return t.select("prompt_id", "style_id", F.get_json_object("task", "$.prompt_identifier").alias("identifier"))


def _pool(spark, d, k):
    s = scored(spark, d).withColumn("score", F.round("score", 6)).where((F.col("n_tokens") >= 6) & (F.col("score") >= S.LEAST_SCORE))
    return evalset.top_per_domain(s.select("record_id", "domain", "score", "tags", "signature"), k)


_POOL = f"""WITH {SCORED}, sig AS (SELECT record_id, list_sort(list_distinct(list_slice(list_filter(regexp_extract_all(lower(coalesce(concept, '') || ' ' || coalesce(positive_template, '')), '[a-z0-9][a-z0-9_-]*'), lambda x: length(x) > 2 AND NOT list_contains({S.STOP_WORDS + S.GENERIC_WORDS}, x)), 1, 80))) AS s FROM lexica_cleaned),
 pool AS (SELECT record_id, domain, s, rank FROM (SELECT record_id, domain, row_number() OVER (PARTITION BY domain ORDER BY score DESC, record_id) AS rank FROM scored WHERE n >= 6 AND score >= 8) JOIN sig USING (record_id) WHERE rank <= 2500)"""


@R.add("j14_similar_pairs", _POOL + """ SELECT domain, a, b, similarity FROM (SELECT x.domain, x.record_id AS a, y.record_id AS b, CASE WHEN len(x.s) = 0 OR len(y.s) = 0 THEN 0.0 ELSE round(len(list_intersect(x.s, y.s)) / CAST(len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) AS DOUBLE), 6) END AS similarity FROM pool x JOIN pool y ON x.domain = y.domain AND x.rank < y.rank) WHERE similarity >= 0.72""")
def j14(spark, d):
    return evalset.similar_pairs(_pool(spark, d, 2500)).select("domain", "a", "b", F.round("similarity", 6).alias("similarity"))


@R.add("m06_jaccard", f"""SELECT record_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) END AS similarity FROM
 (SELECT record_id, list_distinct(regexp_extract_all(lower(coalesce(original_prompt, '')), '[a-z0-9][a-z0-9_-]*')) AS a, list_distinct(regexp_extract_all(lower(coalesce(positive_template, '')), '[a-z0-9][a-z0-9_-]*')) AS b FROM lexica_cleaned)""")
def m06(spark, d):
    s = lambda c: F.array_distinct(S.tokens(F.coalesce(c, F.lit(""))))
    return table(spark, d, "lexica_cleaned").select("record_id", F.round(S.jaccard(s("original_prompt"), s("positive_template")), 6).alias("similarity"))


@R.add("m08_stable_seed")
def m08(spark, d):
    @F.pandas_udf("bigint")
    def seed(i: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([evalset.stable_seed(a, b) for a, b in zip(i, n)], dtype="int64")

    return table(spark, d, "lexica_cleaned").select("record_id", seed(F.coalesce("identifier", F.lit("")), F.col("record_id")).alias("seed"))


@R.add("m09_quotas", "SELECT CAST(n AS BIGINT) AS target, domain, CAST(n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS INT) AS quota FROM range(1, 301) AS r(n), (VALUES ('photography', 0), ('anime-cartoon', 1), ('illustration-painting', 2), ('cgi-render', 3), ('mixed-hard-general', 4)) AS t(domain, k)")
def m09(spark, d):
    return spark.createDataFrame([(n, k, q) for n in range(1, 301) for k, q in evalset.quotas(n).items()], "target bigint, domain string, quota int")


@R.add("g03_diverse")
def g03(spark, d):
    return evalset.diverse(_pool(spark, d, 2500), 25)


@R.add("g04_eval_sets")
def g04(spark, d):
    return evalset.build_sets(_pool(spark, d, 2500), 100, 25)


@R.add("k04_report")
def k04(spark, d):
    return evalset.report_lines(evalset.build_sets(_pool(spark, d, 2500), 100, 25), table(spark, d, "lexica_cleaned"))


@R.add("s01_orphans", BASE + "SELECT record_id AS prompt_id, batch_no FROM lexica_cleaned WHERE batch_no IS NOT NULL AND batch_no NOT IN (SELECT batch_no FROM manifest)")
def s01(spark, d):
    r = table(spark, d, "lexica_cleaned").select(F.col("record_id").alias("prompt_id"), "batch_no")
    return library.orphans(r, table(spark, d, "manifest"), "batch_no", "batch_no").select("prompt_id", "batch_no")


@R.add("q21_quarantine", "SELECT record_id, 'status: ' || coalesce(status, 'null') AS reason FROM lexica_cleaned WHERE status IS NULL OR status NOT IN ('draft', 'active', 'deprecated', 'archived')")
def q21(spark, d):
    from quillspark.schema import quarantine

    return quarantine(table(spark, d, "lexica_cleaned").select("record_id", "status"), "prompts")[1].select("record_id", "reason")


@R.add("x01_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x01(spark, d):
    from quillspark.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@R.add("x02_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, g""")
def x02(spark, d):
    from quillspark.streaming.ingest import sessions

    return sessions(table(spark, d, "events"))


@R.add("j06_semi_join", BASE + f", {_MEMBERS} SELECT id FROM prompts WHERE EXISTS (SELECT 1 FROM members WHERE prompt_id = id AND enabled)")
def j06(spark, d):
    lib = Library(spark, d)
    return lib.prompts.select("id").join(_members(lib).where("enabled").select(F.col("prompt_id").alias("id")), "id", "left_semi")


@R.add("j10_unbound_keys", BASE + f"SELECT unnest({_KEYS_OF}) AS wildcard_key FROM templates WHERE enabled EXCEPT SELECT wildcard_key FROM bindings JOIN definitions USING (definition_id, wildcard_key) WHERE status = 'active'")
def j10(spark, d):
    """Keys that enabled templates use and no prompt binds to an active definition."""
    lib = Library(spark, d)
    used = lib.templates.where("enabled").select(F.explode(T.placeholder_keys(F.col("positive"))).alias("wildcard_key")).distinct()
    bound = lib.bindings.join(lib.definitions.where("status = 'active'").select("definition_id"), "definition_id").select("wildcard_key").distinct()
    return used.join(bound, "wildcard_key", "left_anti")


@R.add("g09_worker", BASE + f", {_TARGETS}, {_JOBS}, {_CELLS} SELECT prompt_id, style_id, CASE WHEN prompt_id % 3 = 0 THEN 'no answer' END AS error FROM cells")
def g09(spark, d):
    lib = Library(spark, d)
    styles = lib.t("prompt_style_profiles").select(F.col("id").alias("style_id"), F.col("identifier").alias("style"), "syntax_family", F.col("negative_prompt_strategy").alias("strategy"), F.coalesce("ordering_notes", F.lit("")).alias("description"))
    cells = _cells(spark, d)
    tasks = jobs.build_tasks(cells, lib.prompts.withColumn("identifier", F.col("id").cast("string")), lib.templates, styles)

    def worker(task: str) -> str:
        import json

        t = json.loads(task)
        if int(t["prompt_identifier"]) % 3 == 0:
            raise RuntimeError("no answer")
        return json.dumps({"positive_template": t["source_positive_template"], "negative_template": "", "notes": ""})

    done = jobs.run_worker(tasks, worker)
    return done.select("prompt_id", "style_id", "error")


@R.add("u15_dry_run_actions", _UPS + " SELECT action, count(*) AS n FROM act GROUP BY 1")
def u15(spark, d):
    return _upsert(spark, d).actions.groupBy("action").agg(F.count("*").alias("n"))
