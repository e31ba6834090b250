"""Queries for parsers, mining and pipelines, over documents, pages and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.categories import CATEGORIES
from quillspark.operators import mining
from quillspark.session import table
from quillspark.sources import files
from quillspark.sources import parsers as P

from . import pipelines, text_queries
from .fixtures import BASE, Library
from .registry import Registry

R = Registry()
_DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_LAB = "(?i)^(" + "|".join(T.LABELS) + r")\s*:\s*(.+)$"
_STRIP = "regexp_replace({}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda y: {_STRIP.format('y')}), lambda y: y <> '')"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null")


_FORMAT = f"""CASE WHEN regexp_matches(text, '(?i)\\[config\\]|\\[prompts\\]') THEN 'dream_factory'
    WHEN len({_LINES}) > 0 AND len(list_filter({_LINES}, lambda y: regexp_matches(y, '{_LAB}'))) / len({_LINES}) > 0.5 THEN 'structured'
    WHEN regexp_matches(text, '(?m)^###\\s+(.+?)\\s*$') THEN 'sectioned' ELSE 'raw' END"""


@R.add("s04_detect_format", f"WITH {_DOCS} SELECT doc_id, {_FORMAT} AS format FROM docs")
def s04(spark, d):
    return _docs(spark, d).select("doc_id", P.detect_format(F.col("text")).alias("format"))


_BLOCKS = f"blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS idx, raw FROM (SELECT doc_id, unnest(range(len(p))) AS pos, {_STRIP.format('unnest(p)')} AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[\\s\\pZ]*\\n') AS p FROM docs)) WHERE raw <> '')"


@R.add("s05_blocks", f"WITH {_DOCS}, {_BLOCKS} SELECT doc_id, idx, raw FROM blocks")
def s05(spark, d):
    return P.blocks(_docs(spark, d)).select("doc_id", "idx", "raw")


_WS = r"[\s\pZ\x{85}]"
_SECTIONS = f"""ps AS (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n###{_WS}+([^\n]+?){_WS}*\n', '\x01\\1\x01', 'g'), '\x01') AS p FROM docs),
    pt AS (SELECT doc_id, k, part, regexp_matches(part, '^(Midjourney|Nano|Flux)') AS named FROM (SELECT doc_id, unnest(range(len(p))) AS k, {_STRIP.format('unnest(p)')} AS part FROM ps) WHERE part <> ''),
    sc AS (SELECT *, coalesce(last_value(CASE WHEN named THEN replace(replace(replace(lower(part), ' prompts', ''), ' prommpts', ''), ' ', '-') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), 'stable-diffusion') AS section FROM pt),
    bl AS (SELECT doc_id, k, section, unnest(range(len(b))) AS j, {_STRIP.format('unnest(b)')} AS raw FROM (SELECT doc_id, k, section, regexp_split_to_array(part, '\n{_WS}*\n') AS b FROM sc WHERE NOT named)),
    sectioned AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INT) AS pos, section, raw FROM bl WHERE raw <> '')"""


@R.add("s06_sectioned", f"WITH {_DOCS}, {_SECTIONS} SELECT doc_id, pos, section, raw FROM sectioned")
def s06(spark, d):
    return P.sectioned(_docs(spark, d))


_RECORDS = f"""fl AS (SELECT doc_id, pos, line, regexp_matches(line, '{_LAB}') AS f FROM (SELECT doc_id, unnest(range(len(p))) AS pos, {_STRIP.format('unnest(p)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM docs)) WHERE line <> ''),
    gr AS (SELECT *, CAST(sum(CASE WHEN NOT f AND pf THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INT) AS idx FROM (SELECT *, coalesce(lag(f) OVER (PARTITION BY doc_id ORDER BY pos), false) AS pf FROM fl))"""


@R.add("s07_structured", f"WITH {_DOCS}, {_RECORDS} SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY pos) AS raw FROM gr GROUP BY 1, 2")
def s07(spark, d):
    return P.structured(_docs(spark, d))


_GENERATOR = f"""gl AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(p))) AS pos, {_STRIP.format('unnest(p)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM docs)) WHERE line <> '' AND NOT starts_with(line, '#')),
    gk AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\\[config\\]') THEN 'c' WHEN regexp_matches(line, '(?i)^\\[prompts\\]') THEN 'p' END AS mark FROM gl),
    gs AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS sec, sum(CASE WHEN mark = 'p' THEN 1 ELSE 0 END) OVER w AS b FROM gk WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    generator AS (SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INT) AS block, CAST(row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) - 1 AS INT) AS pos, line FROM gs WHERE mark IS NULL AND sec = 'p')"""


@R.add("s08_generator_lines", f"WITH {_DOCS}, {_GENERATOR} SELECT doc_id, block, pos, line FROM generator")
def s08(spark, d):
    return P.generator(_docs(spark, d))[1]


@R.add("s08_generator_settings", f"WITH {_DOCS} SELECT doc_id, trim(regexp_extract(text, '(?m)^!NEG_PROMPT\\s*=\\s*(.+)$', 1), ' ' || chr(13)) AS negative FROM docs WHERE regexp_matches(text, '(?i)\\[config\\]') AND regexp_matches(text, '(?m)^!NEG_PROMPT\\s*=')")
def s08s(spark, d):
    return P.generator(_docs(spark, d))[0].where("negative is not null").select("doc_id", "negative")


_FIELDS = f"""fv AS (SELECT doc_id, idx, k, string_agg(v, ' ' ORDER BY pos) AS v FROM (SELECT doc_id, idx, pos, {_STRIP.format(f"regexp_extract(line, '{_LAB}', 1)")} AS k, {_STRIP.format(f"regexp_extract(line, '{_LAB}', 2)")} AS v FROM gr WHERE f) GROUP BY 1, 2, 3),
    fm AS (SELECT doc_id, idx, string_agg(k || '=' || v, '|' ORDER BY k) AS fields, trim(coalesce(max(CASE WHEN k = 'Subject' THEN v END), '') || ', ' || coalesce(max(CASE WHEN k = 'Environment' THEN v END), ''), ', ') AS fallback FROM fv GROUP BY 1, 2),
    fc AS (SELECT doc_id, idx, coalesce(string_agg(CASE WHEN NOT f THEN line END, ' ' ORDER BY pos), '') AS t FROM gr GROUP BY 1, 2),
    fielded AS (SELECT doc_id, idx, CASE WHEN t = '' AND fields IS NOT NULL THEN fallback ELSE t END AS concept, fields FROM fc LEFT JOIN fm USING (doc_id, idx))"""


@R.add("s09_fields", f"WITH {_DOCS}, {_RECORDS}, {_FIELDS} SELECT doc_id, idx, concept, fields FROM fielded WHERE fields IS NOT NULL")
def s09(spark, d):
    f = P.fields_of(P.structured(_docs(spark, d)))
    return f.where(F.size("fields") > 0).select("doc_id", "idx", "concept", F.array_join(F.transform(F.sort_array(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("fields"))


_ENTRY = r"(?i)^[\s\pZ]*(?:(?:prompt[\s\pZ]*)?[0-9]{1,5}[\s\pZ]*[\.):-][\s\pZ]*|prompt[\s\pZ]*[0-9]{0,5}[\s\pZ]*[:.-][\s\pZ]*|/imagine[\s\pZ]+prompt:?[\s\pZ]*)"
_NORMAL = "trim(regexp_replace(replace(replace(replace(replace(replace(unnest(p), '&amp;', '&'), chr(64257), 'fi'), chr(64258), 'fl'), chr(8212), '-'), chr(8211), '-'), '[\\s\\pZ]+', ' ', 'g'))"


_INBOX = f"""l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(p))) AS pos, {_NORMAL} AS line FROM (SELECT page_id AS doc_id, regexp_split_to_array(original_prompt, '\\r\\n|[\\n\\r]') AS p FROM inbox_pages WHERE original_prompt IS NOT NULL)) WHERE NOT regexp_matches(line, '^[0-9]{{1,4}}$')),
    s AS (SELECT *, regexp_matches(line, '{_ENTRY}') AS st FROM l), o AS (SELECT *, coalesce(last_value(CASE WHEN st THEN true WHEN line = '' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS inside FROM s),
    g AS (SELECT *, sum(CASE WHEN st OR NOT inside THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS idx FROM o WHERE line <> ''),
    inbox AS (SELECT doc_id, CAST(idx AS INT) AS idx, block FROM (SELECT doc_id, idx, trim(string_agg(CASE WHEN st THEN trim(regexp_replace(line, '{_ENTRY}', '')) ELSE line END, ' ' ORDER BY pos)) AS block FROM g GROUP BY 1, 2) WHERE block <> '')"""


@R.add("s10_inbox_blocks", f"WITH {_INBOX} SELECT doc_id, idx, block FROM inbox")
def s10(spark, d):
    p = table(spark, d, "inbox_pages").where("original_prompt is not null").select(F.col("page_id").alias("doc_id"), F.col("original_prompt").alias("text"))
    return P.inbox_blocks(p)


@R.add("s13_phrase_list", "SELECT DISTINCT unnest(list_concat([lower(p_name)], regexp_extract_all(lower(p_name), '[a-z0-9][a-z0-9_-]*'))) AS token FROM part")
def s13(spark, d):
    line = F.format_string(" %d %s %d.5 %d", "p_partkey", "p_name", "p_size", "p_size")
    return P.phrase_list(table(spark, d, "part").select(line.alias("value")))


@R.add("s16_numbered", f"WITH {_DOCS} SELECT doc_id, CAST(regexp_extract(l, '(\\d+)\\.', 1) AS BIGINT) AS num, {_STRIP.format(chr(39).join(['regexp_replace(l, ', '^[\\s\\pZ]*\\d+\\.[\\s\\pZ]*', ', ', '', ')']))} AS text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[\\s\\pZ]*\\d+\\.[\\s\\pZ]*.+?$')) AS l FROM docs) WHERE CAST(regexp_extract(l, '(\\d+)\\.', 1) AS BIGINT) BETWEEN 1 AND 20")
def s16(spark, d):
    return P.numbered(_docs(spark, d))


_BOOK = "'Intro' || chr(10) || '1. ' || p_brand || chr(10) || 'Prompt sample: \"' || p_name || chr(10) || ' wide\"' || chr(10) || '2. ' || p_type || chr(10) || 'text' || chr(10) || 'Prompt sample: \"dim\"' || chr(10) || 'Prompt sample: \"lit\"'"


@R.add("s17_headed_samples", "SELECT p_partkey AS doc_id, CAST(n AS BIGINT) AS num, CASE n WHEN 1 THEN p_brand ELSE p_type END AS title, CASE s WHEN 'a' THEN p_name || ' wide' WHEN 'b' THEN 'dim' ELSE 'lit' END AS sample FROM part, (VALUES (1, 'a'), (2, 'b'), (2, 'c')) AS t(n, s)")
def s17(spark, d):
    t = F.concat(F.lit("Intro\n1. "), "p_brand", F.lit('\nPrompt sample: "'), "p_name", F.lit('\n wide"\n2. '), "p_type", F.lit('\ntext\nPrompt sample: "dim"\nPrompt sample: "lit"'))
    return P.headed_samples(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")))


@R.add("s18_continued_titles", "SELECT p_partkey AS doc_id, CAST(n AS BIGINT) AS num, CASE n WHEN 1 THEN p_brand ELSE p_type END AS title, CASE n WHEN 1 THEN p_name || ' and more' ELSE 'plain' END AS text, CASE n WHEN 1 THEN 'General' ELSE 'Design' END AS category FROM part, (VALUES (1), (2)) AS t(n)")
def s18(spark, d):
    t = F.concat(F.lit("note\n#1. "), "p_brand", F.lit(": "), "p_name", F.lit("\n12/44\nand more\nDesign\n#2. "), "p_type", F.lit(": plain"))
    return P.continued_titles(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")), {"Design": "Design", "Photographic": "Photorealistic"})


@R.add("s19_chapter", "SELECT p_partkey AS doc_id, CAST(n AS VARCHAR) AS num, CASE n WHEN 1 THEN p_brand ELSE p_type END AS title, CASE n WHEN 1 THEN p_name ELSE 'x' END AS text FROM part, (VALUES (1), (2)) AS t(n)")
def s19(spark, d):
    t = F.concat(F.lit('0. skip\nPrompt: "no"\nBEGIN\n1. '), "p_brand", F.lit('\nPrompt: "'), "p_name", F.lit('"\n2. '), "p_type", F.lit('\nPrompt: "x"\nEND 3. z\nPrompt: "no"'))
    return P.chapter(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")), "BEGIN", "END", r'(\d+)\.\s*(.+?)\n\s*Prompt:\s*"([^"]+)"')


@R.add("s20_example_book", "SELECT p_partkey AS doc_id, CAST(0 AS INT) AS idx, 'a long enough ' || p_name AS positive, 'blurry' AS negative FROM part")
def s20(spark, d):
    t = F.concat(F.lit("Example 1:\nPrompt\na long enough "), "p_name", F.lit("\n\nNegative Prompt\nblurry\nParameters and Data\nsteps\nADetailer\nPrompt\nthis prompt is left out here\nParameter"))
    return P.example_book(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t.alias("text")))


@R.add("s22_text_sources", BASE + "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT positive AS text FROM templates WHERE enabled AND positive <> '' UNION ALL SELECT negative FROM templates WHERE negative <> '' UNION ALL SELECT json_extract_string(metadata, '$.original_prompt') FROM prompts WHERE json_valid(metadata)) WHERE text IS NOT NULL AND text <> ''")
def s22(spark, d):
    lib = Library(spark, d)
    t = mining.text_sources(lib.templates, lib.prompts).where("text <> ''")
    return t.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _ascii(pattern: str) -> list[tuple[str, int]]:
    """(pattern, group): RE2 sees no end of a word after an accented letter, so such a word has a pattern of its own."""
    return [(pattern.replace("eé", "e"), 0), (r"(?:^|[^\pL\pN_])(café)(?:$|[^\pL\pN_])", 1)] if "é" in pattern else [(pattern, 0)]


_SOURCES = """src AS (SELECT lower(positive) AS t FROM templates WHERE enabled AND positive <> '' UNION ALL SELECT lower(negative) FROM templates WHERE negative <> ''
    UNION ALL SELECT lower(json_extract_string(metadata, '$.original_prompt')) FROM prompts WHERE json_valid(metadata) AND json_extract_string(metadata, '$.original_prompt') <> ''
    UNION ALL SELECT lower(unnest(json_extract_string(metadata, '$.structured_fields.*'))) FROM prompts WHERE json_valid(metadata))"""
_COUNTS = (
    BASE + f", {_SOURCES}, m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS category, {_STRIP.format(f'unnest(regexp_extract_all(t, {chr(39)}{text_queries._re(x)}{chr(39)}, {g}))')} AS term FROM src" for c, ps in CATEGORIES.items() for p in ps for x, g in _ascii(p))
    + "), counted AS (SELECT category, term, count(*) AS n FROM m WHERE length(term) > 2 GROUP BY 1, 2 HAVING count(*) >= 2) "
)


def _counts(spark, d):
    lib = Library(spark, d)
    return mining.term_counts(mining.text_sources(lib.templates, lib.prompts))


@R.add("a04_term_counts", _COUNTS + "SELECT category, term, n FROM counted")
def a04(spark, d):
    return _counts(spark, d)


_VOCAB = r"vocab AS (SELECT category, term, max(n) AS n FROM (SELECT category, trim(trim(regexp_replace(term, '\s+', ' ', 'g')), ',.;:') AS term, n FROM counted) GROUP BY 1, 2)"


@R.add("a05_weights", _COUNTS.rstrip() + f", {_VOCAB} SELECT category, term, n, round(least(n / 5.0, 2.0), 2) AS weight FROM vocab")
def a05(spark, d):
    return mining.vocabulary(_counts(spark, d))


@R.add("t04_top_terms", _COUNTS.rstrip() + f", {_VOCAB} SELECT category, term, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS INT) AS rank FROM vocab) WHERE rank <= 5")
def t04(spark, d):
    return mining.top_terms(mining.vocabulary(_counts(spark, d))).select("category", "term", "n", "rank")


@R.add("g11_mine_all", R.sql["a05_weights"])
def g11(spark, d):
    lib = Library(spark, d)
    return mining.vocabulary(mining.term_counts(mining.text_sources(lib.templates, lib.prompts)))


def _vocab_tables(spark, d):
    """The mined vocabulary as definitions and values."""
    found = g11(spark, d)
    defs = spark.createDataFrame([(k + 1, c, "active") for k, c in enumerate(sorted(CATEGORIES))], "definition_id bigint, wildcard_key string, status string")
    return defs, found.join(defs, found["category"] == defs["wildcard_key"]).select("definition_id", F.col("term").alias("value"), "weight")


def _rewritten(name: str, text: str, values: str) -> str:
    """CTEs that rewrite a text of templates: all hits of the longest-first alternation, and what stands between them."""
    return f"""{name}k AS (SELECT lower(term) AS v, max(category) AS k FROM {values} GROUP BY 1),
    {name}p AS (SELECT '(?i)\\b(?:' || string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) || ')\\b' AS p FROM (SELECT DISTINCT term FROM {values})),
    {name}s AS (SELECT template_id, regexp_extract_all({text}, p) AS hits, regexp_split_to_array({text}, p) AS parts FROM templates, {name}p WHERE enabled),
    {name}h AS (SELECT template_id, i, part, k, coalesce(k = lag(k) OVER (PARTITION BY template_id ORDER BY i) AND trim(part) = '', false) AS again FROM (SELECT template_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(list_slice(parts, 1, len(hits))) AS part FROM {name}s) JOIN {name}k ON v = lower(hit)),
    {name}o AS (SELECT template_id, coalesce(max(o), '') || any_value(parts[-1]) AS out, max(ks) AS ks FROM {name}s LEFT JOIN (SELECT template_id, string_agg(CASE WHEN again THEN '' ELSE part || '{{' || k || '}}' END, '' ORDER BY i) AS o, list(DISTINCT k) AS ks FROM {name}h GROUP BY 1) USING (template_id) GROUP BY 1)"""


_RETROFIT = (
    _COUNTS.rstrip() + f", {_VOCAB}, wide AS (SELECT * FROM vocab WHERE contains(term, ' ') OR contains(term, '-')), narrow AS (SELECT * FROM wide WHERE category <> 'style_negative'), "
    + _rewritten("pos_", "positive", "narrow") + ", " + _rewritten("neg_", "negative", "wide")
    + ", retro AS (SELECT t.template_id, t.prompt_id, pos_o.out AS positive, neg_o.out AS negative, list_sort(list_distinct(list_concat(coalesce(pos_o.ks, []), coalesce(neg_o.ks, [])))) AS ks FROM templates t JOIN pos_o USING (template_id) JOIN neg_o USING (template_id))"
)


@R.add("n24_retrofit", _RETROFIT + " SELECT template_id, prompt_id, positive, negative, array_to_string(ks, '|') AS keys FROM retro")
def n24(spark, d):
    lib = Library(spark, d)
    r = mining.retrofit(lib.templates, *_vocab_tables(spark, d))
    return r.select("template_id", "prompt_id", "positive", "negative", F.array_join("keys", "|").alias("keys"))


_DEFS = ", ".join(f"({k + 1}, '{c}')" for k, c in enumerate(sorted(CATEGORIES)))


@R.add("u14_new_bindings", _RETROFIT + f" SELECT prompt_id, CAST(id AS BIGINT) AS definition_id FROM (SELECT DISTINCT prompt_id, unnest(ks) AS k FROM retro) JOIN (VALUES {_DEFS}) AS d(id, c) ON c = k WHERE (prompt_id, id) NOT IN (SELECT record_id, CASE WHEN lower(status) = 'active' THEN {sorted(CATEGORIES).index('lighting') + 1} ELSE {sorted(CATEGORIES).index('color_palette') + 1} END FROM lexica_cleaned WHERE record_id IS NOT NULL)")
def u14(spark, d):
    """New bindings beside stored ones: active records are bound to one category already, the others to another."""
    lib = Library(spark, d)
    defs, vals = _vocab_tables(spark, d)
    key = F.when(F.lower("status") == "active", "lighting").otherwise("color_palette")
    stored = lib.records.select(F.col("record_id").alias("prompt_id"), key.alias("wildcard_key")).join(defs, "wildcard_key")
    return mining.new_bindings(mining.retrofit(lib.templates, defs, vals), defs, stored)


@R.add("n19_block_keys", "SELECT p_partkey, CASE WHEN contains(l, 'woman') OR contains(l, 'man') THEN 'gender' WHEN contains(l, 'old') THEN 'age' WHEN p_size % 2 = 0 THEN 'literal_' || lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE 'option_' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS key FROM (SELECT p_partkey, p_size, lower(CASE p_partkey % 3 WHEN 0 THEN 'Gold ring' WHEN 1 THEN 'German cup' ELSE 'plain cup' END) AS l FROM part)")
def n19(spark, d):
    first = F.when(F.col("p_partkey") % 3 == 0, "Gold ring").when(F.col("p_partkey") % 3 == 1, "German cup").otherwise("plain cup")
    return table(spark, d, "part").select("p_partkey", P.block_key(first, F.col("p_size"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(2)).alias("key"))


def _chain(x: str) -> str:
    for name, _ in T.clean_steps():
        x = text_queries._SQL_STEPS[name](x)
    return x


_BLOCK_KEY = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{k}'" for w, k in P.KEY_WORDS) + " ELSE CASE WHEN n = 1 THEN 'literal_' ELSE 'option_' END || CASE WHEN block < 10 THEN lpad(CAST(block AS VARCHAR), 2, '0') ELSE CAST(block AS VARCHAR) END END"
_TEMPLATES = f"""tb AS (SELECT doc_id, block, count(*) AS n, arg_min(line, pos) AS first, lower(arg_min(line, pos)) AS low FROM generator GROUP BY 1, 2),
    tk AS (SELECT *, n = 1 AND (starts_with(first, ',') OR first IN ('close up of 1', 'descent,')) AS lit, {_BLOCK_KEY} AS k FROM tb),
    tp AS (SELECT doc_id, string_agg(CASE WHEN lit AND first = 'close up of 1' THEN 'close up portrait of 1' WHEN lit THEN first ELSE '{{' || k || '}}' END, ' ' ORDER BY block) AS t, coalesce(string_agg(CASE WHEN NOT lit THEN k END, '|' ORDER BY block), '') AS keys FROM tk GROUP BY 1),
    tt AS (SELECT doc_id, keys, trim(replace(replace(regexp_replace({_STRIP.format(f"regexp_replace(t, '{_WS}+', ' ', 'g')")}, '{_WS}*,{_WS}*', ', ', 'g'), ' ,', ','), ',  ', ', '), ', ') AS t FROM tp)"""


@R.add("n20_generator_templates", f"WITH {_DOCS}, {_GENERATOR}, {_TEMPLATES} SELECT doc_id, CASE WHEN starts_with(t, '{{') THEN t ELSE upper(left(t, 1)) || substr(t, 2) END AS template, keys FROM tt WHERE t <> ''")
def n20(spark, d):
    t = P.generator_template(P.generator(_docs(spark, d))[1])
    return t.select("doc_id", "template", F.array_join("keys", "|").alias("keys"))


_CUT = f"list_filter(list_transform(string_split(raw, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_POSITIVE = f"""{_STRIP.format("array_to_string(list_filter(string_split(raw, chr(10)), lambda x: NOT regexp_matches(" + _STRIP.format("x") + f", '{text_queries._NEG}')), chr(10))")}"""
_RECORD_SQL = f"""cd AS (SELECT *, {_POSITIVE} AS positive,
      {_STRIP.format("regexp_replace(list_extract(list_filter(list_transform(string_split(raw, chr(10)), lambda x: " + _STRIP.format("x") + f"), lambda x: regexp_matches(x, '{text_queries._NEG}')), -1), '{text_queries._NEG}', '')")} AS negative_raw FROM rec),
    cj AS (SELECT *, coalesce(regexp_matches(positive, '(?s)^\\{{.*\\}}$') AND json_valid(positive), false) AS js FROM cd),
    cc AS (SELECT *, CASE WHEN js OR fielded THEN positive ELSE {_chain("positive")} END AS cleaned FROM cj),
    ct AS (SELECT *, {_STRIP.format("cleaned")} AS t, CASE WHEN js THEN 'structured json prompt' WHEN fielded AND field_concept <> '' THEN field_concept ELSE {text_queries._CONCEPT.format("cleaned")} END AS concept FROM cc),
    cs AS (SELECT *, CASE WHEN js THEN '' ELSE array_to_string(list_transform(list_slice({text_queries._WORDS.format("regexp_replace(lower(concept), '[[:space:]]+', ' ', 'g')")}, 1, 4), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), '_') END AS slug FROM ct)"""


@R.add(
    "n25_clean_documents",
    f"""WITH {_DOCS}, fmt AS (SELECT doc_id, {_FORMAT} AS format FROM docs), {_SECTIONS}, {_RECORDS}, {_FIELDS}, {_BLOCKS},
    rec AS (SELECT doc_id, idx, 'raw' AS format, raw, false AS fielded, NULL AS field_concept FROM blocks JOIN fmt USING (doc_id) WHERE format = 'raw'
      UNION ALL SELECT doc_id, pos, 'sectioned', raw, false, NULL FROM sectioned JOIN fmt USING (doc_id) WHERE format = 'sectioned'
      UNION ALL SELECT doc_id, idx, 'structured', raw, fields IS NOT NULL, concept FROM (SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY pos) AS raw FROM gr GROUP BY 1, 2) JOIN fielded USING (doc_id, idx) JOIN fmt USING (doc_id) WHERE format = 'structured'),
    {_RECORD_SQL}
    SELECT doc_id, idx, format, cleaned, negative_raw, {text_queries._REASON} AS reject_reason, concept,
    CASE WHEN js THEN 'structured_' ELSE '' END || CASE WHEN slug = '' THEN 'prompt' ELSE slug END || '_' || CASE WHEN idx >= 100 THEN CAST(idx AS VARCHAR) ELSE lpad(CAST(idx AS VARCHAR), 3, '0') END AS identifier,
    CAST(CASE WHEN js THEN 1 WHEN fielded THEN 4 ELSE 2 + CAST({text_queries._sent("cleaned", 30)} >= 2 AS INT) + CAST({text_queries._WEIGHTED.format("raw")} AS INT) END AS INT) AS n_variants FROM cs""",
)
def n25(spark, d):
    c = pipelines.clean_documents(_docs(spark, d))
    return c.select("doc_id", "idx", "format", "cleaned", "negative_raw", "reject_reason", "concept", "identifier", F.size("variants").alias("n_variants"))


@R.add("g10_profile", "SELECT style, count(*) AS n FROM (" + __import__("quillspark.plans.text_queries", fromlist=["_STYLED"])._STYLED + ") GROUP BY 1")
def g10(spark, d):
    r = table(spark, d, "lexica_cleaned").where("original_prompt is not null")
    return r.groupBy(T.detect_style(F.col("original_prompt")).alias("style")).agg(F.count("*").alias("n"))


_CLEANED = _chain(r"replace(regexp_replace(original_prompt, '\{([^{}]*)\}', '\1', 'g'), '__', '_')")


@R.add(
    "g12_pack_ingest",
    f"""WITH r AS (SELECT rejected_id AS idx, 'pack_' || substr(sha1(original_prompt), 1, 16) AS identifier, date_added IS NULL AS undated, {_CLEANED} AS cleaned FROM civitai_rejected WHERE original_prompt IS NOT NULL),
    k AS (SELECT DISTINCT identifier FROM r WHERE undated), n AS (SELECT r.*, row_number() OVER (PARTITION BY identifier ORDER BY idx) AS nth, identifier IN (SELECT identifier FROM k) AS stored, {_STRIP.format("coalesce(cleaned, '')")} AS t FROM r),
    v AS (SELECT *, {text_queries._REASON} AS reject_reason FROM n)
    SELECT idx, identifier, CASE WHEN stored OR nth > 1 THEN 'skipped' WHEN reject_reason IS NOT NULL THEN 'rejected' ELSE 'imported' END AS outcome, reject_reason, cleaned, {text_queries._CONCEPT.format("cleaned")} AS concept FROM v""",
)
def g12(spark, d):
    r = table(spark, d, "civitai_rejected").where("original_prompt is not null").select(F.col("rejected_id").alias("idx"), F.col("original_prompt").alias("line"), F.lit("blurry").alias("negative"), "date_added")
    known = r.where("date_added is null").select(F.concat(F.lit("pack_"), F.substring(F.sha1("line"), 1, 16)).alias("identifier"))
    return pipelines.pack_rows(r, known, "pack").select("idx", "identifier", "outcome", "reject_reason", "cleaned", "concept")


def _inbox(spark, d):
    p = table(spark, d, "inbox_pages").where("original_prompt is not null")
    return p.select(F.col("page_id").alias("doc_id"), T.slugify(F.regexp_replace("source_file", r"\.txt$", "")).alias("slug"), F.col("original_prompt").alias("text"))


_ENTRIES = f"""lk AS (SELECT doc_id, idx, block FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY idx) AS nth FROM (SELECT *, {text_queries.normal_line("block")} AS t FROM inbox) WHERE {text_queries.LOOKS_LIKE}) WHERE nth = 1),
    lc AS (SELECT *, {_chain("CASE WHEN regexp_matches(block, '" + text_queries._NEG + "') THEN '' ELSE block END")} AS cleaned FROM lk),
    le AS (SELECT *, {text_queries._REASON} AS reason FROM (SELECT *, {_STRIP.format("cleaned")} AS t FROM lc)),
    entries AS (SELECT *, coalesce(sum(CAST(reason IS NULL AS INT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM le),
    named AS (SELECT page_id AS doc_id, trim(substr(CASE WHEN s = '' THEN 'source' ELSE s END, 1, 72), '_') AS slug FROM (SELECT page_id, trim(regexp_replace(lower(regexp_replace(source_file, '\\.txt$', '')), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM inbox_pages WHERE original_prompt IS NOT NULL))"""


@R.add(
    "g13_inbox_entries",
    f"""WITH {_INBOX}, {_ENTRIES} SELECT doc_id, idx, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome,
    CASE WHEN reason IS NULL THEN slug || '_' || CASE WHEN number > 99999 THEN CAST(number AS VARCHAR) ELSE lpad(CAST(number AS VARCHAR), 5, '0') END END AS identifier, cleaned FROM entries JOIN named USING (doc_id)""",
)
def g13(spark, d):
    return pipelines.inbox_entries(_inbox(spark, d)).select("doc_id", "idx", "outcome", "identifier", "cleaned")


@R.add(
    "g13_inbox_manifest",
    f"""WITH {_INBOX}, {_ENTRIES} SELECT doc_id, slug, count(CASE WHEN idx IS NOT NULL AND reason IS NULL THEN 1 END) AS prompts, count(reason) AS rejected,
    CAST(ceil(count(CASE WHEN idx IS NOT NULL AND reason IS NULL THEN 1 END) / 500.0) AS BIGINT) AS chunks FROM named LEFT JOIN entries USING (doc_id) GROUP BY 1, 2""",
)
def g13m(spark, d):
    docs = _inbox(spark, d)
    return pipelines.inbox_manifest(docs, pipelines.inbox_entries(docs))


_IMPORT = """SELECT '{"wildcard_library": {"Part Kind": ["' || p_name || '", {"value": "x' || p_partkey || '", "weight": 2.5}], "none": "no list"}, "prompt_identifiers": [{"identifier": "p' || p_partkey || '", "concept": "' || p_brand || '"}]}' AS value FROM part"""


def _import(spark, d):
    t = F.format_string('{"wildcard_library": {"Part Kind": ["%s", {"value": "x%d", "weight": 2.5}], "none": "no list"}, "prompt_identifiers": [{"identifier": "p%d", "concept": "%s"}]}', "p_name", "p_partkey", "p_partkey", "p_brand")
    return files.parse_import(table(spark, d, "part").select(t.alias("value")))


@R.add("s03_import_values", f"SELECT 'Part Kind' AS raw_key, CAST(o AS INT) AS ord, CASE o WHEN 0 THEN json_extract_string(value, '$.wildcard_library.\"Part Kind\"[0]') ELSE json_extract_string(value, '$.wildcard_library.\"Part Kind\"[1].value') END AS value, CAST(CASE o WHEN 0 THEN 1.0 ELSE 2.5 END AS DOUBLE) AS weight FROM ({_IMPORT}), (VALUES (0), (1)) AS t(o)")
def s03(spark, d):
    return _import(spark, d)[0]


@R.add("s03_import_prompts", "SELECT CAST(0 AS INT) AS ord, 'p' || p_partkey AS identifier, p_brand AS concept, 'draft' AS status, '{}' AS metadata FROM part")
def s03p(spark, d):
    return _import(spark, d)[1].select("ord", "identifier", "concept", "status", "metadata")


_FLAT = text_queries._CONCEPT.format(f"regexp_replace({_STRIP.format('positive_template')}, '--[\\pL\\pN_]+(?:{_WS}+[\\pL\\pN_.\\-]+)?', '', 'g')")


@R.add(
    "s15_flat_entries",
    f"""SELECT CASE WHEN slug = '' THEN 'prompt' ELSE slug END || '_' || CASE WHEN source_index >= 100 THEN CAST(source_index AS VARCHAR) ELSE lpad(CAST(source_index AS VARCHAR), 3, '0') END AS identifier, flat AS concept, 'active' AS status,
    '{{' || concat_ws(',', '"original_source":' || to_json(original_source), '"original_prompt":' || to_json(positive_template), '"source_index":' || source_index, '"title":' || to_json(concept), '"platform":"any"', '"category":' || to_json(syntax_family)) || '}}' AS metadata, style, positive_template
    FROM (SELECT *, array_to_string(list_transform(list_slice({text_queries._WORDS.format("lower(flat)")}, 1, 4), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), '_') AS slug FROM (SELECT *, {_FLAT} AS flat, {text_queries._syntax("everyday-speech", True)} AS style FROM lexica_cleaned WHERE positive_template IS NOT NULL AND source_index IS NOT NULL))""",
)
def s15(spark, d):
    r = table(spark, d, "lexica_cleaned").where("positive_template is not null and source_index is not null")
    return files.flat_entries(r.select(F.col("source_index").alias("idx"), F.col("concept").alias("title"), F.col("positive_template").alias("prompt"), F.lit("any").alias("platform"), F.col("syntax_family").alias("category"), F.col("original_source").alias("source")))


@R.add("s21_sections_of_sheets", f"WITH {_DOCS}, {_SECTIONS} SELECT doc_id, section, count(*) AS n FROM sectioned GROUP BY 1, 2")
def s21(spark, d):
    return P.sectioned(_docs(spark, d)).groupBy("doc_id", "section").agg(F.count("*").alias("n"))
