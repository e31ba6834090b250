"""Queries for the text functions: every step of the cleaning chain, naming, tests of form, scores."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.functions import text as T
from quillspark.session import spread, table

from .fixtures import BASE, Library
from .registry import Registry

R = Registry()


#: White space of any kind, which RE2 does not take for \\s.
_S = r"[\s\pZ\x{85}]"


def _g(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    pattern = pattern.replace(r"[\s_]", r"[\s\pZ_]").replace(r"\S", r"[^\s\pZ]").replace(r"\s*", _S + "*").replace(r"\s+", _S + "+")
    q = lambda s: s.replace("'", "''")
    return f"regexp_replace({x}, '{q(pattern)}', '{q(by)}', '{flags}')"


_PARAM = r"--(?:ar|chaos|stylize|style|stylea|v|q|niji|raw|quality|personalize|profile|s|c)(?:\s+\S+)?"
_W = r"[\pL\pN_]"
_SQL_STEPS: dict[str, object] = {
    **{f"add_on_{n}": (lambda x, n=n, t=t: _g(x, rf"\s*<lora:{n}(?::[^>]*)?>", f", {t}")) for n, t in T.ADD_ON_TEXT.items()},
    "add_on": lambda x: _g(x, r"\s*<lora:[^>]+>"),
    "parameters": lambda x: _g(x, _PARAM, "", "gi"),
    "weight_round": lambda x: _g(x, r"\(([^:)]+):[0-9]+\.[0-9]+\)", r"\1"),
    "weight_square": lambda x: _g(x, r"\[([^:\]]+):[0-9]+\.[0-9]+\]", r"\1"),
    "alternation": lambda x: _g(x, r"\[([^\]|]+)\|[^\]]+\]", r"\1"),
    "attention": lambda x: _g(x, r"::[0-9]+"),
    "double_brace": lambda x: _g(x, r"\{\{\s*([^}]+)\s*\}\}", r"\1"),
    "nested_round": lambda x: _g(x, r"\({2,}([^)]+)\){2,}", r"\1"),
    "score_tag": lambda x: _g(x, r"\bscore_[0-9]+\b"),
    "artist_tag": lambda x: _g(x, rf"@{_W}+(?:[\s_]{_W}+)*"),
    "break": lambda x: _g(x, r"\bBREAK\b"),
    "marker": lambda x: _g(x, r"(?m)^(?:ye-pop|ye_pop)\s*"),
    "trailing_dash": lambda x: _g(x, r"\s+-\s*$"),
    "spaces": lambda x: _g(x, r"\s+", " "),
    "comma_spaces": lambda x: _g(x, r"\s*,\s*", ", "),
    "double_commas": lambda x: _g(x, r",\s*,", ","),
    "ends": lambda x: f"trim({_g(x, '^' + _S + '+|' + _S + '+$')}, ',.')",
}
#: Syntax that the data may lack, put in by the record's number in both engines.
_INJECT = {
    0: " ((soft glow)) score_9, BREAK", 1: " [dawn|dusk] @ann of hill, x", 2: " {{ mist }} cat::2", 3: " [rain:0.8], , , dim <lora:niji3d:1>",
    4: " --ar 16:9, --quality 2 -", 5: " <lora:edg90hh:0.7> <lora:other:1.0>",
}


def _injected():
    out = F.lit("")
    for k, v in _INJECT.items():
        out = F.when(F.col("record_id") % 6 == k, F.lit(v)).otherwise(out)
    return F.concat(F.coalesce("original_prompt", F.lit("")), out)


_INJECTED = "coalesce(original_prompt, '') || CASE record_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _INJECT.items()) + " ELSE '' END"
_RAW = f"WITH raw AS (SELECT record_id, {_INJECTED} AS t FROM lexica_cleaned) "


def _raw(spark, d):
    return table(spark, d, "lexica_cleaned").select("record_id", _injected().alias("t"))


def _step(k: int, name: str, step) -> None:
    @R.add(f"c{k:02d}_{name}", _RAW + f"SELECT record_id, {_SQL_STEPS[name]('t')} AS out FROM raw")
    def run(spark, d):
        return _raw(spark, d).select("record_id", step(F.col("t")).alias("out"))


for _k, (_name, _f) in enumerate(T.clean_steps()):
    _step(_k, _name, _f)

_CHAIN = "t"
for _name, _ in T.clean_steps():
    _CHAIN = _SQL_STEPS[_name](_CHAIN)


@R.add("c_clean_positive", _RAW + f"SELECT record_id, {_CHAIN} AS cleaned FROM raw")
def clean(spark, d):
    return _raw(spark, d).select("record_id", T.clean_positive(F.col("t")).alias("cleaned"))


@R.add(
    "c_clean_flags",
    _RAW + rf"""SELECT record_id, regexp_matches(t, '(?i){_PARAM}') AS mj_params_removed,
    regexp_matches(t, '\bscore_[0-9]+\b') OR regexp_matches(t, '@{_W}+') OR regexp_matches(t, '\bBREAK\b') OR regexp_matches(t, '(?m)^(?:ye-pop|ye_pop)') AS civitai_tokens_stripped,
    array_to_string(list_filter(regexp_extract_all(t, '<lora:([^:>]+)', 1), lambda x: x IN ('niji3d', 'edg90hh')), '|') AS lora_replaced,
    array_to_string(list_filter(regexp_extract_all(t, '<lora:([^:>]+)', 1), lambda x: x NOT IN ('niji3d', 'edg90hh')), '|') AS lora_removed FROM raw""",
)
def clean_flags(spark, d):
    return _raw(spark, d).select("record_id", *[c.alias(n) for n, c in T.clean_flags(F.col("t")).items()])


_NEG = r"(?i)^(?:negative prompt|negative prompts)\s*:"


@R.add(
    "n01_split_negative",
    rf"""SELECT record_id, trim(array_to_string(list_filter(string_split(original_prompt, chr(10)), lambda x: NOT regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '{_NEG}')), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS positive,
    trim(regexp_replace(trim(list_extract(list_filter(string_split(original_prompt, chr(10)), lambda x: regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '{_NEG}')), -1), ' ' || chr(9) || chr(13)), '{_NEG}', ''), ' ' || chr(9)) AS negative
    FROM lexica_cleaned WHERE original_prompt IS NOT NULL""",
)
def n01(spark, d):
    positive, negative = T.split_negative(F.col("original_prompt"))
    return table(spark, d, "lexica_cleaned").where("original_prompt is not null").select("record_id", positive.alias("positive"), negative.alias("negative"))


@R.add("n02_placeholder_keys", BASE + r"""SELECT template_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(positive, '\{([\pL\pN_]+)\}', 1), regexp_extract_all(positive, '__([\pL\pN_]+)__', 1)))), '|') AS keys FROM templates""")
def n02(spark, d):
    return Library(spark, d).templates.select("template_id", F.array_join(T.placeholder_keys(F.col("positive")), "|").alias("keys"))


@R.add("n03_normalise_key", "SELECT DISTINCT p_type || ' ' || p_name AS raw, replace(replace(lower(trim(p_type || ' ' || p_name)), '-', '_'), ' ', '_') AS key FROM part")
def n03(spark, d):
    raw = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, d, "part").select(raw.alias("raw"), T.normalise_key(raw).alias("key")).distinct()


@R.add(
    "n04_substitute",
    BASE + """SELECT template_id, replace(replace(replace(replace(positive, '{lighting}', 'soft {mood}'), '__lighting__', 'soft {mood}'), '{mood}', 'calm'), '__mood__', 'calm') AS out FROM templates""",
)
def n04(spark, d):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("lighting", "soft {mood}"), ("mood", "calm"))])
    return Library(spark, d).templates.select("template_id", T.substitute(F.col("positive"), entries).alias("out"))


_WORDS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
_LETTERS = r"trim(regexp_replace(regexp_replace({}, '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_CONCEPT = "array_to_string(list_slice(" + _WORDS.format(_LETTERS) + ", 1, 8), ' ')"


@R.add("n05_concept", f"SELECT record_id, {_CONCEPT.format('positive_template')} AS concept FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def n05(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", T.concept(F.col("positive_template")).alias("concept"))


@R.add(
    "n06_identifier",
    f"""SELECT record_id, CASE WHEN slug = '' THEN 'prompt' ELSE slug END || '_' || CASE WHEN length(CAST(source_index AS VARCHAR)) >= 3 THEN CAST(source_index AS VARCHAR) ELSE lpad(CAST(source_index AS VARCHAR), 3, '0') END AS identifier
    FROM (SELECT record_id, source_index, array_to_string(list_transform(list_slice({_WORDS.format("regexp_replace(lower(concept), '[[:space:]]+', ' ', 'g')")}, 1, 4), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), '_') AS slug FROM lexica_cleaned WHERE concept IS NOT NULL AND source_index IS NOT NULL)""",
)
def n06(spark, d):
    return table(spark, d, "lexica_cleaned").where("concept is not null and source_index is not null").select("record_id", T.identifier(F.col("concept"), F.col("source_index")).alias("identifier"))


@R.add("n07_slugify", "SELECT batch_no, trim(substr(CASE WHEN s = '' THEN 'source' ELSE s END, 1, 72), '_') AS slug FROM (SELECT batch_no, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM manifest WHERE source IS NOT NULL)")
def n07(spark, d):
    return table(spark, d, "manifest").where("source is not null").select("batch_no", T.slugify(F.col("source")).alias("slug"))


@R.add(
    "n08_normalise_line",
    r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(title, '&amp;', '&'), chr(64257), 'fi'), chr(64258), 'fl'), chr(8212), '-'), chr(8211), '-'), chr(160), ' '), '\s+', ' ', 'g')) AS line
    FROM (SELECT doc_id, '  ' || coalesce(title, '') || '  ' || chr(64257) || 'x ' || chr(8212) || ' &amp; y ' AS title FROM documents)""",
)
def n08(spark, d):
    t = F.concat(F.lit("  "), F.coalesce("title", F.lit("")), F.lit("  ﬁx — &amp; y "))
    return table(spark, d, "documents").select("doc_id", T.normalise_line(t).alias("line"))


@R.add("n09_normalise_packed_line", "SELECT doc_id, trim(coalesce(title, '')) AS line FROM documents")
def n09(spark, d):
    quoted = F.concat(F.lit('"'), F.coalesce("title", F.lit("")), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", T.unquote_pair(T.normalise_line(quoted)).alias("line"))


@R.add("n10_sanitise_braces", BASE + r"SELECT template_id, replace(regexp_replace(positive, '\{([^{}]*)\}', '\1', 'g'), '__', '_') AS out FROM templates")
def n10(spark, d):
    return Library(spark, d).templates.select("template_id", T.sanitise_braces(F.col("positive")).alias("out"))


@R.add("n11_is_json_object", r"SELECT record_id, regexp_matches(trim(positive_template), '(?s)^\{.*\}$') AND json_valid(positive_template) AS is_json FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def n11(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", T.is_json_object(F.col("positive_template")).alias("is_json"))


def _sent(x: str, n: int) -> str:
    return f"len(list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13))), lambda y: length(y) > {n}))"


@R.add("n12_is_prose", f"SELECT record_id, {_sent('positive_template', 30)} >= 2 AS prose FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def n12(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", T.is_prose(F.col("positive_template")).alias("prose"))


_WEIGHTED = r"(regexp_matches({0}, '\([^)]+:[0-9]+\.[0-9]+\)') OR regexp_matches({0}, '\[[^:\]]+:[0-9]+\.[0-9]+\]'))"


@R.add("n13_is_weighted", f"SELECT record_id, {_WEIGHTED.format('original_prompt')} AS weighted FROM lexica_cleaned WHERE original_prompt IS NOT NULL")
def n13(spark, d):
    return table(spark, d, "lexica_cleaned").where("original_prompt is not null").select("record_id", T.is_weighted(F.col("original_prompt")).alias("weighted"))


def _commas(x: str) -> str:
    return f"len(list_filter(list_transform(string_split({x}, ','), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13))), lambda y: y <> ''))"


_STYLE = rf"""CASE WHEN starts_with(t, '{{') AND json_valid(t) THEN 'lisp-like'
 WHEN regexp_matches(t, '\([^:)]+:[0-9]+\.[0-9]+\)') OR regexp_matches(t, '\[[^:\]]+:[0-9]+\.[0-9]+\]') THEN 'enhanced-prompt'
 WHEN regexp_matches(t, '(?i){_PARAM}') THEN 'comma-separated'
 WHEN {_sent("t", 20)} >= 2 THEN 'everyday-speech'
 WHEN regexp_matches(t, '<lora:[^>]+>') OR regexp_matches(t, '\[([^\]|]+)\|[^\]]+\]') OR regexp_matches(t, '::[0-9]+') THEN 'enhanced-prompt'
 WHEN {_commas("t")} > {_sent("t", 20)} * 2 THEN 'comma-separated'
 WHEN {_sent("t", 20)} >= 1 AND {_commas("t")} < 5 THEN 'everyday-speech' ELSE 'comma-separated' END"""
_STYLED = f"SELECT record_id, {_STYLE} AS style FROM (SELECT record_id, trim(original_prompt, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM lexica_cleaned WHERE original_prompt IS NOT NULL)"


@R.add("n14_detect_style", _STYLED)
def n14(spark, d):
    return table(spark, d, "lexica_cleaned").where("original_prompt is not null").select("record_id", T.detect_style(F.col("original_prompt")).alias("style"))


def _syntax(fallback: str, parameters: bool) -> str:
    p = "WHEN regexp_matches(positive_template, '--[\\pL\\pN_]+') THEN 'comma-separated'" if parameters else ""
    return f"CASE WHEN {_sent('positive_template', 20)} >= 2 THEN 'everyday-speech' {p} WHEN {_commas('positive_template')} > {_sent('positive_template', 20)} * 2 THEN 'comma-separated' ELSE '{fallback}' END"


@R.add("n15_detect_syntax", f"SELECT record_id, {_syntax('everyday-speech', True)} AS handbook, {_syntax('everyday-speech', False)} AS numbered, {_syntax('comma-separated', False)} AS headed FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def n15(spark, d):
    c = F.col("positive_template")
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select(
        "record_id", T.detect_syntax(c, parameters=True).alias("handbook"), T.detect_syntax(c).alias("numbered"), T.detect_syntax(c, "comma-separated").alias("headed")
    )


_CAND = {
    "lora": r"\s*<lora:[^>]+>", "weighted": r"\([^:)]+:[0-9]+\.[0-9]+\)", "bracket_weight": r"\[[^:\]]+:[0-9]+\.[0-9]+\]", "alt_syntax": r"\[[^\]|]+\|[^\]]+\]",
    "attention": r"::[0-9]+", "double_brace": r"\{\{\s*[^}]+\s*\}\}", "mj_param": "(?i)" + _PARAM,
}


@R.add(
    "n16_syntax_candidates",
    _RAW.rstrip() + ", f AS (" + " UNION ALL ".join(f"SELECT record_id, '{n}' AS type, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS parts FROM raw" for n, p in _CAND.items())
    + "), g AS (SELECT record_id, type, hits, parts, unnest(range(len(hits))) AS i FROM f) SELECT record_id, type, hits[i + 1] AS text, CAST(list_sum(list_transform(parts[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) AS INT) AS start FROM g",
)
def n16(spark, d):
    c = _raw(spark, d).select("record_id", F.explode(T.syntax_candidates(F.col("t"))).alias("c"))
    return c.select("record_id", "c.type", "c.text", "c.start")


@R.add(
    "n17_style_variants",
    f"""WITH b AS (SELECT record_id, positive_template AS p, original_prompt AS r, regexp_matches(trim(positive_template), '(?s)^\\{{.*\\}}$') AND json_valid(positive_template) AS js FROM lexica_cleaned WHERE positive_template IS NOT NULL AND original_prompt IS NOT NULL)
    SELECT record_id, 'lisp-like' AS style, 'structured' AS strategy, p AS positive FROM b WHERE js
    UNION ALL SELECT record_id, 'comma-separated', 'standard', p FROM b WHERE NOT js
    UNION ALL SELECT record_id, 'everyday-speech', 'minimal', p FROM b WHERE NOT js AND {_sent("p", 30)} >= 2
    UNION ALL SELECT record_id, 'enhanced-prompt', 'weighted', p FROM b WHERE NOT js AND {_WEIGHTED.format("r")}
    UNION ALL SELECT record_id, 'structured-fields', 'standard', p FROM b WHERE NOT js""",
)
def n17(spark, d):
    none = F.create_map().cast("map<string,string>")
    v = T.style_variants(F.col("positive_template"), F.col("original_prompt"), T.is_json_object(F.col("positive_template")), none)
    r = table(spark, d, "lexica_cleaned").where("positive_template is not null and original_prompt is not null")
    return r.select("record_id", F.explode(v).alias("v")).select("record_id", "v.style", "v.strategy", "v.positive")


@R.add(
    "n18_field_flatteners",
    """SELECT p_partkey, concat_ws(', ', s, c, e, l) AS comma, concat_ws(' ', s, 'wearing ' || c, 'in ' || e) || '. with ' || l AS speech,
    concat_ws(', ', '(' || s || ':1.1)', c, e, l) AS enhanced
    FROM (SELECT p_partkey, p_name AS s, CASE WHEN p_size % 2 = 0 THEN p_brand END AS c, CASE WHEN p_size % 3 = 0 THEN p_type END AS e, 'soft light' AS l FROM part)""",
)
def n18(spark, d):
    m = F.map_filter(
        F.create_map(F.lit("Subject"), F.col("p_name"), F.lit("Clothing"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("Environment"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.lit("Lighting"), F.lit("soft light")),
        lambda k, v: v.isNotNull(),
    )
    p = table(spark, d, "part").select("p_partkey", m.alias("m"))
    return p.select("p_partkey", T.fields_comma(F.col("m")).alias("comma"), T.fields_speech(F.col("m")).alias("speech"), T.fields_enhanced(F.col("m")).alias("enhanced"))


_TOK = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_-]*')"


@R.add("n21_tokens", f"SELECT record_id, array_to_string({_TOK.format('positive_template')}, ' ') AS tokens, len({_TOK.format('positive_template')}) AS n FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def n21(spark, d):
    t = S.tokens(F.col("positive_template"))
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("bigint").alias("n"))


def _hits(x: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{p}') AS INT)" for p in phrases) + ")"


@R.add("n22_phrase_hits", "SELECT record_id, CAST(" + _hits("lower(positive_template)", S.DOMAIN_WORDS["illustration-painting"]) + " AS BIGINT) AS hits FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def n22(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", S.phrase_hits(F.col("positive_template"), S.DOMAIN_WORDS["illustration-painting"]).cast("bigint").alias("hits"))


@R.add("n23_normalise_term", r"SELECT record_id, trim(trim(regexp_replace(concept, '\s+', ' ', 'g')), ',.;:') AS term FROM lexica_cleaned WHERE concept IS NOT NULL")
def n23(spark, d):
    return table(spark, d, "lexica_cleaned").where("concept is not null").select("record_id", T.normalise_term(F.col("concept")).alias("term"))


@R.add("n27_clean_negative", r"SELECT record_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(negative_template), '[()\[\]{}]', ' ', 'g'), ':[0-9]+\.[0-9]+', '', 'g'), '<lora:[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS negative FROM lexica_cleaned WHERE negative_template IS NOT NULL")
def n27(spark, d):
    return table(spark, d, "lexica_cleaned").where("negative_template is not null").select("record_id", T.clean_negative(F.col("negative_template")).alias("negative"))


_REASON = r"""CASE WHEN length(t) < 15 THEN 'too short after cleaning (' || length(t) || ' chars)'
 WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) < 3 THEN 'too few words after cleaning (' || len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) || ' words)'
 WHEN NOT regexp_matches(t, '\pL') THEN 'no alphabetic content after cleaning' END"""


@R.add("f06_reject_reason", f"SELECT rejected_id, {_REASON} AS reject_reason FROM (SELECT rejected_id, trim(coalesce(original_prompt, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM civitai_rejected)")
def f06(spark, d):
    return table(spark, d, "civitai_rejected").select("rejected_id", T.reject_reason(F.col("original_prompt")).alias("reject_reason"))


def _re(pattern: str) -> str:
    """A pattern of the column functions as RE2 takes it."""
    return re.sub(r"^\(\?(\w*?)U(\w*)\)", lambda m: f"(?{m[1]}{m[2]})" if m[1] + m[2] else "", pattern).replace(r"\s", _S).replace("'", "''")


#: Of a normalised line t.
LOOKS_LIKE = rf"""(length(t) BETWEEN 30 AND 900 AND NOT regexp_matches(t, '{_re(T._NOT_PROMPT)}') AND NOT regexp_matches(t, '^{_S}*[0-9]+(?:\.[0-9]+)+{_S}+{_W}+') AND NOT regexp_matches(t, '{_re(T._LIST)}')
 AND NOT (length(t) - length(replace(t, '.', '')) >= 5 AND NOT contains(t, ',') AND NOT contains(t, '--')) AND regexp_matches(t, '\pL') AND regexp_matches(t, '{_re(T._IMAGE)}')
 AND (contains(t, ',') OR contains(t, '--') OR contains(lower(t), '/imagine') OR regexp_matches(t, '{_re(T._OPENING)}')))"""


def normal_line(x: str) -> str:
    """A line with entities, ligatures and dashes written out and single spaces."""
    for a, b in (("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&quot;'", "chr(34)"), ("'&#39;'", "chr(39)"), ("'&#x27;'", "chr(39)"), ("'&nbsp;'", "chr(160)"), ("'&amp;'", "'&'"), ("chr(64257)", "'fi'"), ("chr(64258)", "'fl'"), ("chr(8212)", "'-'"), ("chr(8211)", "'-'")):
        x = f"replace({x}, {a}, {b})"
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'))"


@R.add("f07_looks_like_prompt", f"SELECT record_id, {LOOKS_LIKE} AS is_prompt FROM (SELECT record_id, {normal_line('positive_template')} AS t FROM lexica_cleaned WHERE positive_template IS NOT NULL)")
def f07(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", T.looks_like_prompt(F.col("positive_template")).alias("is_prompt"))


def _len_score(n: str) -> str:
    return f"CASE WHEN {n} < 6 OR {n} > 120 THEN -8.0 WHEN {n} BETWEEN 12 AND 70 THEN 8.0 WHEN {n} < 12 THEN CAST({n} - 4 AS DOUBLE) ELSE greatest(0.0, 8.0 - ({n} - 70) / 8.0) END"


@R.add("m01_length_score", f"SELECT record_id, CAST({_len_score('n')} AS DOUBLE) AS score FROM (SELECT record_id, len({_TOK.format('positive_template')}) AS n FROM lexica_cleaned WHERE positive_template IS NOT NULL)")
def m01(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", S.length_score(F.size(S.tokens(F.col("positive_template")))).alias("score"))


_DOM = {d: _hits("l", w) for d, w in S.DOMAIN_WORDS.items()}
_DOMAIN = "CASE WHEN greatest(" + ", ".join(_DOM.values()) + ") <= 0 THEN 'mixed-hard-general' " + " ".join(f"WHEN {h} = greatest({', '.join(_DOM.values())}) THEN '{d}'" for d, h in _DOM.items()) + " END"


def _tags(groups: dict[str, list[str]]) -> str:
    return "list_slice(list_filter([" + ", ".join(f"CASE WHEN {_hits('l', w)} > 0 THEN '{t}' END" for t, w in groups.items()) + "], lambda x: x IS NOT NULL), 1, 6)"


_TEXTS = "(SELECT record_id, coalesce(concept, '') || ' ' || coalesce(positive_template, '') AS t, lower(coalesce(concept, '') || ' ' || coalesce(positive_template, '')) AS l FROM lexica_cleaned)"


def _texts(spark, d):
    return table(spark, d, "lexica_cleaned").select("record_id", F.concat(F.coalesce("concept", F.lit("")), F.lit(" "), F.coalesce("positive_template", F.lit(""))).alias("t"))


@R.add("m03_domain", f"SELECT record_id, {_DOMAIN} AS domain FROM {_TEXTS}")
def m03(spark, d):
    return _texts(spark, d).select("record_id", S.domain(F.col("t")).alias("domain"))


@R.add("m04_tags", f"SELECT record_id, array_to_string({_tags(S.TAG_WORDS)}, '|') AS tags, array_to_string({_tags(S.DIFFICULTY_WORDS)}, '|') AS difficulty FROM {_TEXTS}")
def m04(spark, d):
    return _texts(spark, d).select("record_id", F.array_join(S.tags(F.col("t"), S.TAG_WORDS), "|").alias("tags"), F.array_join(S.tags(F.col("t"), S.DIFFICULTY_WORDS), "|").alias("difficulty"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SIG = f"list_sort(list_distinct(list_slice(list_filter({_TOK.format('t')}, lambda x: length(x) > 2 AND NOT list_contains({_list(S.STOP_WORDS + S.GENERIC_WORDS)}, x)), 1, 80)))"


@R.add("m05_signature", f"SELECT record_id, array_to_string({_SIG}, ' ') AS signature FROM {_TEXTS}")
def m05(spark, d):
    return _texts(spark, d).select("record_id", F.array_join(S.signature(S.tokens(F.col("t"))), " ").alias("signature"))


_SCORE = f"""({_len_score("n")} + least(nk, 5) * 3.0 + least(len(tg), 5) * 2.5 + least(len(df), 3) * 1.5
 + (len(list_intersect(u, {_list(S.VISUAL_WORDS)})) + {" + ".join(_DOM.values())}) * 1.25 + ln(1 + len(list_filter(u, lambda x: NOT list_contains({_list(S.STOP_WORDS)}, x)))) * 3.0
 - {_hits("l", S.GENERIC_WORDS)} * 1.4 + CASE WHEN domain = 'mixed-hard-general' THEN least(len(df), 4) * 1.8 ELSE 0.0 END)"""
SCORED = f"""scored AS (SELECT record_id, domain, n, tg, df, round(CAST({_SCORE} AS DOUBLE), 6) AS score FROM (SELECT record_id, l, {_DOMAIN} AS domain, len({_TOK.format("t")}) AS n, list_distinct({_TOK.format("t")}) AS u,
 coalesce(len(list_distinct(wr)), 0) AS nk, {_tags(S.TAG_WORDS)} AS tg, {_tags(S.DIFFICULTY_WORDS)} AS df FROM
 (SELECT record_id, wildcard_refs AS wr, coalesce(concept, '') || ' ' || coalesce(positive_template, '') AS t, lower(coalesce(concept, '') || ' ' || coalesce(positive_template, '')) AS l FROM lexica_cleaned)))"""


def scored(spark, d):
    """(record_id, domain, n_tokens, tags, difficulty, signature, score) of every record, its references as keys."""
    r = spread(table(spark, d, "lexica_cleaned").select("record_id", "concept", "positive_template", "wildcard_refs"))
    t = F.concat(F.coalesce("concept", F.lit("")), F.lit(" "), F.coalesce("positive_template", F.lit("")))
    b = r.select("record_id", t.alias("t"), F.coalesce(F.array_distinct("wildcard_refs"), F.array().cast("array<string>")).alias("keys"))
    return S.score_frame(b, F.col("t"), F.col("keys"))


@R.add("m02_score", f"WITH {SCORED} SELECT record_id, domain, score FROM scored WHERE n >= 6 AND score >= 8")
def m02(spark, d):
    s = scored(spark, d).withColumn("score", F.round("score", 6))
    return s.where((F.col("n_tokens") >= 6) & (F.col("score") >= S.LEAST_SCORE)).select("record_id", "domain", "score")


@R.add("m10_content_id", "SELECT record_id, substr(sha1(positive_template), 1, 16) AS content_id FROM lexica_cleaned WHERE positive_template IS NOT NULL")
def m10(spark, d):
    return table(spark, d, "lexica_cleaned").where("positive_template is not null").select("record_id", F.substring(F.sha1("positive_template"), 1, 16).alias("content_id"))


@R.add("m11_json_get", """SELECT record_id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.original_source') END AS source, CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.source_index') AS INT) END AS idx FROM lexica_cleaned""")
def m11(spark, d):
    m = F.try_parse_json("metadata")
    return table(spark, d, "lexica_cleaned").select("record_id", F.try_variant_get(m, "$.original_source", "string").alias("source"), F.try_variant_get(m, "$.source_index", "int").alias("idx"))


@R.add("m13_chunk_count", "SELECT batch_no, CAST(ceil(prompts / 20.0) AS BIGINT) AS n FROM manifest WHERE prompts IS NOT NULL")
def m13(spark, d):
    return table(spark, d, "manifest").where("prompts is not null").select("batch_no", F.ceil(F.col("prompts") / 20).alias("n"))


@R.add("f05_prefilter", BASE + "SELECT template_id FROM templates t JOIN prompts p ON p.id = t.prompt_id WHERE contains(positive, '{') OR " + _hits("lower(positive)", S.PREFILTER_WORDS) + " > 0 OR " + _hits("lower(coalesce(concept, ''))", S.PREFILTER_WORDS) + " > 0")
def f05(spark, d):
    lib = Library(spark, d)
    t = lib.templates.join(lib.prompts.select(F.col("id").alias("prompt_id"), "concept"), "prompt_id")
    return t.where(F.col("positive").contains("{") | S.any_phrase(F.col("positive"), S.PREFILTER_WORDS) | S.any_phrase(F.coalesce("concept", F.lit("")), S.PREFILTER_WORDS)).select("template_id")


@R.add("f08_explicit_words", "SELECT record_id FROM lexica_cleaned WHERE positive_template IS NOT NULL AND " + _hits("lower(positive_template)", S.EXPLICIT_WORDS) + " = 0")
def f08(spark, d):
    return table(spark, d, "lexica_cleaned").where(F.col("positive_template").isNotNull() & ~S.any_phrase(F.col("positive_template"), S.EXPLICIT_WORDS)).select("record_id")


@R.add("f10_json_guard", "SELECT record_id FROM lexica_cleaned WHERE metadata IS NOT NULL AND metadata <> '{}' AND json_valid(metadata)")
def f10(spark, d):
    return table(spark, d, "lexica_cleaned").where((F.col("metadata") != "{}") & F.try_parse_json("metadata").isNotNull()).select("record_id")


@R.add("f11_skip_prefixes", "SELECT record_id FROM lexica_cleaned WHERE NOT (starts_with(positive_template, 'overlapping') OR starts_with(positive_template, 'Subject') OR (contains(positive_template, 'seamstress') AND contains(positive_template, 'hem')))")
def f11(spark, d):
    c = F.col("positive_template")
    skip = F.exists(F.array(F.lit("overlapping"), F.lit("Subject")), lambda p: F.startswith(c, p)) | (c.contains("seamstress") & c.contains("hem"))
    return table(spark, d, "lexica_cleaned").where(~skip).select("record_id")
