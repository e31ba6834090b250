"""SQL that gives the same rows as queries of this subpackage, where SQL can on whole tables."""

from __future__ import annotations

from .history import RADIUS
from .text import GLUE

_S = r"[\s\pZ]"


def _plain(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(upper({x})), 'ß', 'ss'), '[^\pL\pN\pM]+', ' ', 'g'))"


def _format_free(x: str) -> str:
    parts = rf"list_filter(regexp_split_to_array({x}, '[\n\r;]+'), lambda p: regexp_matches(p, '[^\s\pZ]'))"
    label = rf"^{_S}*\pL[\pL\pN _]{{0,30}}{_S}*:"
    members = f"list_transform(json_keys({x}), lambda k: {_plain(f'''k || ' ' || coalesce(json_extract_string({x}, '$.\"' || k || '\"'), '')''')})"
    return f"""CASE WHEN regexp_matches({x}, '^{_S}*\\{{') AND json_valid({x}) THEN array_to_string(list_sort({members}), ' ')
    WHEN len({parts}) > 1 AND len(list_filter({parts}, lambda p: NOT regexp_matches(p, '{label}'))) = 0 THEN array_to_string(list_sort(list_transform({parts}, lambda p: {_plain("p")})), ' ')
    ELSE {_plain(x)} END"""


_GROUPS = f"""WITH k AS (SELECT record_id, {_format_free("original_prompt")} AS a, {_format_free("positive_template")} AS b FROM lexica_cleaned
 WHERE regexp_matches(original_prompt, '[^\\s\\pZ]') AND regexp_matches(positive_template, '[^\\s\\pZ]')), g AS (SELECT a, b, min(record_id) AS first_id, count(*) AS copies FROM k GROUP BY 1, 2 HAVING count(*) > 1)"""

P3_FOUND = _GROUPS + " SELECT DISTINCT first_id, record_id FROM g JOIN k USING (a, b) WHERE record_id <> first_id"
P3_COPIES = _GROUPS + " SELECT first_id, copies FROM g"


def _words(x: str) -> str:
    t = rf"regexp_replace({x}, '(?i)\bnegative[ _]+prompt\b{_S}*[\"”]?{_S}*:[^\n\r]*', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^<>]{{0,200}}>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(^|[\s\pZ])--\pL+(?:[ =]+[\pL\pN_:.]+)?', '\1 ', 'g')"
    t = rf"regexp_replace({t}, ':{_S}*[0-9]+(?:\.[0-9]+)?({_S}*[)\]])', '\1', 'g')"
    t = rf"regexp_replace({t}, '(^|[\n\r;]){_S}*\pL[\pL\pN _]{{0,20}}{_S}*:|\"[^\"\n]{{1,30}}\"{_S}*:', '\1 ', 'g')"
    glue = ", ".join(f"'{w}'" for w in ["", *GLUE])
    return f"list_distinct(list_filter(string_split({_plain(t)}, ' '), lambda w: w NOT IN ({glue})))"


P1_FOUND = f"""WITH w AS (SELECT record_id, batch_no, {_words("original_prompt")} AS w FROM lexica_cleaned WHERE original_prompt IS NOT NULL AND batch_no IS NOT NULL),
 new AS (SELECT w.* FROM w JOIN manifest USING (batch_no) WHERE batch_state = 'new' AND len(w) > 0)
 SELECT min(o.record_id) AS first_id, n.record_id FROM new n JOIN w o ON o.batch_no < n.batch_no AND len(o.w) > 0 AND len(list_intersect(n.w, o.w)) >= {1 - RADIUS} * (len(n.w) + len(o.w) - len(list_intersect(n.w, o.w))) GROUP BY n.record_id"""
