"""Column functions over template text: cleaning steps, splitting, naming, tests of form.

Everything here is an expression of built-in functions, so it stays inside generated code. Character classes are
Unicode-aware ((?U)); ordered steps are listed in the order in which they must run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syntax of generator prompts.
PARAMETER = r"(?i)--(?:ar|chaos|stylize|style|stylea|v|q|niji|raw|quality|personalize|profile|s|c)(?:(?U:\s+\S+))?"
ADD_ON = r"(?U)\s*<lora:[^>]+>"
WEIGHT_ROUND = r"\(([^:)]+):[0-9]+\.[0-9]+\)"
WEIGHT_SQUARE = r"\[([^:\]]+):[0-9]+\.[0-9]+\]"
ALTERNATION = r"\[([^\]|]+)\|[^\]]+\]"
ATTENTION = r"::[0-9]+"
DOUBLE_BRACE = r"(?U)\{\{\s*([^}]+)\s*\}\}"
NESTED_ROUND = r"\({2,}([^)]+)\){2,}"
SCORE_TAG = r"(?U)\bscore_\d+\b"
# words after the sign, each one space apart; written without a repeated group, which would recurse on long texts
ARTIST_TAG = r"(?Us)@\w.*?(?=[^\w\s]|\s(?!\w)|\z)"
BREAK = r"(?U)\bBREAK\b"
MARKER = r"(?Umd)^(?:ye-pop|ye_pop)\s*"
NEGATIVE_LINE = r"(?i)^(?:negative prompt|negative prompts)(?U:\s*):"
LABELS = ["Subject", "Clothing", "Action", "Environment", "Camera", "Lighting", "Objects", "Style Details", "Hair", "Accessories"]
FIELD = "(?id)^(" + "|".join(LABELS) + r")(?U:\s*):(?U:\s*)(.+)$"
#: Add-ons with a description that takes their place.
ADD_ON_TEXT = {"niji3d": "anime 3D render style, cel-shaded anime aesthetic", "edg90hh": "urban streetwear style, edgy fashion"}
SYNTAX_FAMILIES = ["comma-separated", "everyday-speech", "booru-tags", "enhanced-prompt", "structured-fields", "natural_language", "lisp-like", "pony-booru"]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_steps() -> list[tuple[str, object]]:
    """(name, step) of the cleaning chain, in order."""
    sub = lambda pattern, by="": lambda c: F.regexp_replace(c, pattern, by)
    known = [(f"add_on_{n}", sub(rf"(?U)\s*<lora:{n}(?::[^>]*)?>", f", {t}")) for n, t in ADD_ON_TEXT.items()]
    return [
        *known,
        ("add_on", sub(ADD_ON)),
        ("parameters", sub(PARAMETER)),
        ("weight_round", sub(WEIGHT_ROUND, "$1")),
        ("weight_square", sub(WEIGHT_SQUARE, "$1")),
        ("alternation", sub(ALTERNATION, "$1")),
        ("attention", sub(ATTENTION)),
        ("double_brace", sub(DOUBLE_BRACE, "$1")),
        ("nested_round", sub(NESTED_ROUND, "$1")),
        ("score_tag", sub(SCORE_TAG)),
        ("artist_tag", sub(ARTIST_TAG)),
        ("break", sub(BREAK)),
        ("marker", sub(MARKER)),
        ("trailing_dash", sub(r"(?U)\s+-\s*$")),
        ("spaces", squeeze),
        ("comma_spaces", sub(r"(?U)\s*,\s*", ", ")),
        ("double_commas", sub(r"(?U),\s*,", ",")),
        ("ends", lambda c: F.btrim(strip(c), F.lit(",."))),
    ]


def clean_positive(c: Column) -> Column:
    """The whole chain. Null gives null."""
    return reduce(lambda acc, step: step[1](acc), clean_steps(), c)


def clean_flags(c: Column) -> dict[str, Column]:
    """What the chain notes about the original text."""
    names = F.regexp_extract_all(c, F.lit(r"<lora:([^:>]+)"), 1)
    known = F.array(*[F.lit(n) for n in ADD_ON_TEXT])
    return {
        "mj_params_removed": c.rlike(PARAMETER),
        "civitai_tokens_stripped": c.rlike(SCORE_TAG) | c.rlike(ARTIST_TAG) | c.rlike(BREAK) | c.rlike(MARKER),
        "lora_replaced": F.array_join(F.filter(names, lambda n: F.array_contains(known, n)), "|"),
        "lora_removed": F.array_join(F.filter(names, lambda n: ~F.array_contains(known, n)), "|"),
    }


def split_negative(c: Column) -> tuple[Column, Column]:
    """(positive text, negative text): the last line that begins as a negative prompt gives the negative, all such lines
    leave the positive."""
    lines = F.split(c, "\n")
    hit = lambda x: strip(x).rlike(NEGATIVE_LINE)
    positive = strip(F.array_join(F.filter(lines, lambda x: ~hit(x)), "\n"))
    last = F.try_element_at(F.filter(lines, hit), F.lit(-1))
    return positive, strip(F.regexp_replace(strip(last), NEGATIVE_LINE, ""))


def reject_reason(c: Column) -> Column:
    """Why a cleaned text is rejected, null if it is kept; the first reason in order."""
    t = strip(F.coalesce(c, F.lit("")))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    return (
        F.when(F.length(t) < 15, F.concat(F.lit("too short after cleaning ("), F.length(t).cast("string"), F.lit(" chars)")))
        .when(words < 3, F.concat(F.lit("too few words after cleaning ("), words.cast("string"), F.lit(" words)")))
        .when(~t.rlike(r"\p{L}"), F.lit("no alphabetic content after cleaning"))
    )


def words_of(c: Column, most: int) -> Column:
    return F.slice(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), 1, most)


def concept(c: Column, most: int = 8, drop_parameters: bool = False) -> Column:
    """The first words of letters; of a text without letters its first 50 characters after squeezing."""
    t = F.regexp_replace(strip(c), r"(?U)--\w+(?:\s+[\w.\-]+)?", "") if drop_parameters else c
    letters = strip(squeeze(F.regexp_replace(t, r"(?U)[^a-zA-Z\s]", " ")))
    return F.array_join(words_of(letters, most), " ")


def identifier(text: Column, index: Column, prefix: str = "", width: int = 3) -> Column:
    """Up to four words without anything but letters and digits, joined by underscores, and the padded index."""
    slug = F.array_join(F.transform(words_of(F.lower(text), 4), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), "_")
    number = F.when(F.length(index.cast("string")) >= width, index.cast("string")).otherwise(F.lpad(index.cast("string"), width, "0"))
    return F.concat(F.lit(prefix), F.when(slug == "", F.lit("prompt")).otherwise(slug), F.lit("_"), number)


def slugify(c: Column, most: int = 72) -> Column:
    """Letters and digits with single underscores, at most so long."""
    s = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.btrim(F.substring(F.when(s == "", F.lit("source")).otherwise(s), 1, most), F.lit("_"))


def normalise_key(c: Column) -> Column:
    """A wildcard key: trimmed, lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(strip(c)), "- ", "__")


def placeholder_keys(c: Column, keep_concept: bool = True) -> Column:
    """The distinct keys of `{key}` and `__key__` in a text, sorted."""
    found = F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(r"(?U)\{(\w+)\}"), 1), F.regexp_extract_all(c, F.lit(r"(?U)__(\w+)__"), 1)))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return F.sort_array(found if keep_concept else F.array_remove(found, "concept"))


def substitute(template: Column, entries: Column) -> Column:
    """The template with every `{key}` and `__key__` of an array of (key, value) replaced, one entry after the other, so a
    value may bring in a placeholder that a later entry fills."""

    def one(acc: Column, e: Column) -> Column:
        for shape in ("{%s}", "__%s__"):
            left, right = shape.split("%s")
            for k in (e["key"], F.lower(e["key"])):
                acc = F.replace(acc, F.concat(F.lit(left), k, F.lit(right)), e["value"])
        return acc

    return F.aggregate(entries, template, one)


def sanitise_braces(c: Column) -> Column:
    """Braces as prose: their content stays, and double underscores become single."""
    return F.replace(F.regexp_replace(c, r"\{([^{}]*)\}", "$1"), F.lit("__"), F.lit("_"))


def normalise_line(c: Column) -> Column:
    """Ligatures and long dashes written out, white space squeezed; the common HTML entities resolved."""
    t = c
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    for a, b in (("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2014", "-"), ("\u2013", "-")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return strip(squeeze(t))


def unquote_pair(c: Column) -> Column:
    """Without one pair of equal quotes round the whole."""
    quoted = (F.length(c) >= 2) & (F.left(c, F.lit(1)) == F.right(c, F.lit(1))) & F.left(c, F.lit(1)).isin("'", '"')
    return F.when(quoted, strip(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def is_json_object(c: Column) -> Column:
    """Whether a text is one JSON object."""
    t = strip(c)
    return F.coalesce(t.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(t).isNotNull(), F.lit(False))


def _sentences(c: Column, longer_than: int) -> Column:
    return F.size(F.filter(F.transform(F.split(c, "[.!?]+"), strip), lambda s: F.length(s) > longer_than))


def is_prose(c: Column, longer_than: int = 30) -> Column:
    """At least two sentences of some length."""
    return _sentences(c, longer_than) >= 2


def is_weighted(c: Column) -> Column:
    """Whether weight syntax occurs."""
    return c.rlike(r"\([^)]+:[0-9]+\.[0-9]+\)") | c.rlike(WEIGHT_SQUARE)


def _commas(c: Column) -> Column:
    return F.size(F.filter(F.transform(F.split(c, ","), strip), lambda s: s != ""))


def detect_style(c: Column) -> Column:
    """The style a raw prompt is written in, by a ladder of tests."""
    t = strip(c)
    weighted = t.rlike(WEIGHT_ROUND) | t.rlike(WEIGHT_SQUARE)
    sentences, commas = _sentences(t, 20), _commas(t)
    return (
        F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), F.lit("lisp-like"))
        .when(weighted, F.lit("enhanced-prompt"))
        .when(t.rlike(PARAMETER), F.lit("comma-separated"))
        .when(sentences >= 2, F.lit("everyday-speech"))
        .when(t.rlike(ADD_ON) | t.rlike(ALTERNATION) | t.rlike(ATTENTION), F.lit("enhanced-prompt"))
        .when(commas > sentences * 2, F.lit("comma-separated"))
        .when((sentences >= 1) & (commas < 5), F.lit("everyday-speech"))
        .otherwise(F.lit("comma-separated"))
    )


def detect_syntax(c: Column, fallback: str = "everyday-speech", parameters: bool = False) -> Column:
    """The simple test of form, with its variants: what else is taken to be, and whether parameters settle it."""
    sentences, commas = _sentences(c, 20), _commas(c)
    out = F.when(sentences >= 2, F.lit("everyday-speech"))
    if parameters:
        out = out.when(c.rlike(r"(?U)--\w+"), F.lit("comma-separated"))
    return out.when(commas > sentences * 2, F.lit("comma-separated")).otherwise(F.lit(fallback))


#: Name and pattern of the syntax that may hold a wildcard.
CANDIDATES = {
    "lora": ADD_ON, "weighted": WEIGHT_ROUND, "bracket_weight": WEIGHT_SQUARE, "alt_syntax": ALTERNATION,
    "attention": ATTENTION, "double_brace": DOUBLE_BRACE, "mj_param": PARAMETER,
}


def syntax_candidates(c: Column) -> Column:
    """array<struct<type, text, start>> of every piece of special syntax; start counts characters from 0."""

    def of(name: str, pattern: str) -> Column:
        found, between = F.regexp_extract_all(c, F.lit(pattern), 0), F.split(c, pattern)
        # what stands between the pieces and the pieces themselves, up to each
        length = lambda texts, n: F.aggregate(F.slice(texts, 1, n), F.lit(0), lambda acc, x: acc + F.length(x))
        start = lambda i: length(between, i + 1) + length(found, i)
        return F.transform(found, lambda x, i: F.struct(F.lit(name).alias("type"), x.alias("text"), start(i).alias("start")))

    return F.flatten(F.array(*[of(n, p) for n, p in CANDIDATES.items()]))


def clean_negative(c: Column) -> Column:
    """A negative prompt in lower case without brackets, weights and add-ons."""
    t = F.regexp_replace(F.lower(c), r"[()\[\]{}]", " ")
    for p in (r":[0-9]+\.[0-9]+", r"<lora:[^>]+>"):
        t = F.regexp_replace(t, p, "")
    return strip(squeeze(t))


def normalise_term(c: Column) -> Column:
    """A mined term: single spaces, without punctuation at its ends."""
    return F.btrim(strip(squeeze(c)), F.lit(",.;:"))


# Fields of a labelled record, as map<string,string>.


def fields_comma(m: Column) -> Column:
    """The values in the fixed order of labels."""
    return F.concat_ws(", ", *[m[k] for k in LABELS])


def fields_speech(m: Column) -> Column:
    """The fields as a sentence, what modifies it after full stops."""
    base = F.concat_ws(" ", m["Subject"], F.concat(F.lit("wearing "), m["Clothing"]), m["Action"], F.concat(F.lit("in "), m["Environment"]))
    more = F.concat_ws(". ", m["Camera"], F.concat(F.lit("with "), m["Lighting"]), m["Style Details"])
    return F.when(more == "", base).otherwise(F.concat(base, F.lit(". "), more))


def fields_enhanced(m: Column) -> Column:
    """Style and subject weighted, the rest in order."""
    rest = ["Clothing", "Action", "Environment", "Camera", "Lighting", "Objects", "Hair", "Accessories"]
    weigh = lambda k, w: F.concat(F.lit("("), m[k], F.lit(f":{w})"))
    return F.concat_ws(", ", weigh("Style Details", "1.2"), weigh("Subject", "1.1"), *[m[k] for k in rest])


def style_variants(cleaned: Column, raw: Column, json: Column, fields: Column) -> Column:
    """array<struct<style, positive, strategy>>: the variants a record gives, one for JSON, four for labelled fields, two
    to four for text."""
    v = lambda s, p, n: F.struct(F.lit(s).alias("style"), p.alias("positive"), F.lit(n).alias("strategy"))
    labelled = F.array(
        v("structured-fields", strip(raw), "structured"), v("comma-separated", fields_comma(fields), "standard"),
        v("everyday-speech", fields_speech(fields), "minimal"), v("enhanced-prompt", fields_enhanced(fields), "weighted"),
    )
    text = F.filter(
        F.array(
            v("comma-separated", cleaned, "standard"),
            F.when(is_prose(cleaned), v("everyday-speech", cleaned, "minimal")),
            F.when(is_weighted(raw), v("enhanced-prompt", cleaned, "weighted")),
            v("structured-fields", cleaned, "standard"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(json, F.array(v("lisp-like", cleaned, "structured"))).when(F.size(fields) > 0, labelled).otherwise(text)


# Whether a line of a book reads as a prompt. The words that say so.
_IMAGE = (
    r"(?iU)\b(image|photo|photograph|portrait|painting|illustration|render|art|artwork|scene|landscape|cityscape|character|anime|cinematic|"
    r"macro|studio|midjourney|stable diffusion|dall-?e|prompt|/imagine|--ar|--v|--style)\b"
)
_NOT_PROMPT = (
    r"(?iU)\b(copyright|all rights reserved|table of contents|contents|introduction|chapter|page|click|download|subscribe|website|email|isbn|"
    r"how to use|description:|prompt style|negative prompt$|this book|this collection|guidebook|novice|experienced practitioner|"
    r"prompt engineering|effective prompts|iterate and refine|review the results|be aware that|deep[- ]dive|read our|google sheets|"
    r"cross[- ]promotion|social media|customer|customers|sales|business|asset store|your assets|your products|promote your|"
    r"available prompts|desired image|desired imagery|structure of a prompt|rendering keywords|consider context|refer to the|"
    r"to achieve desirable|iterative refinement|generated images|generate images using|first of all|thanks a lot|your purchase|"
    r"in this volume|you.ll learn|market is thriving|in high demand|assist you in|allow you to upload|midjourney documentation|"
    r"technology works|make money)\b"
)
_LIST = r"(?iU)^\s*(artists|genres|techniques|photographers|aesthetics)\b"
_OPENING = (
    r"(?iU)^\s*(a|an|the|create|generate|imagine|depict|visualize|craft|design|draw|paint|render|capture|illustrate|make|produce|compose|"
    r"show|portrait|photo|cinematic|macro|studio|editorial|anime|abstract|surreal|futuristic)\b"
)


def looks_like_prompt(c: Column) -> Column:
    """Whether a block of a book is likely a prompt."""
    t = normalise_line(c)
    shape = t.contains(",") | t.contains("--") | F.lower(t).contains("/imagine")
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    return (
        F.length(t).between(30, 900) & ~t.rlike(_NOT_PROMPT) & ~t.rlike(r"(?U)^\s*\d+(?:\.\d+)+\s+\w+") & ~t.rlike(_LIST)
        & ~((dots >= 5) & ~t.contains(",") & ~t.contains("--")) & t.rlike(r"\p{L}") & t.rlike(_IMAGE) & (shape | t.rlike(_OPENING))
    )
