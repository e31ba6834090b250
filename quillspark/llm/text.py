"""Column expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: `Label:` at the start of a part of a labelled record.
LABEL = r"^\s*\p{L}[\p{L}\p{N} _]{0,30}\s*:"
_NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"


def plain_words(c: Column) -> Column:
    """Words in lower case with single spaces; every run of anything but letters, digits and marks separates words.
    Upper-casing first folds letters with several lower-case forms together; a sharp s is written out."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss")), _NOT_WORD, " "))


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | ~c.rlike(r"\S")


def format_free(c: Column) -> Column:
    """What a text says, without its format: plain words, with the members of a JSON object or of a list of
    `Label: value` parts (on lines, or separated by semicolons) in sorted order. Null stays null."""
    members = F.from_json(c, "map<string,string>")
    parts = F.filter(F.split(c, r"[\n\r;]+"), lambda p: p.rlike(r"\S"))
    labelled = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(LABEL))
    in_order = lambda a: F.array_join(F.sort_array(a), " ")
    json_form = in_order(
        F.transform(F.map_entries(members), lambda e: plain_words(F.concat_ws(" ", e["key"], e["value"])))
    )
    return (
        F.when(c.rlike(r"^\s*\{") & (F.size(members) > 0), json_form)
        .when(labelled, in_order(F.transform(parts, plain_words)))
        .otherwise(plain_words(c))
    )


#: What a generator adds to a prompt: add-on tags, parameters, the weight that closes a bracket.
_ADD_ON, _PARAMETER, _WEIGHT = r"<[^<>]{0,200}>", r"(?<!\S)--\p{L}+(?:[ =]+[\w:.]+)?", r":\s*\d+(?:\.\d+)?(?=\s*[)\]])"
_NEGATIVE = r"(?i)\bnegative[ _]+prompt\b\s*[\"”]?\s*:[^\n\r]*"
#: Labels of labelled parts, and the names of JSON members.
_LABELS = r"(?:^|(?<=[\n\r;]))\s*\p{L}[\p{L}\p{N} _]{0,20}\s*:|\"[^\"\n]{1,30}\"\s*:"
#: Words that only tie phrases together when a list of phrases is written out in sentences.
GLUE = ["a", "an", "and", "add", "has", "picture", "the"]


def prompt_words(c: Column) -> Column:
    """The distinct words of a prompt, sorted, without its format, labels, parameters, add-on tags, weights, glue
    words and negative prompt. Null gives null."""
    t = c
    for pattern in (_NEGATIVE, _ADD_ON, _PARAMETER, _WEIGHT, _LABELS):
        t = F.regexp_replace(t, pattern, " ")
    words = F.split(plain_words(t), " ")
    return F.sort_array(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in ["", *GLUE]])))
