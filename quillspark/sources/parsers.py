"""Parsers that turn raw text into records.

Lines are exploded with their position and grouped by running counts of the lines that start something; windows are
partitioned by document, so only one document's lines meet in a task. All frames have doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import FIELD, LABELS, normalise_line, strip

_HEADER = r"(?Umd)^###\s+(.+?)\s*$"


def detect_format(c: Column) -> Column:
    """dream_factory, structured, sectioned or raw."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    fields = F.size(F.filter(lines, lambda x: x.rlike(FIELD)))
    return (
        F.when(c.rlike(r"(?i)\[config\]|\[prompts\]"), F.lit("dream_factory"))
        .when((F.size(lines) > 0) & (fields / F.size(lines) > 0.5), F.lit("structured"))
        .when(c.rlike(_HEADER), F.lit("sectioned"))
        .otherwise(F.lit("raw"))
    )


#: Blank lines, which part blocks; the platforms whose headers name a section.
_BLANK, _PLATFORM = r"(?U)\n\s*\n", "^(Midjourney|Nano|Flux)"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))


def _full(texts: Column) -> Column:
    """An array of texts stripped, without empty ones."""
    return F.filter(F.transform(texts, strip), lambda x: x != "")


def _parts(c: Column) -> Column:
    """What stands before, in and after each `###` header, none empty."""
    return _full(F.split(F.regexp_replace(F.concat(F.lit("\n"), c), r"(?U)\n###\s+([^\n]+?)\s*\n", "\u0001$1\u0001"), "\u0001"))


def block_texts(c: Column) -> Column:
    """The parts of a text between blank lines."""
    return _full(F.split(c, _BLANK))


def section_texts(c: Column) -> Column:
    """The blocks of all sections of a text, in order."""
    return F.flatten(F.transform(F.filter(_parts(c), lambda p: ~p.rlike(_PLATFORM)), block_texts))


def _bound(c: Column, use) -> Column:
    """use(c) for an array-valued use, in which c is a variable and worked out once, not at every place and element."""
    return F.flatten(F.transform(F.array(c), use))


def record_texts(c: Column) -> Column:
    """The labelled records of a text: a line that is no field begins one where the line before it is a field."""
    # each line with whether it is a field, in one array of pairs
    lines = F.transform(_full(F.split(c, "\n")), lambda x: F.struct(x.alias("x"), x.rlike(FIELD).alias("f")))

    def cut(held: Column) -> Column:
        starts = lambda y, i: (i > 0) & ~y["f"] & F.get(held, i - 1)["f"]
        marked = F.transform(held, lambda y, i: F.concat(F.when(starts(y, i), F.lit("\u0001")).when(i > 0, F.lit("\n")).otherwise(F.lit("")), y["x"]))
        return F.filter(F.split(F.array_join(marked, ""), "\u0001"), lambda x: x != "")

    return _bound(lines, cut)


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, raw): the parts between blank lines, idx counting those that are not empty."""
    return docs.select("doc_id", F.posexplode(block_texts(F.col("text"))).alias("idx", "raw"))


def sectioned(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, section, raw): blocks under `###` headers. Headers of three known platforms name the section, which is
    carried forward; any other header is content of its own, and so is one right after another."""
    parts = docs.select("doc_id", F.posexplode(_parts(F.col("text"))).alias("p", "part"))
    named = F.col("part").rlike(_PLATFORM)
    name = F.replace(F.replace(F.replace(F.lower("part"), F.lit(" prompts"), F.lit("")), F.lit(" prommpts"), F.lit("")), F.lit(" "), F.lit("-"))
    line = W.partitionBy("doc_id").orderBy("p")
    parts = parts.withColumn("section", F.coalesce(F.last(F.when(named, name), ignorenulls=True).over(line), F.lit("stable-diffusion"))).where(~named)
    out = parts.select("doc_id", "p", "section", F.posexplode(block_texts(F.col("part"))).alias("q", "raw"))
    return out.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("p", "q")) - 1).alias("pos"), "section", "raw")


def structured(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, raw): see record_texts()."""
    return docs.select("doc_id", F.posexplode(record_texts(F.col("text"))).alias("idx", "raw"))


def fields(raw: Column) -> Column:
    """struct(concept, fields) of a labelled record: fields as a map, values of a repeated label joined by spaces, and the lines
    that are no fields as concept; without such lines subject and environment."""
    part = lambda x, k: strip(F.regexp_extract(x, FIELD, k))
    lines = F.transform(_full(F.split(raw, "\n")), lambda x: F.struct(x.alias("x"), F.when(x.rlike(FIELD), F.struct(part(x, 1).alias("k"), part(x, 2).alias("v"))).alias("p")))

    def read(held: Column) -> Column:
        pairs = F.transform(F.filter(held, lambda y: y["p"].isNotNull()), lambda y: y["p"])
        text = F.array_join(F.transform(F.filter(held, lambda y: y["p"].isNull()), lambda y: y["x"]), " ")
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        values = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), " "))
        return F.array(F.struct(text.alias("t"), F.map_from_arrays(keys, values).alias("m")))

    def named(r: Column) -> Column:
        of = lambda label: F.coalesce(F.try_element_at(r["m"], F.lit(label)), F.lit(""))
        fallback = F.btrim(F.concat(of("Subject"), F.lit(", "), of("Environment")), F.lit(", "))
        return F.struct(F.when((r["t"] == "") & (F.size(r["m"]) > 0), fallback).otherwise(r["t"]).alias("concept"), r["m"].alias("fields"))

    return F.get(F.transform(_bound(lines, read), named), F.lit(0))


def fields_of(records: DataFrame) -> DataFrame:
    """(doc_id, idx, concept, fields) of labelled records; see fields()."""
    return records.select("doc_id", "idx", fields(F.col("raw")).alias("r")).select("doc_id", "idx", "r.concept", "r.fields")


def generator(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of generator texts. files: (doc_id, header map, settings map, negative); lines: (doc_id, block, pos,
    line) of the prompt blocks, block from 0 counting those with lines."""
    all_lines = _lines(docs)
    comment = (F.col("line") == "") | F.col("line").startswith("#")
    is_config, is_prompts = F.col("line").rlike(r"(?i)^\[config\]"), F.col("line").rlike(r"(?i)^\[prompts\]")
    line = W.partitionBy("doc_id").orderBy("pos")
    mark = F.when(~comment & is_config, "config").when(~comment & is_prompts, "prompts")
    held = all_lines.select("doc_id", "pos", "line", comment.alias("comment"), mark.alias("mark"))
    held = held.withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(line), F.lit("header"))).withColumn("block", F.sum((F.col("mark") == "prompts").cast("int")).over(line))
    body = held.where(~F.col("comment") & F.col("mark").isNull() & (F.col("section") == "prompts"))
    body = body.select("doc_id", (F.dense_rank().over(W.partitionBy("doc_id").orderBy("block")) - 1).alias("block"), (F.row_number().over(W.partitionBy("doc_id", "block").orderBy("pos")) - 1).alias("pos"), "line")
    setting = r"(?U)^!(\w+)\s*=\s*(.+)$"
    config = held.where((F.col("section") == "config") & ~F.col("comment") & F.col("line").rlike(setting)).select("doc_id", "pos", F.regexp_extract("line", setting, 1).alias("k"), strip(F.regexp_extract("line", setting, 2)).alias("v"))
    last = config.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "k").orderBy(F.desc("pos")))).where("n = 1")
    settings = last.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("settings"))
    # the first setting of the negative prompt counts
    negative = config.where("k = 'NEG_PROMPT'").groupBy("doc_id").agg(F.min_by("v", "pos").alias("negative"))
    info = held.where((F.col("section") == "header") & F.col("line").rlike("^#[^:]*:")).select("doc_id", "pos", F.translate(F.lower(strip(F.regexp_extract("line", "^[# ]*([^:]*):(.*)$", 1))), " ", "_").alias("k"), strip(F.regexp_extract("line", "^[# ]*([^:]*):(.*)$", 2)).alias("v"))
    info = info.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "k").orderBy(F.desc("pos")))).where("n = 1")
    header = info.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("header"))
    files = docs.select("doc_id").join(header, "doc_id", "left").join(settings, "doc_id", "left").join(negative, "doc_id", "left")
    return files, body


# The first of these found in a block's first line names its wildcard.
KEY_WORDS = [
    ("woman", "gender"), ("man", "gender"), ("old", "age"), ("young", "age"), ("middle aged", "age"), ("handsome", "appearance"), ("attractive", "appearance"),
    ("irish", "ethnicity"), ("scottish", "ethnicity"), ("english", "ethnicity"), ("ukrainian", "ethnicity"), ("russian", "ethnicity"), ("hungarian", "ethnicity"),
    ("japanese", "ethnicity"), ("icelandic", "ethnicity"), ("knight", "character_class"), ("ranger", "character_class"), ("paladin", "character_class"),
    ("barbarian", "character_class"), ("bard", "character_class"), ("druid", "character_class"), ("rogue", "character_class"), ("fighter", "character_class"),
    ("monk", "character_class"), ("wizard", "character_class"), ("warlock", "character_class"), ("sitting on the cliff", "pose_setting"),
    ("leaning against a tree", "pose_setting"), ("walking in the forest", "pose_setting"), ("sitting by a river", "pose_setting"),
    ("walking through a fantasy village", "pose_setting"), ("a moonlit night", "time_of_day"), ("during the day", "time_of_day"), ("at sunrise", "time_of_day"), ("at sunset", "time_of_day"),
]


def block_key(first_line: Column, index: Column, size: Column) -> Column:
    """The wildcard key of a block, by its first line; else numbered, as a literal if it has one line."""
    low = F.lower(first_line)
    out = F.when(low.contains(KEY_WORDS[0][0]), F.lit(KEY_WORDS[0][1]))
    for word, key in KEY_WORDS[1:]:
        out = out.when(low.contains(word), F.lit(key))
    number = F.when(index < 10, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return out.otherwise(F.concat(F.when(size == 1, F.lit("literal_")).otherwise(F.lit("option_")), number))


def generator_template(lines: DataFrame) -> DataFrame:
    """(doc_id, template, keys) assembled from blocks: a block of several lines is a wildcard, some single lines stay as
    connecting text. A template without content is left out."""
    per = lines.groupBy("doc_id", "block").agg(F.count("*").alias("n"), F.min_by("line", "pos").alias("first"))
    literal = (F.col("n") == 1) & (F.col("first").startswith(",") | F.col("first").isin("close up of 1", "descent,", ","))
    key = block_key(F.col("first"), F.col("block"), F.col("n"))
    part = F.when(literal & (F.col("first") == "close up of 1"), F.lit("close up portrait of 1")).when(literal, F.col("first")).otherwise(F.concat(F.lit("{"), key, F.lit("}")))
    per = per.select("doc_id", F.struct("block", part.alias("part"), F.when(~literal, key).alias("key")).alias("b"))
    g = per.groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    t = strip(F.regexp_replace(F.array_join(F.transform("bs", lambda b: b["part"]), " "), r"(?U)\s+", " "))
    t = F.replace(F.replace(F.regexp_replace(t, r"(?U)\s*,\s*", ", "), F.lit(" ,"), F.lit(",")), F.lit(",  "), F.lit(", "))
    t = F.btrim(t, F.lit(", "))
    t = F.when(t.startswith("{"), t).otherwise(F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2))))
    keys = F.filter(F.transform("bs", lambda b: b["key"]), lambda k: k.isNotNull())
    return g.select("doc_id", t.alias("template"), keys.alias("keys")).where("template <> ''")


_ENTRY = r"(?iU)^\s*(?:(?:prompt\s*)?\d{1,5}\s*[\.):-]\s*|prompt\s*\d{0,5}\s*[:.-]\s*|/imagine\s+prompt:?\s*)"


def inbox_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, block): numbered entries with the lines that follow them up to a blank line; any other line is a block
    of its own; lines of page numbers are dropped."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")).alias("pos", "line")).withColumn("line", normalise_line(F.col("line")))
    lines = lines.where(~F.col("line").rlike(r"(?U)^\s*\d{1,4}\s*$"))
    w = W.partitionBy("doc_id").orderBy("pos")
    starts, blank = F.col("line").rlike(_ENTRY), F.col("line") == ""
    # an entry is open from its start to the next blank line
    state = F.last(F.when(starts, True).when(blank, False), ignorenulls=True).over(w)
    lines = lines.withColumn("starts", starts).withColumn("inside", F.coalesce(state, F.lit(False))).where("line <> ''")
    lines = lines.withColumn("idx", F.sum((F.col("starts") | ~F.col("inside")).cast("int")).over(w) - 1)
    text = F.when(F.col("starts"), strip(F.regexp_replace("line", _ENTRY, ""))).otherwise(F.col("line"))
    g = lines.groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("ls"))
    return g.select("doc_id", F.col("idx").cast("int").alias("idx"), strip(F.array_join(F.transform("ls", lambda x: x["t"]), " ")).alias("block")).where("block <> ''")


def numbered(docs: DataFrame, first: int = 1, last: int = 20, after: str | None = None, before: str | None = None) -> DataFrame:
    """(doc_id, num, text) of numbered lines in a range, in the part between two marks if they occur."""
    t = F.col("text")
    if after:
        t = F.when(t.contains(after), F.get(F.split(t, re.escape(after)), F.lit(1))).otherwise(t)
    if before:
        t = F.get(F.split(t, re.escape(before)), F.lit(0))
    each = docs.select("doc_id", F.explode(F.regexp_extract_all(t, F.lit(r"(?Umd)^\s*\d+\.\s*.+?$"), 0)).alias("l"))
    num = F.regexp_extract("l", r"(?U)^\s*(\d+)\.", 1).cast("bigint")
    return each.select("doc_id", num.alias("num"), strip(F.regexp_replace("l", r"(?U)^\s*\d+\.\s*", "")).alias("text")).where(F.col("num").between(first, last) & (F.col("text") != ""))


def headed_samples(docs: DataFrame) -> DataFrame:
    """(doc_id, num, title, sample): every `Prompt sample: "..."` with the last `N. title` line that begins before it."""
    marked = F.regexp_replace("text", r"(?Umds)(^\d+\.\s*[^\n]+$|Prompt sample:\s*\"[^\"]*\")", "\u0001$1\u0001")
    e = docs.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("pos", "e"))
    head = F.when(F.col("e").rlike(r"(?U)^\d+\.\s*[^\n]+$") & ~F.col("e").startswith("Prompt sample:"), F.col("e"))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("head", F.last(head, ignorenulls=True).over(w)).where(F.col("e").startswith("Prompt sample:") & F.col("head").isNotNull())
    sample = strip(F.regexp_replace(F.regexp_extract("e", r'(?s)"([^"]*)"', 1), r"(?U)\s+", " "))
    return e.select("doc_id", F.regexp_extract("head", r"^(\d+)\.", 1).cast("bigint").alias("num"), strip(F.regexp_replace("head", r"(?U)^\d+\.\s*", "")).alias("title"), sample.alias("sample"))


def continued_titles(docs: DataFrame, categories: dict[str, str], skip: list[str] = ()) -> DataFrame:
    """(doc_id, num, title, text, category): `#N. Title: text` lines with the lines that continue them; lines that are a
    category's name carry it forward."""
    lines = _lines(docs).where((F.col("line") != "") & ~F.col("line").rlike(r"^\d+/\d+$"))
    for p in skip:
        lines = lines.where(~F.col("line").startswith(p))
    w = W.partitionBy("doc_id").orderBy("pos")
    is_cat = F.col("line").isin(list(categories))
    named = F.when(is_cat, F.try_element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("line")))
    start = r"(?U)^#(\d+)\.\s*(.+?):\s*(.*)"
    lines = lines.withColumn("category", F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit("General"))).where(~is_cat)
    lines = lines.withColumn("s", F.col("line").rlike(start)).withColumn("g", F.sum(F.col("s").cast("int")).over(w)).where("g > 0")
    text = F.when(F.col("s"), F.regexp_extract("line", start, 3)).otherwise(F.col("line"))
    g = lines.groupBy("doc_id", "g").agg(F.min_by("line", "pos").alias("h"), F.min_by("category", "pos").alias("category"), F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("ls"))
    return g.select("doc_id", F.regexp_extract("h", start, 1).cast("bigint").alias("num"), strip(F.regexp_extract("h", start, 2)).alias("title"), strip(F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["t"]), " "), r"(?U)\s+", " ")).alias("text"), "category")


def chapter(docs: DataFrame, begin: str, end: str, entry: str) -> DataFrame:
    """(doc_id, num, title, text) of entries (a pattern with three groups) in the part of a text between two marks; the
    first of equal titles."""
    part = F.get(F.split(F.get(F.split("text", re.escape(begin)), F.lit(1)), re.escape(end)), F.lit(0))
    e = docs.where(F.col("text").contains(begin)).select("doc_id", F.posexplode(F.regexp_extract_all(part, F.lit("(?s)" + entry), 0)).alias("pos", "e"))
    out = e.select("doc_id", "pos", F.regexp_extract("e", "(?s)" + entry, 1).alias("num"), strip(F.regexp_extract("e", "(?s)" + entry, 2)).alias("title"), strip(F.regexp_extract("e", "(?s)" + entry, 3)).alias("text"))
    n = F.row_number().over(W.partitionBy("doc_id", "title").orderBy("pos"))
    return out.withColumn("n", n).where("n = 1").drop("n", "pos")


def phrase_list(lines: DataFrame) -> DataFrame:
    """(token): phrases and their tokens from `rank phrase number count` lines."""
    p = r"(?U)^\s*\d+\s+(.+?)\s+\d+(?:\.\d+)?\s+\d+\s*$"
    phrase = F.lower(strip(F.regexp_extract("value", p, 1)))
    both = F.concat(F.array(phrase), F.regexp_extract_all(phrase, F.lit("[a-z0-9][a-z0-9_-]*"), 0))
    return lines.where(F.col("value").rlike(p)).select(F.explode(both).alias("token")).distinct()


def _example(text: str) -> list[tuple[str, str | None]]:
    """Positive prompts of one example with the negative that follows each."""
    ends_p = {"Negative Prompt", "Parameters and Data", "Parameter", "Pameter", "Same as above", "Paramater", "Paramater and Data"}
    ends_n = {"Parameters and Data", "Parameter", "Pameter", "Upscale", "ADetailer", "Paramater", "Paramater and Data"}
    lines, found, skipped, k = [x for x in text.split("\n")], [], False, 0

    def block(k: int, ends: set[str], also: str | None) -> tuple[list[str], int]:
        out = []
        while k < len(lines):
            s = lines[k].strip()
            if s == also or s in ends:
                break
            if not s:
                ahead = next((x.strip() for x in lines[k:] if x.strip()), None)
                if ahead in ends:
                    break
            if also and s.startswith("`"):
                k += 1
                continue
            if not also and s == "N/A":
                return out, k + 1
            out.append(lines[k])
            k += 1
        return out, k

    while k < len(lines):
        s = lines[k].strip()
        if s.startswith("ADetailer"):
            skipped = True
        elif re.match(r"Example \d+:", s):
            skipped = False
        elif s == "Prompt" and not skipped:
            got, k = block(k + 1, ends_p, "Prompt")
            if len(t := "\n".join(got).strip()) > 20:
                found.append([t, None])
            continue
        elif s.startswith("Negative Prompt") and not skipped:
            got, k = block(k + 1, ends_n, None)
            t = "\n".join(got).strip()
            open_ = [f for f in found if f[1] is None]
            if t and open_:
                open_[-1][1] = t
            continue
        k += 1
    return [(a, b) for a, b in found]


def example_book(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, positive, negative) of example texts with prompt and negative-prompt blocks; what is inside a detailer's
    section is left out. The state of a line depends on all lines before it, so a text is read as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, p, n) for d, t in zip(b["doc_id"], b["text"]) if t for k, (p, n) in enumerate(_example(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "positive", "negative"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, idx int, positive string, negative string")


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "LABELS"}]
