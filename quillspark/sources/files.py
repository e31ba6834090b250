"""Reading files: texts, import documents, zipped packs, books in binary formats."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import concept as concept_of
from quillspark.functions.text import detect_syntax, identifier

IMPORT_SCHEMA = (
    "wildcard_library string, prompt_identifiers array<struct<identifier:string, concept:string, status:string, metadata:string, wildcard_refs:array<string>, "
    "style_variations:array<struct<identifier:string, syntax_family:string, positive_template:string, negative_template:string, negative_prompt_strategy:string, notes:string>>>>"
)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of the .txt files of a folder that are not empty."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return raw.select(F.col("_metadata.file_name").alias("source_file"), F.replace("value", F.lit("\u0000"), F.lit("")).alias("text")).where("text <> ''")


def import_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(values, prompts) of import JSON files; see parse_import()."""
    return parse_import(spark.read.text(path, wholetext=True))


def parse_import(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, prompts) of import documents as JSON in a column value. values: (raw_key, ord, value, weight), a value as text
    or as an object with a weight, 1 by default, a list only; prompts: (ord, identifier, concept, status, metadata, wildcard_refs,
    style_variations), status draft and metadata {} where they are missing."""
    d = docs.select(F.from_json("value", IMPORT_SCHEMA).alias("d")).select("d.*")
    library = F.from_json("wildcard_library", "map<string,string>")
    lists = d.select(F.explode(library).alias("raw_key", "vs")).where(F.col("vs").startswith("["))
    v = lists.select("raw_key", F.posexplode(F.from_json("vs", "array<string>")).alias("ord", "v"))
    o = F.from_json("v", "value string, weight double")
    is_object = F.col("v").startswith("{")
    values = v.select("raw_key", "ord", F.when(is_object, o["value"]).otherwise(F.col("v")).alias("value"), F.coalesce(F.when(is_object, o["weight"]), F.lit(1.0)).alias("weight")).where("value <> ''")
    p = d.select(F.posexplode("prompt_identifiers").alias("ord", "p")).select("ord", "p.*")
    prompts = p.withColumn("status", F.coalesce("status", F.lit("draft"))).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    return values, prompts


def flat_entries(items: DataFrame) -> DataFrame:
    """(identifier, concept, status, metadata, style, positive_template) of a flat list (idx, title, prompt, platform, category,
    source): what the import reads, one template in the style the prompt is written in."""
    concept = concept_of(F.col("prompt"), drop_parameters=True)
    meta = F.to_json(F.struct(F.col("source").alias("original_source"), F.col("prompt").alias("original_prompt"), F.col("idx").alias("source_index"), "title", "platform", "category"))
    style = detect_syntax(F.col("prompt"), parameters=True)
    return items.select(identifier(concept, F.col("idx")).alias("identifier"), concept.alias("concept"), F.lit("active").alias("status"), meta.alias("metadata"), style.alias("style"), F.col("prompt").alias("positive_template"))


def _packed(data: bytes, member: str | None) -> list[tuple[int, str, str]]:
    out, negative, inside = [], "", False
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [member] if member else [n for n in z.namelist() if n.lower().endswith(".prompts")]
        if len(names) != 1:
            raise ValueError(f"expected one .prompts member, found {len(names)}")
        for raw in z.open(names[0]):
            line = " ".join(html.unescape(raw.decode("utf-8", "ignore")).replace("\x00", "").split())
            if len(line) > 1 and line[0] == line[-1] and line[0] in "'\"":
                line = line[1:-1].strip()
            if not line or line.startswith("#"):
                continue
            if re.fullmatch(r"\[(config|prompts)\]", line, re.I):
                inside = line.lower() == "[prompts]"
            elif inside:
                out.append((len(out), line, negative))
            elif (m := re.match(r"!NEG_PROMPT\s*=\s*(.*)", line)) and not negative:
                negative = m[1].strip()
    return out


def zipped(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(source_file, idx, line, negative) of zipped packs, one member each. An archive is read whole in one task, as its format asks."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p.rsplit("/", 1)[-1], *x) for x in _packed(c, member)], columns=["source_file", "idx", "line", "negative"])

    return raw.mapInPandas(run, "source_file string, idx bigint, line string, negative string")


def archive(spark: SparkSession, path: str, to: str) -> int:
    """Moves the files of a folder, once read, into another and returns how many; one that is there already is kept beside
    it under a numbered name."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(to))
    moved = 0
    for f in fs.listStatus(at(path)):
        if f.isFile() and not f.getPath().getName().startswith((".", "_")):
            name, k = f.getPath().getName(), 0
            stem, dot, end = name.rpartition(".")
            while fs.exists(at(f"{to}/{name}")):
                k += 1
                name = f"{stem}-{k}{dot}{end}" if dot else f"{end}-{k}"
            moved += bool(fs.rename(f.getPath(), at(f"{to}/{name}")))
    return moved


def books(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text, error) of .epub and .pdf files. An .epub is a zip of pages, whose text is taken without markup;
    a .pdf needs a library that may not be there, which is then the row's error."""
    raw = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(epub|pdf)$")).select("path", "content")

    def text_of(name: str, data: bytes) -> str:
        if name.lower().endswith(".epub"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                pages = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
                return "\n\n".join(html.unescape(re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "ignore"))).strip() for n in pages)
        from pypdf import PdfReader  # gated: not part of the base install

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows.append((p.rsplit("/", 1)[-1], text_of(p, c), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p.rsplit("/", 1)[-1], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "text", "error"])

    return raw.mapInPandas(run, "source_file string, text string, error string")
