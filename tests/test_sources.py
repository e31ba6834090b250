import json
import zipfile

from pyspark.sql import functions as F

from quillspark.catalog import Catalog
from quillspark.cli import main
from quillspark.plans import pipelines
from quillspark.sources import files
from quillspark.sources import parsers as P
from quillspark.streaming import ingest


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_formats(spark):
    d = docs(spark, "a\n[CONFIG]\nb", "Subject: x\nlighting: y\nz", "### Flux Prompts\n\na", "plain", "")
    assert [r[0] for r in d.select("doc_id", P.detect_format(F.col("text")).alias("f")).orderBy("doc_id").select("f").collect()] == ["dream_factory", "structured", "sectioned", "raw", "raw"]


def test_blocks_and_sections(spark):
    d = docs(spark, "a\n b\n \n\nc", "### Midjourney Prompts\nx\n\ny\n### Other Things\nz", "")
    assert rows(P.blocks(d.where("doc_id = 0")), "idx", "raw") == [(0, "a\n b"), (1, "c")]
    assert rows(P.sectioned(d.where("doc_id = 1")), "pos", "section", "raw") == [(0, "midjourney", "x"), (1, "midjourney", "y"), (2, "midjourney", "Other Things"), (3, "midjourney", "z")]
    assert P.blocks(d.where("doc_id = 2")).count() == 0


def test_structured(spark):
    d = docs(spark, "Title one\nSubject: a\nSubject: b\nTitle two\nmore\nlighting: c")
    s = P.structured(d)
    assert rows(s, "idx", "raw") == [(0, "Title one\nSubject: a\nSubject: b"), (1, "Title two\nmore\nlighting: c")]
    f = {r["idx"]: (r["concept"], r["fields"]) for r in P.fields_of(s).collect()}
    assert f[0] == ("Title one", {"Subject": "a b"}) and f[1] == ("Title two more", {"lighting": "c"})


def test_generator(spark):
    d = docs(spark, "# title: T x\n# Big Name: v\n[config]\n!NEG_PROMPT = (bad:1.2)\n!STEPS = 3\n[prompts]\nold man\nyoung man\n[prompts]\n, with\n[prompts]\nclose up of 1\n[prompts]\nred\n")
    files_, lines = P.generator(d)
    f = files_.first()
    assert f["header"] == {"title": "T x", "big_name": "v"} and f["settings"]["STEPS"] == "3" and f["negative"] == "(bad:1.2)"
    t = P.generator_template(lines).first()
    assert t["template"] == "{gender}, with close up portrait of 1 {literal_03}" and t["keys"] == ["gender", "literal_03"]


def test_inbox_blocks(spark):
    d = docs(spark, "Intro line\n1. first entry\ngoes on\n42\nends\n\nloose one\nloose two\nPrompt 2: next\n")
    assert rows(P.inbox_blocks(d), "idx", "block") == [(0, "Intro line"), (1, "first entry goes on ends"), (2, "loose one"), (3, "loose two"), (4, "next")]


def test_pack_outcomes(spark):
    lines = spark.createDataFrame([(0, "a fine old picture of hills", "n"), (1, "a fine old picture of hills", "n"), (2, "x", "n"), (3, "x", "n"), (4, "known line of many words", "n")], "idx bigint, line string, negative string")
    known = lines.where("idx = 4").select(F.concat(F.lit("s_"), F.substring(F.sha1("line"), 1, 16)).alias("identifier"))
    assert [r["outcome"] for r in pipelines.pack_rows(lines, known, "s").orderBy("idx").collect()] == ["imported", "skipped", "rejected", "skipped", "skipped"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "empty.txt").write_text("")
    assert rows(files.texts(spark, str(tmp_path)), "source_file", "text") == [("a.txt", "hello\nworld")]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("x.prompts", '[config]\n!NEG_PROMPT = blur\n[prompts]\n# no\n"a &amp; b"\n\nc\n')
    assert rows(files.zipped(spark, str(tmp_path)), "idx", "line", "negative") == [(0, "a & b", "blur"), (1, "c", "blur")]
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("1.xhtml", "<p>Some <b>text</b></p>")
    b = files.books(spark, str(tmp_path)).collect()
    assert len(b) == 1 and "Some" in b[0]["text"] and b[0]["error"] is None


def test_import_versions_and_cli(spark, tmp_path, capsys):
    doc = {
        "wildcard_library": {"Light-Kind": ["rim", {"value": "storm", "weight": 3.0}]},
        "prompt_identifiers": [
            {"identifier": "p1", "concept": "cat", "wildcard_refs": ["light kind", "zz"], "style_variations": [{"identifier": "comma-separated", "syntax_family": "comma-separated", "positive_template": "{light_kind} {concept}", "negative_template": ""}]},
            {"identifier": "p2", "concept": "dog", "status": "wrong", "style_variations": []},
        ],
    }
    (tmp_path / "in.json").write_text(json.dumps(doc))
    c = Catalog(spark, str(tmp_path / "lib"))
    c.initialise()
    dry = pipelines.import_file(c, str(tmp_path / "in.json"), dry_run=True)
    assert rows(dry["actions"], "identifier", "action") == [("p1", "created")] and c.load("prompts").count() == 0
    out = pipelines.import_file(c, str(tmp_path / "in.json"))
    assert rows(out["rejected"], "identifier", "reason") == [("p2", "status: wrong")]
    assert rows(c.load("wildcard_values"), "value", "weight") == [("rim", 1.0), ("storm", 3.0)]
    assert c.load("prompt_wildcard_bindings").count() == 1 and c.load("prompt_versions").count() == 1
    pipelines.import_file(c, str(tmp_path / "in.json"))
    assert c.load("prompt_versions").count() == 1 and c.load("imports").where("status = 'completed'").count() == 2
    doc["prompt_identifiers"][0]["concept"] = "cats"
    (tmp_path / "in.json").write_text(json.dumps(doc))
    pipelines.import_file(c, str(tmp_path / "in.json"))
    assert rows(c.load("prompt_versions"), "version", "change_type") == [(1, "created"), (2, "updated")]
    assert rows(c.load("prompts"), "id", "concept") == [(1, "cats")]
    root = ["--root", str(tmp_path / "lib")]
    assert main([*root, "render", "p1", "--seed", "1", "--set", "light_kind=dim"]) == 0 and "dim cats" in capsys.readouterr().out
    assert main([*root, "validate"]) == 0 and main([*root, "search", "CAT"]) == 0 and "p1" in capsys.readouterr().out


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("a fine old picture of hills\nshort\na fine old picture of hills\n")
    ingest.ingest(spark, str(src), out, ck, "s")
    (src / "b.txt").write_text("a fine old picture of hills\nanother picture of the sea\n")
    ingest.ingest(spark, str(src), out, ck, "s")
    assert rows(spark.read.parquet(out), "cleaned") == [("a fine old picture of hills",), ("another picture of the sea",)]


def test_chunks_on_disk(spark, tmp_path):
    rows_ = spark.createDataFrame([(g, i, "x") for g, n in (("a", 7), ("b", 2)) for i in range(n)], "slug string, number int, t string")
    pipelines.write_chunks(rows_, str(tmp_path / "c"), "slug", "number", 3)
    got = spark.read.json(str(tmp_path / "c"))
    assert rows(got.groupBy("slug", "part").count(), "slug", "part", "count") == [("a", 1, 3), ("a", 2, 3), ("a", 3, 1), ("b", 1, 2)]
    pipelines.write_chunks(rows_.where("slug = 'b'"), str(tmp_path / "c"), "slug", "number", 3)
    assert spark.read.json(str(tmp_path / "c")).count() == 2  # stale parts are gone


def test_inbox_entries(spark):
    text = "1. A wide landscape painting, low light over hills\n\nA wide  landscape painting, low light over hills\n2. studio portrait photo, (:1.2)\nplain words only here\n3. Copyright page of the portrait book, all rights reserved"
    d = spark.createDataFrame([(1, "book", text), (2, "none", "nothing here")], "doc_id bigint, slug string, text string")
    e = pipelines.inbox_entries(d)
    assert rows(e, "idx", "outcome", "identifier") == [(0, "accepted", "book_00000"), (2, "accepted", "book_00001")]
    assert rows(pipelines.inbox_manifest(d, e), "slug", "prompts", "rejected", "chunks") == [("book", 2, 0, 1), ("none", 0, 0, 0)]


def test_event_windows_as_a_stream(spark, tmp_path):
    src = tmp_path / "ev"
    spark.sql("select timestamp'2025-01-01 00:10:00' as ts, 'view' as event_type, 1.0D as value union all select timestamp'2025-01-01 00:50:00', 'view', 2.0D union all select timestamp'2025-01-01 03:00:00', 'view', 4.0D").write.parquet(str(src))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(src))
    q = ingest.windowed_counts(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("w").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]


def test_catalog_views_and_snapshots(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "lib"))
    c.initialise()
    old = c.load("prompt_sets")
    c.save("prompt_sets", spark.createDataFrame([(1, "s", "active")], "id bigint, name string, status string"))
    c.views()
    assert spark.sql("select name from prompt_sets").collect()[0][0] == "s" and old.count() == 0
    c.reset()
    assert c.load("prompt_sets").count() == 0
