"""Numbering, commits that add parts, packs in batches, files, and the rewriter against a regular expression."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.catalog import Catalog
from quillspark.operators import jobs, merge, mining
from quillspark.plans import pipelines
from quillspark.sources import files
from quillspark.sources import parsers as P


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_numbers_within_groups_equal_a_plain_count(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(40)) for i in range(900)]
    df = spark.createDataFrame(data, "i int, g string, o int")
    got = {r["i"]: r["n"] for r in merge.number_within(df, "g", ["o", "i"], "n").collect()}
    for g in ("hot", "a", "b", None):
        own = sorted((o, i) for i, x, o in data if x == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert merge.number_within(df.where("false"), "g", ["o"], "n").count() == 0
    parts = pipelines.with_parts(df, "g", "i", 100).groupBy("g", "part").count()
    assert parts.agg(F.max("count")).first()[0] == 100


def test_a_pack_is_imported_in_commits_and_goes_on_where_it_stood(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "lib"))
    c.initialise()
    lines = [(i, f"a wide view of the old harbour in storm number {i % 17}", "blurry") for i in range(23)] + [(23, "x", None)]
    df = spark.createDataFrame(lines, "idx bigint, line string, negative string")
    first = pipelines.import_pack(c, df.where("idx < 10"), "pack", commit_every=5)
    assert [x[0] for x in first] == [0, 5] and c.load("prompts").count() == 10
    again = pipelines.import_pack(c, df, "pack", commit_every=5)
    assert [x[0] for x in again] == [10, 15] and c.load("prompts").count() == c.load("prompt_templates").count() == 17
    assert pipelines.import_pack(c, df, "pack", commit_every=5) == [] and pipelines.import_pack(c, df.where("false"), "pack") == []
    ids = rows(c.load("prompts"), "id")
    assert ids == [(i + 1,) for i in range(17)] and len(c._current("prompts")) == 5 and c.load("imports").count() == 4


def test_a_file_a_task(spark, tmp_path):
    t = spark.createDataFrame([(1, 2, '{"a":1}'), (1, 3, '{"a":2}'), (2, 2, '{"a":3}')], "prompt_id bigint, style_id bigint, task string")
    jobs.write_tasks(t, str(tmp_path / "tasks"))
    found = sorted(p.read_text().strip() for p in (tmp_path / "tasks").rglob("*.txt"))
    assert found == ['{"a":1}', '{"a":2}', '{"a":3}']


def test_files_that_were_read_are_moved(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b"):
        (tmp_path / "in" / n).write_text(n)
    assert files.archive(spark, str(tmp_path / "in"), str(tmp_path / "done")) == 2
    (tmp_path / "in" / "a.txt").write_text("again")
    assert files.archive(spark, str(tmp_path / "in"), str(tmp_path / "done")) == 1
    assert {p.name for p in (tmp_path / "done").iterdir() if p.name[0] != "."} == {"a.txt", "a-1.txt", "b"}


def test_the_shared_folder(spark):
    session.release(spark)
    df = session.materialise(spark.range(5), "probe")
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x:1", getConf=lambda: {}, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def test_a_header_right_after_another_is_content(spark):
    df = spark.createDataFrame([(1, "### Flux Prompts\n### Other\nx\n\ny"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert rows(P.sectioned(df)) == [(1, 0, "flux", "### Other\nx"), (1, 1, "flux", "y")]
    assert rows(P.structured(spark.createDataFrame([(1, "a\nSubject: x\nHair: y\n\nb\nc\nSubject: z")], "doc_id bigint, text string"))) == [(1, 0, "a\nSubject: x\nHair: y"), (1, 1, "b\nc\nSubject: z")]


def test_rewriting_equals_the_longest_first_expression():
    rng = random.Random(8)
    words = ["rim", "light", "soft", "old-oak", "Dawn", "sun", "é", "x"]
    pairs = sorted({(" ".join(rng.choices(words, k=rng.randint(2, 4))), rng.choice("abc")) for _ in range(60)})
    longest = sorted({v for v, _ in pairs}, key=lambda v: (-len(v), v))
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, longest)) + r")\b", re.I)
    w = mining.Rewriter(pairs)
    for _ in range(300):
        text = " ".join(rng.choices([*words, "rimlight", "SOFT", "oak,", "light."], k=30))
        assert [(s, e) for s, e, _ in w.hits(text)] == [m.span() for m in pattern.finditer(text)]


def test_patterns_are_skipped_only_where_they_cannot_match():
    rng = random.Random(4)
    words = sorted({w for ps in mining.CATEGORIES.values() for p in ps for w in re.findall(r"[a-z0-9é/.-]+", p.replace(r"\b", " ").replace(r"\s+", " "))})
    texts = [" ".join(rng.choices(words, k=14)) for _ in range(400)] + [f"{a} {b}" for a in words for b in rng.sample(words, 3)]
    hits = 0
    for ps in mining.CATEGORIES.values():
        for p in ps:
            heads = mining.beginnings(p)
            for t in texts if heads else ():
                for m in re.finditer(p, t):
                    hits += 1
                    assert m[0].startswith(tuple(heads)) or any(h in t for h in heads), (p, m[0], heads)
    assert hits > 1_000
    assert mining.beginnings(r"\b(a|b?c)\b") == [] and mining.beginnings(r"x|y") == [] and mining.beginnings(r"\b(lights?|red (?:x|y)|red)\b") == ["light", "red"]


def test_small_scans_are_spread_and_nothing_else(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > df.rdd.getNumPartitions()
    counted = df.groupBy("id").count()
    assert session.spread(counted) is counted and sorted(r[0] for r in session.spread(df).collect()) == list(range(10))
