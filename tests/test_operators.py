import random

from pyspark.sql import functions as F

from quillspark.operators import evalset, jobs, library, merge, mining, render


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_upsert_orders_changes_and_numbers_versions(spark):
    stored = spark.createDataFrame([("a", "x", "draft"), ("b", "y", None)], "k string, c string, s string")
    incoming = spark.createDataFrame([("a", "x", "draft", 1), ("a", "z", "draft", 2), ("a", "z", "draft", 3), ("b", "y", None, 4), ("c", "n", "draft", 5), ("c", "n", "active", 6)], "k string, c string, s string, o int")
    m = merge.upsert(stored, incoming, ["k"], ["c", "s"], ["o"], spark.createDataFrame([("a", 4)], "k string, version int"))
    assert rows(m.actions, "o", "action") == [(1, "unchanged"), (2, "updated"), (3, "unchanged"), (4, "unchanged"), (5, "created"), (6, "updated")]
    assert rows(m.versions, "k", "version") == [("a", 5), ("c", 1), ("c", 2)]
    assert rows(m.snapshot.fillna("-"), "k", "c", "s") == [("a", "z", "draft"), ("b", "y", "-"), ("c", "n", "active")]
    empty = merge.upsert(stored, incoming.where("false"), ["k"], ["c", "s"], ["o"])
    assert empty.snapshot.count() == 2 and empty.versions.count() == 0


def test_ids_go_on_from_the_largest(spark):
    old = spark.createDataFrame([(7,)], "id bigint")
    new = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string").repartition(5)
    got = rows(merge.with_ids(new, old, "id", ["k"]), "id", "k")
    assert [g[0] for g in got] == list(range(8, 58)) and [g[1] for g in got] == sorted(g[1] for g in got)


def test_members_jobs_and_json(spark):
    members = spark.createDataFrame([(1, 10, 1, True), (2, 20, 1, False)], "set_id bigint, prompt_id bigint, position int, enabled boolean")
    chosen = spark.createDataFrame([(2, 5), (2, 4)], "set_id bigint, prompt_id bigint")
    assert rows(merge.replace_members(members, chosen.select("set_id"), chosen, ["prompt_id"])) == [(1, 10, 1, True), (2, 4, 1, True), (2, 5, 2, True)]
    st = spark.createDataFrame([(1, "failed", "old")], "k bigint, status string, task string")
    inc = spark.createDataFrame([(1, "new"), (2, "x")], "k bigint, task string")
    assert rows(merge.upsert_jobs(st, inc, ["k"], ["task"])) == [(1, "failed", "new"), (2, "pending", "x")]
    j = spark.createDataFrame([('{"b":"1","a":"2"}',), (None,), ("broken",)], "j string").select(merge.patch_json(F.col("j"), "p", F.lit("v")))
    assert [r[0] for r in j.collect()] == ['{"a":"2","b":"1","p":"v"}', '{"p":"v"}', '{"p":"v"}']


def test_search_folds_ascii_only(spark):
    p = spark.createDataFrame([("id1", "A Big CAT", "active"), ("id2", "Äpfel", "active"), ("b%g", None, "draft")], "identifier string, concept string, status string")
    assert [r[0] for r in library.search(p, "b_g c").collect()] == ["id1"]
    assert library.search(p, "äpfel").count() == 0 and library.search(p, "%").count() == 3


def _library(spark):
    prompts = spark.createDataFrame([(1, "p1", "red cat", "active", "{}"), (2, "p2", None, "active", "{}")], "id bigint, identifier string, concept string, status string, metadata string")
    profiles = spark.createDataFrame([(1, "b", "b"), (2, "a", "a")], "style_id bigint, style string, syntax_family string")
    templates = spark.createDataFrame([(1, 1, 1, "{k} of {concept}", "", True), (2, 1, 2, "__K2__ {k}", "", False), (3, 2, 1, "{k} {zz}", None, True)], "template_id bigint, prompt_id bigint, style_id bigint, positive string, negative string, enabled boolean")
    defs = spark.createDataFrame([(1, "k", "active"), (2, "k2", "deprecated"), (3, "e", "active")], "definition_id bigint, wildcard_key string, status string")
    values = spark.createDataFrame([(i, 1, f"v{i}", float(i)) for i in range(1, 6)] + [(9, 2, "old", 1.0)], "value_id bigint, definition_id bigint, value string, weight double")
    bindings = spark.createDataFrame([(1, 1, "k"), (1, 2, "k2"), (2, 1, "k")], "prompt_id bigint, definition_id bigint, wildcard_key string")
    return prompts, templates, profiles, bindings, defs, values


def test_choice_equals_the_standard_generator(spark):
    *_, defs, values = _library(spark)
    for seed in range(12):
        want = random.Random(seed).choices([f"v{i}" for i in range(1, 6)], weights=range(1, 6), k=1)[0]
        assert [r["value"] for r in render.choose_values(defs, values, random.Random(seed).random()).collect()] == [want]


def test_render(spark):
    lib = _library(spark)
    got = {r["id"]: r for r in render.render(*lib, seed=3).collect()}
    v = random.Random(3).choices([f"v{i}" for i in range(1, 6)], weights=range(1, 6), k=1)[0]
    assert got[1]["positive_prompt"] == f"{v} of red cat" and got[1]["style"] == "b" and got[2]["positive_prompt"] == f"{v} {{zz}}"
    disabled = render.render(*lib, seed=3, style="a", overrides={"k": "mine", "zz": "no"}).collect()
    assert [r["positive_prompt"] for r in disabled] == ["__K2__ mine"]
    assert rows(library.unbound_keys(lib[1], lib[3]), "template_id", "missing") == [(3, ["zz"])]
    assert rows(library.list_wildcards(lib[4], lib[5]), "wildcard_key", "n_values") == [("e", 0), ("k", 5), ("k2", 1)]


def test_jobs(spark):
    prompts, templates, profiles, *_ = _library(spark)
    targets = spark.createDataFrame([(1, 0), (2, 1)], "style_id bigint, ord int")
    none = spark.createDataFrame([], "prompt_id bigint, style_id bigint, status string")
    cells = jobs.missing_cells(prompts, targets, templates, profiles, none)
    assert rows(cells, "prompt_id", "style_id", "source_id") == [(1, 2, 1), (2, 2, 3)]
    failed = spark.createDataFrame([(1, 2, "failed"), (2, 2, "pending")], "prompt_id bigint, style_id bigint, status string")
    assert rows(jobs.missing_cells(prompts, targets, templates, profiles, failed), "prompt_id") == [(2,)]
    assert jobs.missing_cells(prompts, targets, templates, profiles, failed, retry_failed=True, limit=1).count() == 1
    styles = spark.createDataFrame([(2, "a", "a", "minimal", "text")], "style_id bigint, style string, syntax_family string, strategy string, description string")
    tasks = jobs.build_tasks(cells, prompts, templates, styles)

    def worker(task: str) -> str:
        if "p2" in task:
            raise RuntimeError("no answer")
        return '{"positive_template": "{k}", "negative_template": "", "notes": ""}'

    done = jobs.run_worker(tasks, worker).withColumn("wrong", jobs.response_error(F.col("response"), F.array(F.lit("k"))))
    assert rows(done, "prompt_id", "wrong", "error")[0] == (1, None, None)
    assert rows(done.where("prompt_id = 2"), "error") == [("no answer",)]
    ev = spark.createDataFrame([(1, "running", 1, 1), (1, "failed", 2, 2), (1, "running", 3, 3), (1, "completed", 3, 4)], "job_id bigint, status string, ts int, seq int")
    assert rows(jobs.fold_states(ev)) == [(1, "completed", 2, 3)]


def test_greedy_choice_keeps_its_threshold():
    rng = random.Random(1)
    pool = [{"record_id": i, "score": -i, "tags": ["t"] if i % 2 else [], "signature": set(rng.sample(range(30), 12))} for i in range(80)]
    got = evalset.choose(pool, 20, set())
    assert len({c["record_id"] for c in got}) == len(got) <= 20
    assert all(evalset._alike(a["signature"], b["signature"]) < evalset.RELAXED for i, a in enumerate(got) for b in got[:i])
    used = {c["record_id"] for c in got}
    assert not used & {c["record_id"] for c in evalset.choose(pool, 20, set(used))}
    assert sum(evalset.quotas(103).values()) == 103 and evalset.stable_seed("a", 1) == evalset.stable_seed("a", 1)


def test_sets(spark):
    pool = [(i, d, float(100 - i), ["x"], [f"w{i}", f"q{i}"], i) for i, d in enumerate(["photography", "cgi-render"] * 30)]
    df = spark.createDataFrame(pool, "record_id bigint, domain string, score double, tags array<string>, signature array<string>, rank int")
    got = evalset.build_sets(df, 20, 5)
    core = rows(got.where("set_name = 'eval-core-20'"), "record_id")
    assert len(core) == len(set(core)) == 20 and got.where("set_name = 'eval-photography-25'").count() == 5
    assert evalset.diverse(df, 4).groupBy("domain").count().collect()[0][1] == 4


def test_similar_pairs_of_the_whole_pool_equal_brute_force(spark, monkeypatch):
    from quillspark.plans import relational_queries as Q

    rng = random.Random(14)
    seen = []
    for i in range(2600):  # every pair of neighbours is alike, those of rank 201 to 2,500 too; some signatures are empty
        base = seen[-1][:] if i % 2 else [f"w{rng.randrange(4000)}" for _ in range(rng.choice([0, 1, 5, 18, 25]))]
        seen.append(base[: max(1, len(base) * rng.choice([72, 80, 100]) // 100)] if i % 2 else sorted(set(base)))
    data = [(i, "photography", 1000.0 - i // 7, 9, ["x"], s) for i, s in enumerate(seen)]
    data += [(3000 + i, "cgi-render", 50.0, 9, ["x"], s) for i, s in enumerate(seen[:30])]
    df = spark.createDataFrame(data, "record_id bigint, domain string, score double, n_tokens int, tags array<string>, signature array<string>")
    monkeypatch.setattr(Q, "scored", lambda spark, d: df)
    pool = [r for r in data if r[0] < 2500 or r[0] >= 3000]
    sets = {r[0]: set(r[5]) for r in pool}
    want = []
    for x, a in enumerate(pool):
        for b in pool[x + 1 :]:
            if a[1] == b[1] and (s := evalset._alike(sets[a[0]], sets[b[0]])) >= evalset.STRICT:
                want.append((a[1], a[0], b[0], round(s, 6)))
    assert rows(Q.R.queries["j14_similar_pairs"](spark, "")) == sorted(want) and sum(w[1] > 200 for w in want) > 500


def test_rewriting_literals(spark):
    w = mining.Rewriter([("storm light", "other"), ("storm light", "lighting"), ("rim light", "lighting"), ("soft rim light", "lighting"), ("cat", "animal"), ("bad hands", "style_negative")])
    # neighbouring hits of one key become one; of two keys with the same value the later holds; single words stay
    assert w("a Soft Rim Light rim light, x storm lights") == ("a {lighting}, x storm lights", ["lighting"])
    assert w("rim light  storm light") == ("{lighting}  {other}", ["lighting", "other"])
    assert w("cat bad hands") == ("cat bad hands", []) and w(None) == (None, [])
    assert mining.Rewriter([("bad hands", "style_negative")], negative=True)("bad hands")[0] == "{style_negative}"


def test_mining(spark):
    texts = spark.createDataFrame([("Golden hour, golden  hour and bokeh",), ("golden hour",), (None,), ("",)], "text string")
    got = {(r["category"], r["term"]): (r["n"], r["weight"]) for r in mining.vocabulary(mining.term_counts(texts)).collect()}
    assert got == {("lighting", "golden hour"): (2, 0.4)}  # the double space makes another term, found once
    assert sum(map(len, mining.CATEGORIES.values())) == 119
