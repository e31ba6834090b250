"""Operators of the kind `algorithm` against brute force, and their edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import formatdup, history, mixture, varied
from quillspark.llm.text import format_free, prompt_words

WORDS = [f"w{i}" for i in range(60)]


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# -- repeats of history


def _batches(spark, new, n):
    return spark.createDataFrame([(b, "new" if b in new else "accepted", "x") for b in range(1, n + 1)], "batch_no bigint, batch_state string, source string")


@pytest.mark.parametrize("exact", [True, False])
def test_repeats_equal_brute_force(spark, exact):
    rng = random.Random(5)
    texts = []
    for i in range(300):
        if i > 40 and rng.random() < 0.4:
            t = rng.choice(texts).split(", ")
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            rng.shuffle(t)
            t = ", ".join(t)
        else:
            t = ", ".join(rng.sample(WORDS, 20))
        texts.append(t)
    data = [(i, 1 + i // 50, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "record_id bigint, batch_no bigint, original_prompt string")
    got = dict(rows(history.check_new(df, _batches(spark, {4, 5, 6}, 6), exact=exact), "record_id", "first_id"))
    want = {}
    for i, b, t in data:
        if b >= 4:
            a = set(t.split(", "))
            hit = [j for j, c, u in data if c < b and len(a & set(u.split(", "))) >= 0.6 * len(a | set(u.split(", ")))]
            if hit:
                want[i] = min(hit)
    assert len(want) > 30
    if exact:
        assert got == want
    else:  # pairs at the very edge of the radius may share no key
        assert set(got) <= set(want) and all(got[k] >= want[k] for k in got) and sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)


def test_a_batch_reads_the_table_and_not_the_texts_of_history(spark, tmp_path):
    rng = random.Random(15)
    texts = [" ".join(rng.sample(WORDS, 18)) for _ in range(60)]
    batch = lambda ids, b, t: history.parsed(spark.createDataFrame([(i, b, x) for i, x in zip(ids, t)], "record_id bigint, batch_no bigint, original_prompt string"), "record_id", "original_prompt", "batch_no")
    near = lambda t: " ".join([*t.split()[2:], "new1", "new2"])
    first = batch(range(40), 1, texts[:40])
    index = history.HistoryIndex.create(first, str(tmp_path / "index"))
    del first  # from here on only the table is there
    second = batch(range(100, 130), 2, texts[40:60] + [near(t) for t in texts[:10]])
    assert rows(index.check(second), "first_id", "record_id") == [(i, 120 + i) for i in range(10)]
    again = rows(index.check(second), "first_id", "record_id")  # checked twice, stored once
    assert again == [(i, 120 + i) for i in range(10)] and index._table("classes").count() == 70 == index._table("pivots").count()
    reopened = history.HistoryIndex(spark, str(tmp_path / "index"))
    third = batch(range(200, 240), 3, [near(t) for t in texts[40:60]] + [near(t) for t in texts[:10]] + texts[:10])
    got = rows(reopened.check(third), "first_id", "record_id", "exact")
    assert got == sorted([(100 + i, 200 + i, False) for i in range(20)] + [(i, 220 + i, False) for i in range(10)] + [(i, 230 + i, True) for i in range(10)])
    assert reopened.check(batch([], 4, [])).count() == 0


def test_ids_must_rise_with_the_batch(spark):
    data = [(5, 1, "a b c d"), (2, 2, "a b c d"), (9, 3, "a b c d")]
    df = spark.createDataFrame(data, "record_id bigint, batch_no bigint, original_prompt string")
    with pytest.raises(Exception, match="ids do not rise"):
        history.check_new(df, _batches(spark, {2, 3}, 3)).collect()


@pytest.mark.parametrize("hot", [16, 1_000_000])
def test_a_large_family_of_near_copies(spark, hot):
    base = [f"name{i}" for i in range(24)]
    data = []
    for i in range(1200):  # one text with a word of its own, and a few others now and then
        w = base[:23] + [f"own{i}"] if i % 10 else [f"z{i}x{k}" for k in range(20)]
        data.append((i, 1 + i // 200, " ".join(w)))
    data += [(5000, 6, data[0][2] + " more"), (5001, 6, data[600][2] + " more")]
    df = spark.createDataFrame(data, "record_id bigint, batch_no bigint, original_prompt string")
    got = dict(rows(history.check_new(df, _batches(spark, {4, 5, 6}, 6), hot=hot), "record_id", "first_id"))
    want = {i: 1 for i, b, t in data if b >= 4 and i < 5000 and i % 10} | {5000: 0, 5001: 600}
    assert got == want


def test_words_of_a_prompt_are_free_of_format(spark):
    forms = [
        "Gentle cat on a wall, red light, (old stone:1.2) --ar 2:3 --stylize 300\nNegative prompt: blurry, text", "gentle_cat_on_a_wall, red_light, old_stone <lora:x:1>",
        '{"subject": "gentle cat on a wall", "medium": "red light", "mood": "old stone"}', "Medium: red light\r\nsubject:gentle cat on a wall\nMood : old stone", "A gentle cat on a wall, old stone. The picture has red light.",
    ]
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    assert {tuple(r[0]) for r in df.select(prompt_words(F.col("t"))).collect()} == {("cat", "gentle", "light", "old", "on", "red", "stone", "wall")}


def test_repeats_edge_cases(spark):
    schema = "record_id bigint, batch_no bigint, original_prompt string, key string, class_id int, words string, first_id int"
    data = [(1, 1, "a1 b1 c1 d1", "x", 1, "", 1), (2, 2, "D1, c1, b1, a1", None, 2, None, 2), (2, 2, "D1, c1, b1, a1", None, 2, None, 2), (3, 2, None, "x", 3, "", 3), (4, 2, "  ", "x", 4, "", 4), (5, None, "a1 b1 c1 d1", "x", 5, "", 5), (6, 2, "--ar 2:3", "x", 6, "", 6), (7, 3, "z " * 50_000 + "y", "x", 7, "", 7), (8, 1, "a1 b1 c1 d1", "x", 8, "", 8)]
    df = spark.createDataFrame(data, schema)
    b = _batches(spark, {2, 3}, 3)
    assert rows(history.check_new(df, b), "first_id", "record_id") == [(1, 2)]
    assert history.check_new(df.where("false"), b).count() == 0 and history.check_new(df, b.where("false")).count() == 0


def test_far_pivots_bound_the_distance():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (set(rng.integers(0, 400, 25).tolist()) for _ in range(2))
        bits = lambda s: sum(1 << k for k in {x % history.PIVOTS for x in s})
        assert bin(bits(a) ^ bits(b)).count("1") <= len(a ^ b)


# -- copies that differ in format


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_copy_groups_equal_brute_force(spark, limit):
    rng = random.Random(3)
    base = [" ".join(rng.sample(["aa", "ab", "abc", "b", "ba", "aab"], 3)) for _ in range(40)]
    data = [(i, rng.choice(base)) for i in range(400)]
    shape = [str.upper, str.title, lambda t: t.replace(" ", "_"), lambda t: f"  {t}!", lambda t: t.replace(" ", " -- ")]
    df = spark.createDataFrame([(i, rng.choice(shape)(t), rng.choice(shape)("x " + t)) for i, t in data], "record_id bigint, f string, g string")
    groups = {}
    for i, t in data:
        groups.setdefault(t, []).append(i)
    want = sorted((min(g), i, len(g)) for g in groups.values() if len(g) > 1 for i in g)
    assert rows(formatdup.collapse(df, "record_id", ["f", "g"], bucket_limit=limit)) == want


def test_splits_follow_different_strings_and_what_they_share(spark, monkeypatch):
    levels, plain = [], formatdup.materialise
    monkeypatch.setattr(formatdup, "materialise", lambda df, name: (levels.append(name), plain(df, name))[1])
    # one record with more copies than a bucket holds splits nothing, however long it is
    hot = spark.range(30_000).select(F.col("id").alias("record_id"), F.lit("long words " * 40).alias("f"))
    assert formatdup.collapse(hot, "record_id", ["f"], bucket_limit=100).agg(F.max("copies"), F.count("*")).first() == (30_000, 30_000)
    assert levels.count("formatdup-large") == 1
    # strings that share 3,000 bytes are split right after these
    levels.clear()
    alike = spark.range(600).select(F.col("id").alias("record_id"), F.concat(F.lit("a" * 3_000), (F.col("id") % 300).cast("string")).alias("f"))
    got = formatdup.collapse(alike, "record_id", ["f"], bucket_limit=20)
    assert got.where("copies = 2 and first_id < 300").count() == 600 and levels.count("formatdup-large") <= 4


def test_buckets_hold_no_more_than_the_limit(spark):
    rng = random.Random(6)
    keys = {bytes(rng.choices(b"ab", k=rng.randint(1, 14))) for _ in range(600)}
    df = spark.createDataFrame([(k, k) for k in keys for _ in range(2)], "digest binary, key binary")
    sizes = formatdup.bucketed(df, 7).groupBy("bucket").agg(F.countDistinct("digest").alias("n"), F.max(F.length("key")).alias("longest"), F.max(F.length("bucket")).alias("b"))
    assert sizes.where("n > 7").count() == 0 and formatdup.bucketed(df, 7).count() == 2 * len(keys)


def test_format_free_forms(spark):
    same = ["Subject: A b\nMood: c", "mood : C;\r\nsubject: a  b;", '{"mood": "c", "subject": "a b"}', '{"subject": "A, b", "mood": "c!"}']
    other = ["Subject: a b Mood: d", "c a b", "{broken", "", "ÄÖ ß", "äö SS"]
    df = spark.createDataFrame([(t,) for t in same + other], "t string")
    got = [r[0] for r in df.select(format_free(F.col("t"))).collect()]
    assert len(set(got[:4])) == 1 and got[4] != got[0] and got[5] == "c a b" and got[6] == "broken" and got[7] == "" and got[8] == got[9]


def test_copies_edge_cases(spark):
    schema = "record_id bigint, f string, g string, id int, key string, digest string, bucket string"
    data = [(1, "a", "b", 0, "", "", ""), (2, "A!", "b", 0, "", "", ""), (3, None, "b", 0, "", "", ""), (4, " ", "b", 0, "", "", ""), (None, "a", "b", 0, "", "", ""), (5, "x" * 300_000, "b", 0, "", "", ""), (6, "x" * 300_000 + ".", "b", 0, "", "", ""), (7, "--", "--", 0, "", "", "")]
    df = spark.createDataFrame(data, schema)
    assert rows(formatdup.collapse(df, "record_id", ["f", "g"])) == [(1, 1, 2), (1, 2, 2), (5, 5, 2), (5, 6, 2)]
    assert formatdup.collapse(df.where("false"), "record_id", ["f", "g"]).count() == 0


def test_trie_counts_like_a_dictionary():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(8))) for _ in range(500)]
    trie, want = formatdup.Trie(), {}
    for i, k in enumerate(keys):
        trie.add(k, 1, i, k)
        want.setdefault(k, []).append(i)
    assert {bytes(d): (n, f) for n, f, d in trie.terminals} == {k: (len(v), v[0]) for k, v in want.items()}


# -- varied subsets


def test_local_search_ends_where_no_swap_gains():
    rng = np.random.default_rng(2)
    for n, k in ((12, 4), (40, 7), (5, 5), (3, 9), (6, 0)):
        v = rng.normal(size=(n, 8)).astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        at, before, after = varied.local_search(v, np.arange(n), k)
        assert len(at) == min(n, k) == len(set(at.tolist())) and after >= before - 1e-6
        d = varied._distances(v, v)
        total = lambda s: sum(float(d[i, j]) for i, j in itertools.combinations(s, 2))
        own = total(at)
        assert abs(own - after) < 1e-2
        for o in at:
            for i in set(range(n)) - set(at.tolist()):
                assert total([x for x in at if x != o] + [i]) <= own + 1e-3
    best = max(total(s) for s in itertools.combinations(range(6), 2)) if n >= 6 else 0
    assert best >= 0


def test_local_search_ends_only_when_no_pair_gains():
    for seed in range(6):  # near copies: the best swap is often of two rows close to each other, on no shortlist
        rng = np.random.default_rng(seed)
        base = rng.normal(size=(300, 16)).astype(np.float32)
        v = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape).astype(np.float32)])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        at, _, after = varied.local_search(v, np.arange(len(v)), 150)
        d = varied._distances(v.astype(np.float64), v.astype(np.float64))
        np.fill_diagonal(d, 0)
        total, rest = d[:, at].sum(1), np.setdiff1d(np.arange(len(v)), at)
        assert (total[rest][None, :] - total[at][:, None] - d[np.ix_(at, rest)]).max() <= 1.1e-6 * after


def test_sets_are_filled_and_groups_do_not_dominate(spark):
    rng = random.Random(4)
    data = [(i, f"same motif here {rng.choice(WORDS)} {rng.choice(WORDS)}", "m") for i in range(900)] + [(900 + i, " ".join(rng.sample(WORDS, 8)), f"c{i}") for i in range(300)]
    data += [(2000, None, "c"), (2001, " ", "c"), (None, "x y", "c"), (5, data[5][1], "m")]
    df = spark.createDataFrame([(*d, 0, "z") for d in data], "record_id bigint, positive_template string, concept string, part int, v string")
    sets = spark.createDataFrame([(1, "small", "active", '{"target": 20}'), (2, "share", "active", '{"target_share": 0.1}'), (3, "old", "archived", '{"target": 5}'), (4, "none", "active", "{}"), (5, "bad", "active", None)], "id bigint, name string, status string, metadata string")
    got = rows(varied.fill_sets(df, sets, partition=200), "set_id", "record_id")
    by = {s: [r for t, r in got if t == s] for s in (1, 2)}
    assert len(by[1]) == len(set(by[1])) == 20 and len(by[2]) == len(set(by[2])) == 120 and {t for t, _ in got} == {1, 2}
    assert sum(r < 900 for r in by[1]) <= 10 and sum(r < 900 for r in by[2]) < 85  # they are three quarters of all
    assert varied.fill_sets(df.where("false"), sets, partition=200).count() == 0


@pytest.mark.parametrize("per_cell", [5, 40])
def test_cells_come_near_one_global_search(spark, per_cell):
    rng = random.Random(9)
    data = [(i, f"one motif {rng.choice(WORDS)} {rng.choice(WORDS)}", None) for i in range(600)] + [(600 + i, " ".join(rng.sample(WORDS, 9)), "c") for i in range(600)]
    df = spark.createDataFrame(data, "record_id bigint, positive_template string, concept string")
    c = varied.represented(df, "record_id", ["positive_template", "concept"]).orderBy("record_id").toPandas()
    v, ids = np.array(c["v"].tolist(), np.float32), c["record_id"].to_numpy()
    whole = varied.local_search(v, ids, 40)[2]
    got = varied.select_all(spark.createDataFrame(c), {"a": 40, "b": 3, "all": 9_999, "none": 0}, partition=150, per_cell=per_cell).toPandas()
    of = {n: g["record_id"].tolist() for n, g in got.groupby("name")}
    assert {n: len(set(x)) for n, x in of.items()} == {"a": 40, "b": 3, "all": len(c)}
    own = v[np.isin(ids, of["a"])]
    reached = float(np.triu(varied._distances(own, own), 1).sum())
    assert reached > 0.9 * whole, (reached, whole)


# -- mixing


def _by_heap(w, caps, seats):
    out = [0] * len(w)
    for _ in range(seats):
        open_ = [(w[k] / (2 * out[k] + 1), -k) for k in range(len(w)) if out[k] < caps[k] and w[k] > 0]
        if not open_:
            break
        out[-max(open_)[1]] += 1
    return out


def test_apportionment_equals_dealing_one_by_one():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 7)
        w = [rng.choice([0.0, 0.1, 0.25, 0.25, rng.random()]) for _ in range(n)]
        caps = [rng.randrange(0, 40) for _ in range(n)]
        seats = rng.randrange(0, 90)
        assert mixture.sainte_lague(np.array(w), np.array(caps), seats).tolist() == _by_heap(w, caps, seats)


def test_mix_reaches_its_shares(spark):
    docs = [(i, f"word{i % 7} " * (20 + i % 13), s) for i, s in enumerate((["Big"] * 1500 + ["big "] * 500 + ["mid"] * 300 + ["tiny"] * 10 + [None] * 5))]
    docs += [(9001, None, "mid"), (9002, "", "mid"), (None, "x", "mid")]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id bigint, text string, source string, tokens int, shard string")
    t = spark.createDataFrame([("m", "big", 0.5, 2, 0.5), ("m", "MID", 0.3, 4, 0.5), ("m", "tiny", 0.2, 3, 0.5), ("m", "ghost", 0.4, 9, 0.5), ("e", "ghost", 1.0, 1, 1.0), (None, "big", 1.0, 1, 1.0), ("z", "big", None, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    chosen, shares = mixture.apportion(df, t)
    c = rows(chosen, "mix_name", "source", "doc_id", "repeats")
    assert len({x[:3] for x in c}) == len(c) and {x[0] for x in c} == {"m"}
    assert all(r <= {"big": 2, "mid": 4, "tiny": 3}[s] for _, s, _, r in c)
    assert all(r == 3 for _, s, _, r in c if s == "tiny")
    s = {r["source"]: r for r in shares.where("mix_name = 'm'").collect()}
    rest = [s["big"]["share"], s["mid"]["share"]]
    assert abs(rest[0] / rest[1] - 5 / 3) < 0.06 and s["ghost"]["tokens"] == 0
    total = sum(r["tokens"] for r in s.values())
    assert abs(total / s["big"]["mix_tokens_wanted"] - 1) < 0.05
    again = rows(mixture.apportion(df, t)[0], "mix_name", "source", "doc_id", "repeats")
    assert again == c
    none, empty = mixture.apportion(df.where("false"), t)
    assert none.count() == 0 and empty.count() == 6 and mixture.apportion(df, t.where("false"))[1].count() == 0


def test_runs_of_shards_change_no_share(spark, monkeypatch):
    docs = [(i, f"word{i % 7} " * (20 + i % 13), s) for i, s in enumerate(["big"] * 2000 + ["mid"] * 300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "big", 0.7, 1, 0.4), ("m", "mid", 0.3, 4, 0.4)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    monkeypatch.setattr(mixture, "SHARD", 3_000)
    for runs in (65_536, 3):
        monkeypatch.setattr(mixture, "SHARDS", runs)
        chosen, shares = mixture.apportion(df, t)
        s = {r["source"]: r for r in shares.collect()}
        shards = {"big": 40, "mid": 7}
        for k in ("big", "mid"):
            # half a document a shard at most
            assert s[k]["deviation"] == s[k]["tokens"] - 256 * s[k]["quota_blocks"] and abs(s[k]["deviation"]) < 60 * shards[k]
            assert abs(s[k]["share"] - s[k]["wanted_share"]) < 0.02
        assert chosen.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0


def test_mix_size_counts_documents_without_a_source(spark):
    docs = [(i, "word " * 300, s) for i, s in enumerate(["big"] * 60 + [None] * 30 + [" "] * 10)] + [(None, "word " * 300, "big"), (200, None, None), (201, "", "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "big", 1.0, 3, 0.5)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    chosen, shares = mixture.apportion(df, t)
    tokens = mixture.count("word " * 300)
    wanted = round(0.5 * 101 * tokens / mixture.BLOCK) * mixture.BLOCK
    s = shares.first()
    assert s["mix_tokens_wanted"] == wanted and abs(s["tokens"] - wanted) <= tokens
    assert {r[0] for r in chosen.select("doc_id").collect()} <= set(range(60))
