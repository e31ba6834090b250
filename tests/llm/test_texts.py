"""Operators of the kind `text`: held-out accuracy, round trips, brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import abuse, leak, scan, split, subjects
from quillspark.llm.spelling import phrases, plain
from quillspark.llm.tokens import count, encoder, parts


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# -- scanned pages


def _lexicon():
    words = "the picture shows old paper edges and warm light readers afterwards describe sound weather lighting three quarter view hammer turn compare version before behind touch sampler".split()
    counts = dict.fromkeys(words, 300) | {"three-quarter": 200, "turning": 100, "tuming": 1}
    return scan.Lexicon(counts)


def test_misread_words():
    x = _lexicon()
    got = {w: x.misread(w) for w in ("aftcrwards", "harnmer", "beliind", "liglit", "toucli", "soiind", "tuming", "light", "zzz", "vvarm", "colour")}
    assert got == {"aftcrwards": "afterwards", "harnmer": "hammer", "beliind": "behind", "liglit": "light", "toucli": "touch", "soiind": "sound", "tuming": "turning", "light": None, "zzz": None, "vvarm": "warm", "colour": None}


def _read(text, lexicon=None):
    defects, lines = scan.decode(text, "", lexicon or _lexicon())
    return defects, "\n".join(t for t, _ in lines)


def test_one_search_over_splits_merges_confusions_and_hyphens():
    hyphen, char = (lambda w: ("hyphen_break", w)), (lambda w: ("char_error", w))
    assert _read("the warmlight shows") == ([], "the warm light shows")
    assert _read("the rea ders turn") == ([], "the readers turn")
    # two errors in one place
    assert _read("the warrnlight shows") == ([char("warm")], "the warm light shows")
    assert _read("the after wards, behind") == ([], "the afterwards, behind")
    assert _read("the aftcr wards turn") == ([char("afterwards")], "the afterwards turn")
    assert _read("the aft-\ncrwards turn") == ([hyphen("afterwards")], "the afterwards\nturn")
    assert _read("the des-\ncri be sound") == ([hyphen("describe")], "the describe\nsound")
    # a compound keeps its own hyphen; a broken unknown word is put together, two words of their own are not
    assert _read("a three-\nquarter view") == ([], "a three-quarter\nview")
    assert _read("of Zamqua-\nlore here")[0] == [hyphen("zamqualore")] and _read("paper-\nlight old")[0] == []
    # what stands between parts keeps them apart, and what is no word stays
    assert _read("(rea) ders, 9:16 --ar f/8 b0x-3") == ([], "(rea) ders, 9:16 --ar f/8 b0x-3")
    assert _read("LIGHT Liglit LIGLIT, old") == ([char("light")], "LIGHT Light LIGHT, old")
    assert _read("") == ([], "") and _read("-\n-") == ([], "-\n-") and _read("x" * 5_000)[0] == []


def test_a_long_run_of_unknown_text_takes_time_in_proportion():
    import time

    def took(n):
        began = time.time()
        _read(" ".join(f"zq{'abcdefgh'[k % 8]}wv" for k in range(n)))
        return time.time() - began

    took(200)
    assert took(8_000) < 14 * max(took(1_000), 0.05)


def test_frequent_misread_forms_do_not_pass():
    for times in (1, 100, 10_000):  # the same text over and over
        x = scan.Lexicon({"prompt": 30 * 24 * times, "first": 400 * times, "prompf": 24 * times, "light": 300 * times, "old": 900 * times})
        defects, lines = scan.decode("The prompf, (prompf old light first prompf", "", x)
        assert defects == [("char_error", "prompt")] and lines == [("The prompt, (prompt old light first prompt", False)]


def test_page_is_decoded():
    page = "CHAPTER 2 MOOD OF KOLTAS | 14\r\nReaders aftcrwards desc-\r\n[15]\r\nribe the three-\r\nquarter view. ISO 100\n9:9\n\nxiv\nA BOOK OF LlGHT".replace("LlGHT", "LIGHT")
    defects, lines = scan.decode(page, scan.title_of("inbox/A Book of Light.txt"), _lexicon())
    assert sorted(defects) == [("char_error", "afterwards"), ("hyphen_break", "describe"), ("page_number", "[15]"), ("page_number", "xiv"), ("running_header", "A BOOK OF LIGHT"), ("running_header", "CHAPTER 2 MOOD OF KOLTAS | 14")]
    assert " ".join(t for t, _ in lines) == "Readers afterwards describe the three-quarter view. ISO 100 9:9"


def test_furniture():
    assert all(map(scan.is_page_number, ["12", "[3]", "— 20 —", "Page 7", "- 7 -", "4 / 210", "~ 6 ~", "p. 12", "xxiv"]))
    assert not any(map(scan.is_page_number, ["ISO 100", "9 x 12 cm", "f/8", "Step 4", "No. 3", "9:16", "1/60 s", "12.", "mix", "4/5"]))
    t = scan.title_of("The Tin Notes on Light.txt")
    assert scan.is_header("17 THE TIN NOTES ON LIGHT", t) and scan.is_header("The Tin N0tes on Light ....... 4", t) and not scan.is_header("the tin notes on light are old and nobody reads them", t)


def test_clean_text_passes_and_paragraphs_join():
    lines = [("The picture shows old", False), ("paper edges and light.", False), ("Readers describe sound", True), ("afterwards.", False)]
    assert scan.paragraphs(lines) == ["The picture shows old paper edges and light.", "Readers describe sound afterwards."]
    assert scan.decode("the picture shows old paper edges", "", _lexicon())[0] == [] and scan.paragraphs([]) == []


def test_pages(spark):
    good = "the readers describe warm light and old paper " * 30
    data = [(1, "Old Book.txt", "warm lighf shows\nOLD BOOK\nthe read-\ners", "warm lighf shows OLD BOOK the read- ers"), (2, None, None, "warm lighf"), (3, "x", "", None), (4, "x", None, None), (None, "x", "a", "a"), (5, "y", good, good), (6, "y", good * 200, None)]
    df = spark.createDataFrame([(*d, "q", 0) for d in data], "page_id bigint, source_file string, original_prompt string, positive_template string, field string, i int")
    got = rows(scan.defects(df))
    both = [("char_error", "light"), ("hyphen_break", "readers"), ("running_header", "OLD BOOK")]
    assert got == sorted([(1, f, *x) for f in ("original_prompt", "positive_template") for x in both] + [(2, "positive_template", "char_error", "light")])
    assert scan.repair(df).where("page_id = 1 and field = 'original_prompt'").first()["paragraphs"] == ["warm light shows the readers"]
    assert scan.defects(df.where("false")).count() == 0


def test_results_do_not_depend_on_which_words_are_broadcast(spark):
    # rare words, and pages that need them: three parts, run together, a compound, a sign, across furniture, in small letters
    rare = "kestrelwing marigold lanterns three-quarter thistledown orchard pumpernickel saddlebag cobblestone istanbul".split()
    filler = "the readers describe warm light and old paper " * 30
    noisy = [
        "the kes trel wing and old", "the marigoldlanterns shows", "the oldmari gold and", "a three-\nquarter light", "warm orchard! and", "the thistle-\n12\nOLD BOOK\ndown and",
        "the pumper- 3 | OLD BOOK nickel and", "light sad dlc bag and", "the cobble|-\nstone, warm", "old \u0130stanbul and \u0130stan bul",
    ]
    data = [(n, "Old Book.txt", filler, None) for n in range(5)] + [(10 + n, None, f"the {w} and {w} and {w} and", None) for n, w in enumerate(rare)]
    data += [(100 + n, "Old Book.txt", t, None) for n, t in enumerate(noisy)] + [(200 + n, "Old Book.txt", " ", t.replace("\n", " ")) for n, t in enumerate(noisy)]
    df = spark.createDataFrame(data, "page_id bigint, source_file string, original_prompt string, positive_template string")
    texts = [rows(scan.repair(df, most_words=most)) for most in (10, 1 << 40)]
    assert texts[0] == texts[1]
    read = {(i, f): " ".join(t) for i, f, t, _ in texts[0]}
    assert read[100, "original_prompt"] == "the kestrelwing and old" and read[101, "original_prompt"] == "the marigold lanterns shows" and read[103, "original_prompt"] == "a three-quarter light"
    assert read[105, "original_prompt"] == "the thistledown and" and read[207, "positive_template"] == "light saddlebag and"
    got = [rows(scan.defects(df, most_words=most)) for most in (10, 1 << 40)]
    assert got[0] == got[1] and (105, "original_prompt", "hyphen_break", "thistledown") in got[0]


def test_what_is_asked_for_is_all_that_is_looked_up():
    for seed in range(400):
        rng = random.Random(seed)
        words = ["".join(rng.choice("abcdehilmnorutfw") for _ in range(rng.randint(2, 9))) for _ in range(40)]
        words += [a + b for a, b in zip(words[:10], words[10:20])] + [f"{words[0]}-{words[1]}", "three-quarter", "l0ng", words[2] + "|", words[5] + words[6] + words[7], *map(scan.skeleton, words[:6])]
        words = [w for w in dict.fromkeys(words) if len(w) > 1]
        counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}
        bound = rng.choice([3, 30, 400, 10_000])
        common = scan.Lexicon({w: n for w, n in counts.items() if n >= bound}, sum(counts.values()))

        def noise(w):
            k, way = rng.randint(1, len(w) - 1), rng.randrange(14)
            ways = [w[:k] + " " + w[k:], w[:k] + rng.choice("-\xad") + "\n" + w[k:], w[:k] + "|-\n" + w[k:], w[:k] + "-\n12\nOLD BOOK 4\n" + w[k:], w + rng.choice(words), w + rng.choice(["!", "|.", ",", "!-"]), w.replace("o", "0").replace("h", "li")]
            return ways[way] if way < len(ways) else w

        text = " ".join(noise(rng.choice(words)) for _ in range(rng.randint(1, 60)))
        keys = set(map(scan.skeleton, scan.forms(text, "old book", common)))
        extra = {w: n for w, n in counts.items() if n < bound and scan.skeleton(w) in keys}
        assert scan.decode(text, "old book", common.with_extra(extra)) == scan.decode(text, "old book", scan.Lexicon(counts)), seed


# -- subjects


def test_subjects_spread_from_seeds(spark):
    rng = random.Random(2)
    who = {"music": ["cellist", "drummer", "singer", "flutist"], "food": ["baker", "cook", "butcher", "waiter"]}
    does = {"music": ["tuning the strings", "playing a slow waltz", "humming a melody"], "food": ["kneading fresh dough", "icing a cake", "peeling oranges"]}
    looks = ["chalk pastel", "soft light", "rusted tin", "wide view", "calm mood"]
    data, labels = [], []
    for i in range(600):
        s = rng.choice(["music", "food"])
        two = rng.random() < 0.2
        t = f"old {rng.choice(who[s])} {rng.choice(does[s])}"
        truth = {s}
        if two:
            o = "food" if s == "music" else "music"
            t += f", beside a {rng.choice(who[o])} {rng.choice(does[o])}"
            truth.add(o)
        if i % 20 == 0:
            t, truth = "overlapping grids", set()
        data.append((i, f"{t}, {', '.join(rng.sample(looks, 3))}", truth))
        if i < 150:
            wrong = i % 29 == 1
            labels += [(i, x.upper() if i % 7 == 0 else x) for x in ({"food", "music"} - truth if wrong and len(truth) == 1 else truth or {"none"})]
    df = spark.createDataFrame([(i, t, "c", "z", 1) for i, t, _ in data] + [(900, None, "old baker", "", 1), (901, " ", "", "", 1), (None, "x", "", "", 1)], "record_id bigint, positive_template string, concept string, phrase string, term int")
    lab = spark.createDataFrame(labels + [labels[0], (None, "food"), (3, None)], "record_id bigint, subject string")
    got = set(rows(subjects.assign(df, lab, "record_id", ["positive_template"], spark.createDataFrame([("Music ",), ("food",), (None,)], "subject string"))))
    want = {(i, s) for i, _, truth in data for s in truth}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert subjects.assign(df, lab.where("false"), "record_id", ["positive_template"]).count() == 0
    assert subjects.assign(df.where("false"), lab, "record_id", ["positive_template"]).count() == 0
    share = {r["subject"]: r["records"] for r in subjects.composition(df, subjects.assign(df, lab, "record_id", ["positive_template"]), "record_id", "positive_template").collect()}
    assert set(share) == {"music", "food", "none"} and share["none"] >= 25


def test_labels_spread_until_nothing_changes_and_trusted_seeds_hold(spark):
    data = [(i, f"a0 b0 filler{i}") for i in range(8)]
    for h, n in enumerate((120, 36, 12, 3), 1):  # each step knows two words of the one before and brings two new ones
        data += [(1000 * h + k, f"a{h - 1} b{h - 1} a{h} b{h} other{h}x{k}") for k in range(n)]
    data += [(900, "a3 b3 last"), (901, "a0 b0 wrong"), (902, "nothing like it")]
    df = spark.createDataFrame(data, "record_id bigint, t string")
    labels = spark.createDataFrame([(i, "food") for i in range(8)] + [(901, "law"), (902, "law")], "record_id bigint, subject string")
    got = set(rows(subjects.assign(df, labels, "record_id", ["t"])))
    # a seed against which all others speak is released; nothing tells of the last, which is not trusted either
    assert got == {(i, "food") for i, _ in data if i != 902}
    with pytest.raises(RuntimeError):
        subjects.assign(df, labels, "record_id", ["t"], rounds=2)
    known = spark.createDataFrame([(1, ["x y", "z"]), (2, ["x y"]), (3, ["z"]), (4, ["x y"])], "record_id bigint, phrases array<string>")
    named = spark.createDataFrame([(1, "food"), (2, "law"), (4, "food"), (4, "law")], "record_id bigint, subject string")
    terms = known.where("record_id = 2").select(F.explode(subjects.terms(F.lit("x y"))).alias("term")).selectExpr("term", "'food' as subject", "0.9d as weight")
    assert rows(subjects.trusted_seeds(known, named, terms)) == [(1,), (3,)]


def test_a_phrase_needs_two_terms(spark):
    labels = spark.createDataFrame([(i, "food") for i in range(8)] + [(i, "none") for i in range(8, 16)], "record_id bigint, subject string")
    df = spark.createDataFrame([(i, "bread") for i in range(8)] + [(i, "stone") for i in range(8, 17)], "record_id bigint, t string")
    assert subjects.assign(df, labels, "record_id", ["t"]).count() == 0


def test_phrases_of_long_and_odd_texts(spark):
    df = spark.createDataFrame([("A_b, c; D|e — f",), ("w " * 40,), ("",), (None,), ("x" * 100_000,)], "t string")
    got = {r["t"]: r["phrases"] for r in subjects.with_phrases(df, df["t"]).collect()}
    assert sorted(got["A_b, c; D|e — f"]) == ["a b", "c", "d", "e", "f"] and got["w " * 40] and got[""] == [] and not got.get(None) and len(got["x" * 100_000]) == 1


# -- abusive content


def test_disguises_are_undone():
    assert plain("w o r t h l e s s p4r@5!t3 you") == "worthless parasite you"
    assert plain("looooser, pa​rasite, misеrаblе, 35mm f/8") == "loser, parasite, miserable, 35mm f/8"
    assert phrases("A_b. c: d -- e\n\n") == ["a b", "c", "d", "e"]


def _texts(rng, n):
    insults, harmless = ["you are a {} fool", "what a {} clown you are", "go away you {} worm"], ["a {} fool's gold nugget", "{} old coins in a dish", "the clown of the {} circus"]
    odd, plain_ = ["rotten", "useless", "stupid", "pathetic"], ["chalk pastel", "soft rim light", "oiled paper edges", "wide vignette", "dented tin cans", "pearly fog glow", "knotted rope ladders"]
    out = []
    for _ in range(n):
        c = rng.choice(["abusive", "none", "none", "none"])
        p = rng.sample(plain_, 4)
        if c == "abusive":
            p.insert(rng.randrange(4), rng.choice(insults).format(rng.choice(odd)))
        elif rng.random() < 0.3:
            p.insert(rng.randrange(4), rng.choice(harmless).format(rng.choice(odd)))
        out.append((c, ", ".join(p)))
    return out


def test_content_held_out_accuracy():
    rng = random.Random(8)
    train, test = _texts(rng, 600), _texts(rng, 400)
    noisy = [("none" if c == "abusive" and rng.random() < 0.04 else c, t) for c, t in train]
    m = abuse.fit(noisy)
    hit = [(c == "abusive", m.scores(t).get("abusive", (0, ""))[0] >= m.thresholds["abusive"]) for c, t in test]
    tp, fp, fn = (sum(x) for x in zip(*[(a and b, b and not a, a and not b) for a, b in hit]))
    assert 2 * tp / (2 * tp + fp + fn) > 0.95


def test_compression_decides_and_no_word_list():
    rng = random.Random(18)
    train, test = _texts(rng, 600), _texts(rng, 400)
    m = abuse.fit(train)
    # a list of the words that most labelled texts with them make abusive, against the same held-out texts
    seen: dict[str, list[int]] = {}
    for c, t in train:
        for w in set(t.replace(",", "").split()):
            seen.setdefault(w, []).append(c == "abusive")
    listed = {w for w, y in seen.items() if len(y) > 2 and sum(y) >= 0.7 * len(y)}
    f1 = lambda hits: 2 * sum(a and b for a, b in hits) / max(1, sum(a for a, _ in hits) + sum(b for _, b in hits))
    by_words = f1([(c == "abusive", bool(listed & set(t.replace(",", "").split()))) for c, t in test])
    by_size = f1([(c == "abusive", m.scores(t).get("abusive", (0, ""))[0] >= m.thresholds["abusive"]) for c, t in test])
    assert by_size >= by_words and by_size > 0.95
    # nothing but the dictionaries is kept, and long samples are kept whole
    assert m.__getstate__() == (m.samples, m.thresholds)
    long = abuse.Compressor(["you are a stupid fool", *(f"word{k} other{k * 7} filling{k * 13}" for k in range(60_000))])
    assert long.size(b"you are a stupid fool") < 14


def test_content_edge_cases(spark):
    rng = random.Random(9)
    data = [(i, *x) for i, x in enumerate(_texts(rng, 300))]
    texts = spark.createDataFrame([("t", i, "s", x, "q") for i, _, x in data] + [("t", 900, "s", None, ""), ("t", 901, None, " ", ""), ("t", 902, "s", "plain " * 40_000 + ", you are a stupid fool", "")], "table_name string, record_id bigint, source string, text string, category string")
    labels = spark.createDataFrame([("t", i, c) for i, c, _ in data] + [("t", 1, None), ("t", 5000, "abusive")], "table_name string, record_id bigint, category string")
    m = abuse.fit_on(labels, texts.drop("category"))
    flagged = {r[0] for r in rows(abuse.score(texts.drop("category"), m).where("flagged"), "record_id")}
    want = {i for i, c, _ in data if c == "abusive"}
    assert 902 in flagged and len(flagged & want) >= 0.95 * len(want) and len(flagged - want) <= 5
    r = abuse.rates(texts, abuse.score(texts, m)).collect()
    assert [x["texts"] for x in r] == [301] and r[0]["flagged"] == r[0]["abusive"]
    none = abuse.fit_on(labels.where("false"), texts)
    assert abuse.score(texts, none).where("flagged").count() == 0 and abuse.score(texts.where("false"), m).count() == 0


# -- leaks


def _words(rng, n, stem="q"):
    return [f"{stem}{rng.choice('abcdefgh')}{rng.randrange(10, 999)}x" for _ in range(n)]


def test_leaks_by_rule(spark):
    rng = random.Random(11)
    items = [(i, " ".join(_words(rng, 40)).capitalize() + ".") for i in range(6)]
    w = [t.lower().rstrip(".").split() for _, t in items]
    fill = lambda n: " ".join(_words(rng, n, "z"))
    swapped = [x if k % 7 != 3 else "other" for k, x in enumerate(w[2][5:29])]
    dense = [x if k % 4 != 3 else "other" for k, x in enumerate(w[3][:24])]
    docs = [
        (1, fill(30) + " " + " ".join(w[0][3:13]) + " " + fill(5)),  # ten in a row
        (2, fill(9) + " " + " ".join(w[0][3:12]) + " " + fill(5)),  # nine
        (3, " ".join(w[1]).upper().replace(" ", " — ")),
        (4, fill(4) + " " + " ".join(swapped) + " " + fill(4)),  # one in seven
        (5, " ".join(dense)),  # one in four
        (6, " ".join(x[:3] + "-\n" + x[3:] for x in w[4][:12])),  # words broken in two
        (7, " ".join(w[5][20:34]) + " " + fill(20) + " " + " ".join(w[5][:12]) + " " + " ".join(w[0][:11])),  # reordered, two items
        (8, "é".join(["", *w[0][:3]])), (9, None), (10, ""), (None, " ".join(w[0])),
    ]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, t string, item_id int")
    it = spark.createDataFrame([(*i, "s") for i in items] + [(90, None, "s"), (91, "short", "s"), (2, items[2][1], "s")], "item_id bigint, text string, d string")
    want = [(1, 0), (3, 1), (4, 2), (6, 4), (7, 0), (7, 5)]
    assert rows(leak.leaks(df, it)) == want
    assert rows(leak.leaks(df, it, block=400)) == want  # five blocks or more
    assert leak.leaks(df.where("false"), it).count() == 0 and leak.leaks(df, it.where("false")).count() == 0


@pytest.mark.parametrize("flip", [False, True])
def test_a_passage_of_short_right_runs_leaks(spark, flip):
    # right runs of 10, 8, 10 and 34 letters: only the last holds a seed, at one end of the passage
    runs = ["abc de fgh ij", "kl mn op qr", "stu vw xyz ab", "quarrelsomely brightening harbours"]
    item, doc = [], []
    for k, r in enumerate(runs):
        item += r.split() + ["wrong"] * (k < 3)
        doc += r.split() + ["9999"] * (k < 3)
    assert len(item) == 18
    put = lambda w, x: " ".join([x] * 20 + (w[::-1] if flip else w) + [x] * 20)
    items = spark.createDataFrame([(1, put(item, "mmm"))], "item_id bigint, text string")
    docs = [(1, put(doc, "77")), (2, put(["8888", *doc[1:]], "77"))]  # the second has a fourth error
    assert rows(leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items)) == [(1, 1)]


@pytest.mark.parametrize("block", [leak.BLOCK, 200])
def test_common_sentences_do_not_count(spark, block):
    rng = random.Random(12)
    opening = "Write one long picture prompt for the old scene that stands below here."
    items = spark.createDataFrame([(i, opening + " " + " ".join(_words(rng, 20))) for i in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, opening + " and nothing else")], "doc_id bigint, text string")
    assert leak.leaks(docs, items, block=block).count() == 0


def test_items_given_several_times_are_found_as_often(spark):
    rng = random.Random(21)
    a, b = " ".join(_words(rng, 24)) + ".", " ".join(_words(rng, 24)) + "."
    changed = [a.replace(a.split()[k], "changed", 1) for k in (2, 12, 22)]
    # the same, in other format, and two sentences of which one is changed a little in each
    data = [(1, a), (2, a), (3, a.upper()), (4, "! " + a)] + [(10 + k, f"{b} {c}") for k, c in enumerate(changed)]
    items = spark.createDataFrame(data, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x y " + a + " z"), (2, b)], "doc_id bigint, text string")
    got = rows(leak.leaks(docs, items))
    assert {i for d, i in got if d == 1} >= {1, 2, 3, 4} and {i for d, i in got if d == 2} == {10, 11, 12}


@pytest.mark.parametrize("short,long", [(1, 5), (2, 6), (3, 8)])
def test_recall_of_changed_and_reordered_passages(spark, short, long):
    rng = random.Random(short)
    vocab = ["".join(rng.choices("abcdefghijklmnoprstuvwy", k=rng.randint(short, long))) for _ in range(400)]
    items, docs, want = [], [], set()
    for i in range(100):
        w = rng.choices(vocab, k=30)
        items.append((i, " ".join(w)))
        part = w[6:24]
        for k in rng.sample(range(1, 17), 3):  # three of eighteen replaced
            part[k] = "qqzzq"
        fill = lambda n: " ".join(rng.choices(vocab, k=n))
        docs.append((i, f"{fill(40)} {' '.join(part)} {fill(40)}"))
        pieces, at = [], 0
        while at < 30:
            n = rng.choice([7, 8])
            pieces.append(w[at : at + n])
            at += n
        rng.shuffle(pieces)
        docs.append((1000 + i, f"{fill(10)} " + " ".join(x for p in pieces for x in [*p, *rng.choices(vocab, k=6)])))
        want |= {(i, i), (1000 + i, i)}
    got = set(rows(leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))))
    changed, moved = (len([x for x in want & got if (x[0] >= 1000) == m]) for m in (False, True))
    assert changed >= 97 and moved >= 90 and len(got - want) <= 2, (changed, moved, len(got - want))


def test_tiles_are_disjoint_and_greedy():
    rng = random.Random(13)
    for _ in range(30):
        a = "".join(rng.choices("abc", k=120))
        b = a[40:80] + "".join(rng.choices("abc", k=30)) + a[:30]
        seeds = [(i, j) for i in range(len(a) - leak.SEED + 1) for j in range(len(b) - leak.SEED + 1) if a[i : i + leak.SEED] == b[j : j + leak.SEED]]
        tiles = leak.tiles_of(a, b, seeds)
        assert all(a[d : d + n] == b[i : i + n] for d, i, n in tiles) and max(n for _, _, n in tiles) >= 40
        for k in (0, 1):
            marks = [p for t in tiles for p in range(t[k], t[k] + t[2])]
            assert len(marks) == len(set(marks))


def test_running_hash_equals_the_plain_one():
    import numpy as np

    s = np.frombuffer("abcabcabcabcXYabcabcabcabc".encode("utf-32-le"), np.uint32)
    h = leak._hashes(s)
    seen = {}
    for i, x in enumerate(h.tolist()):
        seen.setdefault(s[i : i + leak.SEED].tobytes(), set()).add(x)
    assert len(h) == len(s) - leak.SEED + 1 and all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)


# -- splitting


TEXTS = [
    "One sentence here. " * 80, "word " * 900, "x" * 5_000, "段落の文。" * 400, "a\n\n" * 300, "First part, with commas, and more; " * 60 + "\n\nSecond.\r\n\r\nThird " * 50, "short", "", "emoji 😀 " * 300, "under_score_words_only_" * 200, " " * 3_000, "é" * 2_000,
]


@pytest.mark.parametrize("most,overlap", [(64, 8), (128, 16), (40, 0), (16, 100), (8, 0)])
def test_pieces_make_up_the_text(spark, most, overlap):
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(TEXTS)] + [(None, "x " * 999, 7, "z"), (99, None, 7, "z")], "doc_id bigint, text string, n int, marks string")
    lim = spark.createDataFrame([("l", most, overlap), ("l", most, overlap), (None, 5, 0), ("bad", None, 0), ("least", 4, 2)], "limit_name string, max_tokens int, overlap_tokens int")
    by: dict[int, list] = {}
    got = split.pieces(df, lim).orderBy("doc_id", "piece_no").collect()
    assert {r["limit_name"] for r in got} == {"l", "least"} and max(r["tokens"] for r in got if r["limit_name"] == "least") <= 4
    for r in got:
        if r["limit_name"] == "l":
            by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, t in enumerate(TEXTS) if len(encoder().encode_ordinary(t)) > most}
    for i, ps in by.items():
        at = 0
        for k, r in enumerate(ps):
            assert r["piece_no"] == k + 1 and r["piece"] == TEXTS[i][r["start"] : r["end"]] and r["start"] + r["overlap_chars"] == at and r["end"] > at
            at = r["end"]
            assert count(r["piece"]) <= most
        assert at == len(TEXTS[i])


def test_limits_that_cannot_be_kept_raise(spark):
    lim = spark.createDataFrame([("tiny", 3, 0)], "limit_name string, max_tokens int, overlap_tokens int")
    with pytest.raises(ValueError):
        split.limits_of(lim)
    with pytest.raises(ValueError):
        split.limits_of(spark.range(split.MOST_LIMITS + 1).selectExpr("cast(id as string) as limit_name", "64 as max_tokens", "0 as overlap_tokens"))


def test_time_is_in_proportion_to_length(spark):
    import time

    lim = spark.createDataFrame([("l", 128, 16)], "limit_name string, max_tokens int, overlap_tokens int")
    unit = "A sentence of some words, with a clause and é. " * 4_000

    def took(n: int) -> float:
        df = spark.createDataFrame([(1, unit * n)], "doc_id bigint, text string")
        began = time.time()
        total = split.pieces(df, lim).selectExpr("sum(end - start - overlap_chars)").first()[0]
        assert total == len(unit) * n
        return time.time() - began

    took(1)
    small, large = took(10), took(100)
    assert large < 25 * max(small, 0.5), (small, large)


def test_boundaries_are_natural(spark):
    t = "\n\n".join(["One two three four five. Six seven eight nine ten. "] * 60)
    df = spark.createDataFrame([(1, t)], "doc_id bigint, text string")
    lim = spark.createDataFrame([("l", 64, 8)], "limit_name string, max_tokens int, overlap_tokens int")
    got = split.pieces(df, lim).collect()
    assert {r["boundary"] for r in got} == {"p"} and all(r["overlap_chars"] > 0 for r in got if r["piece_no"] > 1)
    assert split.pieces(df, lim.where("false")).count() == 0 and split.pieces(df.where("false"), lim).count() == 0


def test_parts_cut_where_words_begin():
    t = ("word " * 9_000) + "y" * 50_000
    assert "".join(parts(t)) == t and count(t) > 9_000 and count(None) == 0
