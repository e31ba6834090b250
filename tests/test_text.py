from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr).first()[0]


def many(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_cleaning_chain(spark):
    got = many(spark, T.clean_positive, [
        "a cat --quality 2, b", "a --ar 16:9, b", "@bob standing in a field, sky", "(glow:1.2) and [dim:0.8], [a|b]", "((deep)) {{ mist }}x ::2",
        "a, , , , b", "score_9, BREAK x -", "cat <lora:niji3d:1>", "cat <lora:zz:0.5>, dog", "café  noir , x.", None, "", "ye-pop\nlake",
    ])
    assert got[0] == "a cat uality 2, b"  # the shortest name wins, as it stands first
    assert got[1] == "a b"
    assert got[2] == " sky"  # spaces go before commas do
    assert got[3] == "glow and dim, a"
    assert got[4].startswith("deep mist") and "::" not in got[4]
    assert got[5] == "a, , b"
    assert got[7] == "cat, anime 3D render style, cel-shaded anime aesthetic" and got[8] == "cat, dog"
    assert got[9] == "café noir, x" and got[10] is None and got[11] == "" and got[12] == "lake"


def test_very_long_texts_do_not_overflow(spark):
    long = "@a " + "b " * 60_000 + ", end"
    assert many(spark, T.clean_positive, [long]) == many(spark, T.clean_positive, ["@a b , end"])
    assert many(spark, lambda c: F.size(S.tokens(c)), ["word " * 50_000]) == [50_000]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abc xyz", min_size=1, max_size=40))
def test_cleaning_plain_text_is_idempotent(t):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    once = many(spark, T.clean_positive, [t])[0]
    assert many(spark, T.clean_positive, [once])[0] == once == " ".join(t.split())


def test_negative_split(spark):
    df = spark.createDataFrame([("a\nNegative prompt: x\nb\nnegative prompts : y ",), ("plain",), (None,)], "t string")
    p, n = T.split_negative(F.col("t"))
    assert [tuple(r) for r in df.select(p, n).collect()] == [("a\nb", "y"), ("plain", None), (None, None)]


def test_reject_reasons(spark):
    got = many(spark, T.reject_reason, ["short", "averylongwordwithoutspaces", "12345 67890 12345 678", "a fine old picture", None])
    assert got == ["too short after cleaning (5 chars)", "too few words after cleaning (1 words)", "no alphabetic content after cleaning", None, "too short after cleaning (0 chars)"]


def test_names(spark):
    assert many(spark, T.concept, ["A 2nd big-cat! on the old red stone wall, far away"]) == ["A nd big cat on the old red"]
    assert many(spark, T.slugify, ["  Café -- Notes.txt ", "***"]) == ["caf_notes_txt", "source"]
    assert many(spark, T.normalise_key, [" Big-Cat key "]) == ["big_cat_key"]
    df = spark.createDataFrame([("Big Cat!", 7), ("!!", 1234), ("", 2)], "t string, i int")
    assert [r[0] for r in df.select(T.identifier(F.col("t"), F.col("i"))).collect()] == ["big_cat_007", "prompt_1234", "prompt_002"]


def test_placeholders(spark):
    assert many(spark, T.placeholder_keys, ["{b} __a__ {b} {café} {no good}", None]) == [["a", "b", "café"], []]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("A", "x {b}"), ("b", "y"))])
    assert many(spark, lambda c: T.substitute(c, entries), ["{A} {a} __A__ {b} {c}"]) == ["x y x y x y y {c}"]


def test_forms(spark):
    assert many(spark, T.detect_style, ['{"a": 1}', "(a:1.2) --ar 1:1", "a --ar 1:1", "One long sentence stands here. Another long sentence too.", "a, b, c"]) == ["lisp-like", "enhanced-prompt", "comma-separated", "everyday-speech", "comma-separated"]
    assert many(spark, T.is_json_object, ['{"a": 1}', "[1]", "{broken", None]) == [True, False, False, False]
    assert many(spark, T.normalise_line, ["  ﬁne — a &amp; b "]) == ["fine - a & b"]
    assert many(spark, T.unquote_pair, ["'a'", '"', "\"b'"]) == ["a", '"', "\"b'"]
    assert many(spark, T.looks_like_prompt, ["A wide landscape painting, with low light over hills", "Copyright page, all rights reserved, portrait photo", "A short one", None]) == [True, False, False, None]


def test_variants(spark):
    none = F.create_map().cast("map<string,string>")
    v = lambda t: one(spark, T.style_variants(F.col("t"), F.col("t"), T.is_json_object(F.col("t")), none), t=t)
    assert [x["style"] for x in v("a (b:1.2)")] == ["comma-separated", "enhanced-prompt", "structured-fields"]
    assert [x["style"] for x in v('{"a": 1}')] == ["lisp-like"]
    m = F.create_map(F.lit("Subject"), F.lit("cat"), F.lit("Camera"), F.lit("low"), F.lit("Lighting"), F.lit("dim"))
    assert one(spark, T.fields_speech(m)) == "cat. low. with dim" and one(spark, T.fields_enhanced(m)) == "(cat:1.1), low, dim" and one(spark, T.fields_comma(m)) == "cat, low, dim"


def test_scores(spark):
    assert many(spark, S.domain, ["pink scarf", "plain", "photo of anime"]) == ["illustration-painting", "mixed-hard-general", "photography"]
    df = spark.createDataFrame([(n,) for n in (5, 8, 30, 78, 121)], "n int")
    assert [r[0] for r in df.select(S.length_score(F.col("n"))).collect()] == [-8.0, 4.0, 8.0, 7.0, -8.0]
    a, b, e = (F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>") for v in (["a", "b"], ["b", "c"], []))
    assert one(spark, S.jaccard(a, b)) == one(spark, S.jaccard(b, a)) == 1 / 3 and one(spark, S.jaccard(a, e)) == 0.0
