"""Scores, domains, tags and signatures of prompts, as column expressions over literal word lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word lists by which prompts are scored.
DOMAINS = ["photography", "anime-cartoon", "illustration-painting", "cgi-render", "mixed-hard-general"]
SET_NAMES = {d: f"eval-{d}-25" for d in DOMAINS[:4]}
DOMAIN_WORDS = {
    "photography": ["photo", "photograph", "photographic", "photorealistic", "realistic", "raw photo", "dslr", "35mm", "85mm", "lens", "bokeh", "film grain", "studio", "portrait photography", "street photography", "cinematic still"],
    "anime-cartoon": ["anime", "manga", "cartoon", "comic", "chibi", "cel shading", "toon", "pixiv", "danbooru", "1girl", "1boy", "kawaii", "line art"],
    "illustration-painting": ["illustration", "painting", "oil painting", "watercolor", "gouache", "ink", "sketch", "concept art", "digital art", "artstation", "fine art", "brush", "canvas", "matte painting"],
    "cgi-render": ["3d", "cgi", "render", "octane", "unreal engine", "blender", "cinema 4d", "ray tracing", "rtx", "product render", "isometric", "low poly", "unity"],
}
TAG_WORDS = {
    "portrait": ["portrait", "headshot", "face", "person", "woman", "man", "girl", "boy"],
    "character": ["character", "hero", "warrior", "mage", "person", "creature"],
    "landscape": ["landscape", "mountain", "forest", "desert", "ocean", "valley", "river"],
    "architecture": ["architecture", "building", "interior", "room", "city", "street", "house"],
    "product": ["product", "packaging", "shoe", "watch", "furniture", "vehicle", "car"],
    "lighting": ["lighting", "light", "shadow", "glow", "rim light", "golden hour", "volumetric"],
    "composition": ["composition", "close up", "wide angle", "full body", "top down", "macro"],
    "motion": ["motion", "running", "jumping", "flying", "dance", "action", "dynamic"],
}
DIFFICULTY_WORDS = {
    "anatomy": ["hand", "hands", "finger", "fingers", "body", "pose", "face", "eyes"],
    "lighting": ["lighting", "reflection", "reflections", "rim light", "volumetric", "shadow"],
    "materials": ["glass", "metal", "fabric", "water", "skin", "hair", "fur", "leather"],
    "perspective": ["perspective", "wide angle", "fisheye", "top down", "isometric"],
    "multi-subject": ["crowd", "group", "two people", "multiple", "team"],
    "text-detail": ["sign", "logo", "typography", "lettering", "poster"],
}
VISUAL_WORDS = ["portrait", "landscape", "lighting", "composition", "camera", "lens", "environment", "background", "scene", "style", "color", "palette", "texture", "material", "pose", "action", "architecture", "product", "character", "illustration", "painting", "render", "photo"]
PREFILTER_WORDS = ["photo", "portrait", "camera", "lighting", "cinematic", "anime", "cartoon", "illustration", "painting", "concept art", "watercolor", "render", "3d", "unreal", "blender", "product", "landscape", "architecture", "character", "environment", "composition", "style"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "without"]
GENERIC_WORDS = ["best quality", "masterpiece", "high quality", "highres", "8k", "4k", "detailed", "highly detailed", "ultra detailed", "beautiful", "amazing", "intricate"]
EXPLICIT_WORDS = ["nsfw", "nude", "naked", "nipples", "breasts", "cleavage", "pussy", "sex", "sexy", "seductive", "panties", "bra", "erotic", "explicit", "porn"]
#: Lowest score a candidate is kept with.
LEAST_SCORE = 8.0


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(c: Column) -> Column:
    """The tokens of a text in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9_-]*"), 0)


def phrase_hits(c: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur anywhere in the text, inside words too."""
    low = F.lower(c)
    return sum((low.contains(p).cast("int") for p in phrases[1:]), low.contains(phrases[0]).cast("int"))


def any_phrase(c: Column, phrases: list[str]) -> Column:
    return phrase_hits(c, phrases) > 0


def domain(c: Column) -> Column:
    """The domain with most phrase hits, the first of equals; the general one without any."""
    hits = {d: phrase_hits(c, w) for d, w in DOMAIN_WORDS.items()}
    most = F.greatest(*hits.values())
    out = F.when(most <= 0, F.lit(DOMAINS[-1]))
    for d, h in hits.items():
        out = out.when(h == most, F.lit(d))
    return out


def tags(c: Column, groups: dict[str, list[str]], most: int = 6) -> Column:
    """The groups of which some word occurs, in declared order."""
    each = [F.when(any_phrase(c, w), F.lit(t)) for t, w in groups.items()]
    return F.slice(F.filter(F.array(*each), lambda x: x.isNotNull()), 1, most)


def length_score(n: Column) -> Column:
    """A score for the number of tokens: full from 12 to 70, falling off on both sides."""
    return (
        F.when((n < 6) | (n > 120), F.lit(-8.0)).when(n.between(12, 70), F.lit(8.0)).when(n < 12, (n - 4).cast("double"))
        .otherwise(F.greatest(F.lit(0.0), F.lit(8.0) - (n - 70) / F.lit(8.0)))
    )


def signature(token_array: Column, common: Column | None = None) -> Column:
    """The set of the first 80 useful tokens, sorted."""
    ignored = words(STOP_WORDS + GENERIC_WORDS)
    ignored = ignored if common is None else F.concat(ignored, common)
    useful = F.filter(token_array, lambda t: (F.length(t) > 2) & ~F.array_contains(ignored, t))
    return F.sort_array(F.array_distinct(F.slice(useful, 1, 80)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that passes through a generator, so that the optimiser computes it once and does not write it into
    each of its uses."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def score_frame(df: DataFrame, text: Column, keys: Column, common: Column | None = None) -> DataFrame:
    """df with n_tokens, domain, tags, difficulty, signature and score of a text and its wildcard keys. Every hit is counted
    once, over the text in lower case once. Null texts score as empty ones."""
    b = _once(df, "_low", F.lower(F.coalesce(text, F.lit(""))))
    low = F.col("_low")
    hits = lambda ws: sum((low.contains(w).cast("int") for w in ws[1:]), low.contains(ws[0]).cast("int"))
    found = lambda ws: reduce(lambda x, y: x | y, [low.contains(w) for w in ws])
    tagged = lambda groups: F.slice(F.filter(F.array(*[F.when(found(w), F.lit(t)) for t, w in groups.items()]), lambda x: x.isNotNull()), 1, 6)
    names = list(DOMAIN_WORDS)
    b = _once(
        b, "_h",
        F.struct(
            F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9_-]*"), 0).alias("t"), *[hits(DOMAIN_WORDS[d]).alias(f"d{k}") for k, d in enumerate(names)],
            hits(GENERIC_WORDS).alias("generic"), tagged(TAG_WORDS).alias("tags"), tagged(DIFFICULTY_WORDS).alias("difficulty"),
        ),
    )
    h = F.col("_h")
    d = [h[f"d{k}"] for k in range(len(names))]
    where = F.when(F.greatest(*d) <= 0, F.lit(DOMAINS[-1]))
    for k, n in enumerate(names):
        where = where.when(d[k] == F.greatest(*d), F.lit(n))
    unique = F.array_distinct(h["t"])
    shared = F.lit(0) if common is None else F.size(F.array_intersect(unique, common))
    visual = F.size(F.array_intersect(unique, words(VISUAL_WORDS))) + sum(d[1:], d[0])
    b = b.select("*", where.alias("domain"), F.size(h["t"]).alias("n_tokens"), h["tags"].alias("tags"), h["difficulty"].alias("difficulty"), signature(h["t"], common).alias("signature"))
    score = (
        length_score(F.size(h["t"])) + F.least(F.size(keys), F.lit(5)) * 3.0 + F.least(F.size(h["tags"]), F.lit(5)) * 2.5 + F.least(F.size(h["difficulty"]), F.lit(3)) * 1.5
        + visual * 1.25 + F.log1p(F.size(F.array_except(unique, words(STOP_WORDS)))) * 3.0 - h["generic"] * 1.4 - shared * 0.45
        + F.when(F.col("domain") == DOMAINS[-1], F.least(F.size(h["difficulty"]), F.lit(4)) * 1.8).otherwise(F.lit(0.0))
    )
    return b.select("*", score.alias("score")).drop("_low", "_h")
