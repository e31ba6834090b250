"""Evaluation sets: candidate pools by domain, greedy diverse selection, core and special sets, report."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.scoring import DOMAINS, SET_NAMES
from quillspark.session import materialise

# Similarity in the first and the second pass.
STRICT, RELAXED = 0.72, 0.86


def top_per_domain(scored: DataFrame, k: int, order: str = "record_id") -> DataFrame:
    """The k best of each domain, ties to the smaller id."""
    n = F.row_number().over(W.partitionBy("domain").orderBy(F.desc("score"), order))
    return scored.withColumn("rank", n).where(F.col("rank") <= k)


def quotas(target: int) -> dict[str, int]:
    """The target divided over the domains, the remainder to the first ones."""
    base, rest = divmod(target, len(DOMAINS))
    return {d: base + (k < rest) for k, d in enumerate(DOMAINS)}


def stable_seed(identifier: str, number: int) -> int:
    """A seed between 1 and 2^31 - 1 that depends on the text only."""
    return random.Random(f"{identifier}|{number}").randint(1, 2_147_483_647)


def _alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def choose(pool: list[dict], target: int, used: set) -> list[dict]:
    """Rows of a pool, best first, that are unlike those chosen before; no tag more often than a quarter of the target, three
    at least; a second pass with a laxer likeness and no cap on tags. used holds ids not to be taken and is extended."""
    out: list[dict] = []
    tags: dict[str, int] = {}
    cap = max(3, target // 4)
    for strict in (True, False):
        for c in pool:
            if len(out) >= target:
                return out
            if c["record_id"] in used or any(_alike(c["signature"], o["signature"]) >= (STRICT if strict else RELAXED) for o in out):
                continue
            if strict and c["tags"] and max(tags.get(t, 0) for t in c["tags"]) >= cap:
                continue
            out.append(c)
            used.add(c["record_id"])
            for t in c["tags"]:
                tags[t] = tags.get(t, 0) + 1
    return out


def diverse(pool: DataFrame, target: int) -> DataFrame:
    """(domain, position, record_id, score) chosen from each domain's pool (record_id, domain, score, tags, signature, rank).
    Pools are bounded by top_per_domain(), so one task holds one."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = p.sort_values(["score", "record_id"], ascending=[False, True]).to_dict("records")
        for r in rows:
            r["signature"], r["tags"] = set(r["signature"]), list(r["tags"])
        got = choose(rows, target, set())
        return pd.DataFrame([(r["domain"], k + 1, r["record_id"], r["score"]) for k, r in enumerate(got)], columns=["domain", "position", "record_id", "score"])

    return pool.groupBy("domain").applyInPandas(run, "domain string, position int, record_id bigint, score double")


def build_sets(pool: DataFrame, target: int, special: int) -> DataFrame:
    """(set_name, position, record_id, score): a core set with a quota for each domain, filled up from all pools without
    those chosen, and one set for each special domain. The pools are bounded, so one task holds all."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = p.sort_values(["score", "record_id"], ascending=[False, True]).to_dict("records")
        for r in rows:
            r["signature"], r["tags"] = set(r["signature"]), list(r["tags"])
        pools = {d: [r for r in rows if r["domain"] == d] for d in DOMAINS}
        used: set = set()
        core = [c for d, q in quotas(target).items() for c in choose(pools[d], q, used)]
        core += choose(rows, target - len(core), used)
        sets = {f"eval-core-{target}": core} | {name: choose(pools[d], special, set()) for d, name in SET_NAMES.items()}
        out = [(n, k + 1, r["record_id"], r["score"]) for n, s in sets.items() for k, r in enumerate(s)]
        return pd.DataFrame(out, columns=["set_name", "position", "record_id", "score"])

    return pool.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "set_name string, position int, record_id bigint, score double")


def similar_pairs(pool: DataFrame, threshold: float = STRICT) -> DataFrame:
    """(domain, a, b, similarity) of rows of a bounded pool, within a domain, at least so alike; the threshold is above 0.

    Two sets that alike share so much of the larger that one of the rarest words of each, as many as it could miss and
    one more, is common to both: pairs meet by these, none is lost, and each is verified on all words."""
    pool = materialise(pool.select("domain", "record_id", "rank", "signature"), "similar-pool")
    words = pool.select("domain", "rank", F.size("signature").alias("size"), F.explode("signature").alias("word"))
    rarity = words.groupBy("domain", "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("domain", "rank").orderBy("n", "word"))
    rare = words.join(rarity, ["domain", "word"]).withColumn("nth", nth).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    ra, rb = (rare.select("domain", "word", F.col("rank").alias(r)) for r in ("ra", "rb"))
    met = ra.join(rb, ["domain", "word"]).where("ra < rb").select("domain", "ra", "rb").distinct()
    a = pool.select("domain", F.col("record_id").alias("a"), F.col("signature").alias("sa"), F.col("rank").alias("ra"))
    b = pool.select("domain", F.col("record_id").alias("b"), F.col("signature").alias("sb"), F.col("rank").alias("rb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    j = met.join(a, ["domain", "ra"]).join(b, ["domain", "rb"]).withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared))
    return j.where(F.col("similarity") >= threshold).select("domain", "a", "b", "similarity")


def report_lines(sets: DataFrame, records: DataFrame) -> DataFrame:
    """(set_name, position, line): the sets as rows of a Markdown table."""
    text = F.regexp_replace(F.coalesce("concept", F.lit("")), r"\|", r"\\|")
    j = sets.join(records.select("record_id", "identifier", "concept"), "record_id")
    return j.select("set_name", "position", F.format_string("| %d | %s | %s | %.2f |", "position", "identifier", text, "score").alias("line"))
