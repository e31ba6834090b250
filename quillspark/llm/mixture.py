"""Mixing sources to target weights.

Sainte-Lague apportionment of equal-token blocks: a mix of so many blocks gives each source the blocks with the highest
quotients weight / (2k - 1), up to the blocks it can give with its documents repeated as often as is allowed; the
blocks of a source (the last may be a part of one) are divided in the same way, in proportion to tokens: among runs of
SHARDS shards, then within each run among its shards. Within a shard documents lie in a seeded order, block after block,
and the shard's quota takes them from the start, over again where it exceeds the shard; a document belongs to the side of
the cut on which its middle lies, so a shard may miss its quota by half a document. A source of any size is spread over
shards of bounded size, so no task and no driver holds a source or all its shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import materialise, spread

from .tokens import RANKS_FILE, count

#: Tokens of a block, about how many tokens a shard holds, and the shards of a run.
BLOCK, SHARD, SHARDS = 256, 500_000, 65_536


def source_name(c: Column) -> Column:
    """A source under one spelling: lower case, trimmed, runs of anything else but letters and digits as one underscore.
    Null and blank stay null."""
    n = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(n, "^_+|_+$", ""), F.lit(""))


def sainte_lague(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients w / (2k - 1), none beyond its cap; ties go to the lower index. In closed form: the k-th
    quotient of w is at least t for k <= (w / t + 1) / 2, so t is found by bisection and the last seats are dealt one by
    one. Gives all caps where seats exceed them. Weights of 0 or less get nothing."""
    w, caps = np.where(np.isfinite(weights) & (weights > 0), weights, 0.0), np.maximum(np.asarray(caps, np.int64), 0)
    caps = np.where(w > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda t: np.minimum(np.floor((w / t + 1) / 2), caps).astype(np.int64)
    low, high = 1e-12 * w[w > 0].min() / (2 * seats + 1), 2 * w.max() + 1e-9
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
        if high / low < 1 + 1e-13:
            break
    out = given(high)
    while (left := seats - int(out.sum())) > 0:
        quotient = np.where(out < caps, w / (2 * out + 1), -1.0)
        for k in np.lexsort((np.arange(len(w)), -quotient))[:left]:
            if quotient[k] > 0:
                out[k] += 1
    return out


def with_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, ranks: str = RANKS_FILE) -> DataFrame:
    """(doc_id, source, tokens) of every document with at least one token; without an id or a source these are null."""
    @F.pandas_udf("bigint")
    def sizes(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, ranks) for t in texts], dtype="int64")

    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), source_name(docs[source_col]).alias("source"), docs[text_col].alias("t"))
    d = spread(d.where("t is not null and t <> ''"))
    return d.select("doc_id", "source", sizes("t").alias("tokens")).where("tokens > 0")


def _per_mix(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one mix: a row for each source named in it, so its size is that of the target table."""
    pdf = pdf.sort_values("source").reset_index(drop=True)
    seats = int(round(float(pdf["size_ratio"].iloc[0]) * float(pdf["total"].iloc[0]) / BLOCK))
    supply = np.ceil(pdf["supply"].fillna(0).to_numpy() / BLOCK * pdf["max_repeats"].fillna(0).clip(lower=0).to_numpy())
    pdf["quota"] = sainte_lague(pdf["target_share"].fillna(0).to_numpy(float), supply, seats)
    pdf["seats"] = seats
    return pdf[["mix_name", "source", "target_share", "max_repeats", "seats", "quota"]]


def _divided(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
    """A quota divided over rows of weight `tokens` and cap `cap`, ties to the lower `by`."""
    pdf = pdf.sort_values(by).reset_index(drop=True)
    pdf["given"] = sainte_lague(pdf["tokens"].to_numpy(float), pdf["cap"].to_numpy(), int(pdf["quota"].iloc[0]))
    return pdf[["mix_name", "source", by, "given"]]


def apportion(docs: DataFrame, targets: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranks: str = RANKS_FILE) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for every mix of targets.

    chosen: (mix_name, source, doc_id, tokens, repeats), each document in a mix with how often it is taken, at most
    max_repeats times. shares: (mix_name, source, target_share, wanted_share, tokens, share, quota_blocks, documents,
    deviation): wanted_share is the target share of the mix's sum of shares, share what is reached of the tokens drawn,
    deviation the tokens drawn over those of the quota's blocks.

    A source without documents, with a share of 0 or null, or with no repeats allowed gets nothing and its blocks go to
    the others; a mix whose sources cannot fill its size is as large as they allow. Spellings of a source count as one;
    repeated target rows of a source are added up (the least of their repeats holds). Ids are taken as unique."""
    everything = materialise(with_tokens(docs, id_col, text_col, source_col, ranks), "mixture-sizes")
    sized = everything.where("doc_id is not null and source is not null")
    t = targets.select("mix_name", source_name(targets["source"]).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"), F.col("size_ratio").cast("double").alias("size_ratio"))
    t = t.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    supply = sized.groupBy("source").agg(F.sum("tokens").alias("supply"))
    # a mix is a multiple of the tokens of all documents, those that cannot be drawn for want of a source or id included
    total = everything.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    ratio = W.partitionBy("mix_name")
    asked = t.join(supply, "source", "left").crossJoin(F.broadcast(total)).withColumn("size_ratio", F.coalesce(F.max("size_ratio").over(ratio), F.lit(0.0)))
    quotas = asked.groupBy("mix_name").applyInPandas(_per_mix, "mix_name string, source string, target_share double, max_repeats int, seats bigint, quota bigint")
    quotas = materialise(quotas, "mixture-quotas")

    shards = F.greatest(F.lit(1), F.ceil(F.col("supply") / SHARD))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sharded = sized.join(supply, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), shards)).drop("supply")
    lie = W.partitionBy("source", "shard").orderBy(order, "doc_id")
    placed = sharded.withColumn("start", F.sum("tokens").over(lie.rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["start"])
    sizes = sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("shard_tokens"))
    cap = F.ceil(F.col("tokens") / BLOCK * F.col("max_repeats"))
    asked = sizes.withColumnRenamed("shard_tokens", "tokens").join(quotas.where("quota > 0"), "source")
    asked = asked.select("mix_name", "source", "shard", F.floor(F.col("shard") / SHARDS).alias("run"), "tokens", "max_repeats", cap.alias("cap"), "quota")
    runs = asked.groupBy("mix_name", "source", "run").agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"), F.max("quota").alias("quota"))
    runs = runs.groupBy("mix_name", "source").applyInPandas(lambda p: _divided(p, "run"), "mix_name string, source string, run bigint, given bigint")
    given = asked.drop("quota").join(runs.withColumnRenamed("given", "quota"), ["mix_name", "source", "run"])
    given = given.groupBy("mix_name", "source", "run").applyInPandas(lambda p: _divided(p, "shard"), "mix_name string, source string, shard bigint, given bigint")
    per_shard = given.withColumnRenamed("given", "shard_quota").join(sizes, ["source", "shard"]).join(quotas.select("mix_name", "source", "max_repeats"), ["mix_name", "source"])
    # the quota runs through the shard's order full times and then up to its rest; a document belongs to the side of
    # the cut on which its middle lies
    full, rest = F.floor(F.col("shard_quota") * BLOCK / F.col("shard_tokens")), F.expr(f"shard_quota * {BLOCK} % shard_tokens")
    per_shard = per_shard.select("mix_name", "source", "shard", "max_repeats", full.alias("full"), rest.alias("rest"))
    taken = placed.join(per_shard, ["source", "shard"]).withColumn(
        "repeats", F.least(F.col("max_repeats"), F.col("full") + F.when(F.col("start") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).cast("int")
    )
    chosen = materialise(taken.where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats"), "mixture-chosen")
    drawn = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    of_mix = W.partitionBy("mix_name")
    shares = (
        quotas.join(drawn, ["mix_name", "source"], "left")
        .fillna(0, ["tokens", "documents", "most_repeats"])
        .select(
            "mix_name", "source", "target_share",
            (F.col("target_share") / F.sum("target_share").over(of_mix)).alias("wanted_share"),
            F.col("quota").alias("quota_blocks"), (F.col("tokens") - F.col("quota") * BLOCK).alias("deviation"), "tokens", "documents", "most_repeats", "max_repeats",
            F.try_divide(F.col("tokens"), F.sum("tokens").over(of_mix)).alias("share"),
            (F.col("seats") * BLOCK).alias("mix_tokens_wanted"),
        )
    )
    return chosen, shares
