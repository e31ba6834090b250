"""Records that differ in nothing but format: one record of each with its number of copies.

Recursive radix partitioning on canonical bytes. Each record becomes one byte string of what its fields say. Buckets
are the first bytes of that string; a bucket with more different strings than fit is split by further bytes, after those
that all its strings share, until each fits; then a path-compressed trie per bucket, with counters at its terminal nodes,
counts the copies. Copies are combined within each task before anything is counted or shuffled, so a group of copies
sends at most one entry per task and batch, however large it is, and splits nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillspark.session import materialise, spread

from .text import format_free, is_blank

#: Different strings a bucket may hold before it is split, and the bytes taken at a time.
BUCKET_LIMIT, STEP = 20_000, 4


class Trie:
    """Path-compressed byte trie; a terminal node holds [count, smallest id, digest]."""

    __slots__ = ("root", "terminals")

    def __init__(self) -> None:
        # a node: [label bytes, children by first byte or None, terminal or None]
        self.root: list = [b"", {}, None]
        self.terminals: list[list] = []

    def add(self, key: bytes, count: int, first: int, digest: bytes) -> None:
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                if node[2] is None:
                    node[2] = [count, first, digest]
                    self.terminals.append(node[2])
                else:
                    node[2][0] += count
                    node[2][1] = min(node[2][1], first)
                return
            child = node[1].get(key[at]) if node[1] else None
            if child is None:
                leaf = [key[at:], None, [count, first, digest]]
                self.terminals.append(leaf[2])
                if node[1] is None:
                    node[1] = {}
                node[1][key[at]] = leaf
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, most = 1, min(len(label), n - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            node, at = upper, at + same


def keyed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, digest, key): key is the canonical bytes of the fields, a zero byte between them. Rows with a null or blank
    field, or a null id, are no cases and are left out; a field of nothing but punctuation counts as what it is, empty."""
    whole = df.where(df[id_col].isNotNull())
    for f in fields:
        whole = whole.where(~is_blank(whole[f]))
    whole = spread(whole.select(whole[id_col].cast("bigint").alias("id"), *[whole[f].alias(f"f{k}") for k, f in enumerate(fields)]))
    key = F.concat_ws("\x00", *[format_free(F.col(f"f{k}")) for k in range(len(fields))])
    return whole.select("id", key.cast("binary").alias("key")).select(
        "id", F.unhex(F.md5("key")).alias("digest"), "key"
    )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.groupby("digest", sort=False).agg(key=("key", "first"), n=("id", "size"), first_id=("id", "min")).reset_index()


@F.pandas_udf(IntegerType())
def _shared(low: pd.Series, high: pd.Series) -> pd.Series:
    """How many bytes the smallest and the largest of some strings share, and so all of them."""
    return pd.Series([len(os.path.commonprefix([bytes(a), bytes(b)])) for a, b in zip(low, high)], dtype="int32")


def bucketed(combined: DataFrame, limit: int) -> DataFrame:
    """combined (digest, key, ...) with the bucket of each entry: a prefix of its key that at most `limit` different keys of
    the table begin with, unless they are that prefix. Which buckets are too large is a table that is joined, level by
    level; only their entries go on to the next level, and every level goes at least STEP bytes past what they share."""
    left, done = combined.withColumn("bucket", F.substring("key", 1, STEP)), None
    while True:
        sizes = left.select("bucket", "digest").distinct().groupBy("bucket").count().where(F.col("count") > limit).select("bucket")
        ends = left.join(sizes, "bucket", "left_semi").groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        large = materialise(ends.select("bucket", (_shared("low", "high") + STEP).alias("depth")), "formatdup-large")
        if large.isEmpty():
            return left if done is None else done.unionByName(left)
        fits = left.join(large, "bucket", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        left = left.join(large, "bucket").withColumn("bucket", F.expr("substring(key, 1, depth)")).drop("depth")
        left = materialise(left, "formatdup-level")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def counted(trie: Trie) -> pd.DataFrame:
        t = [x for x in trie.terminals if x[0] > 1]
        return pd.DataFrame({"digest": [x[2] for x in t], "first_id": [x[1] for x in t], "copies": [x[0] for x in t]})

    at, trie = None, Trie()
    for b in batches:
        for bucket, digest, key, n, first in zip(b["bucket"], b["digest"], b["key"], b["n"], b["first_id"]):
            if bucket != at:
                if trie.terminals:
                    yield counted(trie)
                at, trie = bucket, Trie()
            trie.add(key, n, first, digest)
    if trie.terminals:
        yield counted(trie)


def copy_groups(entries: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(digest, first_id, copies) of each group of two or more equal keys in entries, a stored keyed()."""
    combined = entries.select("id", "digest", "key").mapInPandas(_combine, "digest binary, key binary, n bigint, first_id bigint")
    combined = bucketed(materialise(combined, "formatdup-combined"), bucket_limit).select("digest", "bucket", "key", "n", "first_id")
    spread = combined.repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInPandas(_count, "digest binary, first_id bigint, copies bigint")


def collapse(df: DataFrame, id_col: str, fields: list[str], bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(first_id, record_id, copies): one row for each record that has copies, with the smallest id of its group.

    An id that occurs in several equal rows counts as so many copies and comes out as often. Members are joined to
    their group by the digest alone, and AQE splits a group that holds much of the rows."""
    entries = materialise(keyed(df, id_col, fields), "formatdup")
    groups = materialise(copy_groups(entries, bucket_limit), "formatdup-groups")
    return entries.select("digest", F.col("id").alias("record_id")).join(groups, "digest").select("first_id", "record_id", "copies")
