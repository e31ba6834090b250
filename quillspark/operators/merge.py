"""Merging incoming rows into stored tables: snapshots in, snapshots and version rows out.

Nothing here writes. Each function returns the frames that a write would store, so a dry run is the same call without
the write. A snapshot is replaced as a whole (public Spark has no in-place merge of parquet).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import materialise


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key, the first in order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Rows of incoming whose key is not stored yet, the first of each key."""
    return keep_first(incoming, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def with_ids(new: DataFrame, stored: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """New rows with ids that go on from the largest stored one, in order. The numbering sorts new rows by range and
    counts rows before each partition, so no task holds them all."""
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = number_within(new.withColumn("_all", F.lit(0)), "_all", order, "_k").drop("_all")
    return numbered.crossJoin(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.col("_k")).drop("_k", "_top")


def number_within(rows: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """rows with a column of their number within their group, from 1 in order. No task holds a group: rows are sorted by
    range once and written, so that both readings number alike, and each range goes on counting where the group's part
    in the ranges before it ended."""
    spread = rows.repartitionByRange(F.col(group), *[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_p", F.spark_partition_id())
    spread = materialise(spread, "numbered")
    sizes = spread.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    # as many rows for a group as it has ranges, not as it has rows
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"))
    j = spread.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    in_range = F.row_number().over(W.partitionBy("_p", group).orderBy(*order))
    return j.withColumn(name, F.col("_before") + in_range).drop("_p", "_q", "_g", "_before")


@dataclass
class Merged:
    """The new snapshot, the action taken for each incoming row (created, updated, unchanged) and version rows."""

    snapshot: DataFrame
    actions: DataFrame
    versions: DataFrame


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], compare: list[str], order: list[str], versions: DataFrame | None = None, always: bool = False) -> Merged:
    """Applies incoming rows in order to stored ones. Each row that changes one of the compared columns against the
    state before it, stored or from an earlier incoming row of its key, makes a version; the last row of a key wins.

    versions: what is stored of (key, version), to number on from. always: every row counts as a change. Compared nulls
    are equal to each other."""
    old = stored.select(*key, *[F.col(c).alias(f"_old_{c}") for c in compare], F.lit(True).alias("_there"))
    line = W.partitionBy(*key).orderBy(*order)
    b = incoming.join(old, key, "left").withColumn("_k", F.row_number().over(line)).withColumn("_last", F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])) == 1)
    before = lambda c: F.when(F.col("_k") > 1, F.lag(c).over(line)).otherwise(F.col(f"_old_{c}"))
    new = (F.col("_k") == 1) & F.col("_there").isNull()
    changed = F.lit(always)
    for c in compare:
        changed = changed | ~F.col(c).eqNullSafe(before(c))
    b = b.withColumn("action", F.when(new, "created").when(changed, "updated").otherwise("unchanged"))
    top = F.lit(0)
    if versions is not None:
        b = b.join(versions.groupBy(*key).agg(F.max("version").alias("_top")), key, "left")
        top = F.coalesce("_top", F.lit(0))
    made = F.sum((F.col("action") != "unchanged").cast("bigint")).over(line)
    b = b.withColumn("version", F.when(F.col("action") != "unchanged", top + made))
    cols = [c for c in incoming.columns if c in stored.columns]
    final = b.where("_last").select(*cols)
    rest = stored.join(incoming.select(*key).distinct(), key, "left_anti")
    snapshot = rest.unionByName(final, allowMissingColumns=True)
    return Merged(snapshot, b.select(*key, *order, "action"), b.where("version is not null").select(*key, "version", *compare, F.col("action").alias("change_type")))


def replace_members(members: DataFrame, set_ids: DataFrame, chosen: DataFrame, order: list[str]) -> DataFrame:
    """The members with those of the named sets replaced by chosen (set_id, prompt_id, order...), positions from 1."""
    kept = members.join(set_ids.select("set_id").distinct(), "set_id", "left_anti")
    placed = number_within(chosen, "set_id", order, "position")
    return kept.unionByName(placed.select("set_id", "prompt_id", F.col("position").cast("int").alias("position"), F.lit(True).alias("enabled")))


def patch_json(c: Column, path: str, value: Column) -> Column:
    """A JSON object of strings with one member set, keys sorted; what is no object becomes one."""
    held = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(held, lambda k, v: k != path), F.create_map(F.lit(path), value))
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(merged))))


def upsert_jobs(stored: DataFrame, incoming: DataFrame, key: list[str], refreshed: list[str]) -> DataFrame:
    """Jobs where a conflict refreshes only the named columns; status and attempts of a stored job stay."""
    new = keep_first(incoming, key, [F.lit(0)] if not refreshed else refreshed).select(*key, *[F.col(c).alias(f"_new_{c}") for c in refreshed])
    both = stored.join(new.withColumn("_hit", F.lit(True)), key, "full_outer")
    cols = []
    for c in stored.columns:
        if c in key:
            cols.append(F.col(c))
        elif c in refreshed:
            cols.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "status":
            cols.append(F.coalesce(c, F.lit("pending")).alias(c))
        elif c == "attempt_count":
            cols.append(F.coalesce(c, F.lit(0)).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)
