"""A varied subset of a given size.

Max-sum dispersion by local search over composable core-sets: the records are dealt into partitions of bounded size; each
partition picks a core-set by farthest-first traversal; core-sets are merged and thinned, round by round, until they fit
one partition; then selected and unselected candidates are swapped while the total pairwise distance of the selection
increases.

What one search selects is a cell. A subset of up to PER_CELL rows is one cell over all records. A larger one is as many
cells as it needs: records are grouped by the nearest of some varied anchors, so that a large group of similar records
meets itself, each group gets the same part of the size up to what it has, and a group whose part is larger than a cell is
dealt into several. All cells of all sets go through the same rounds together.

Texts become unit vectors of hashed words; the distance is the chord between them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise

from .mixture import sainte_lague

#: Length of a vector; records of a partition; rows that one search selects at most; groups of a subset of more.
DIMENSIONS, PARTITION, PER_CELL, ANCHORS = 256, 4_000, 500, 64
_WORD = re.compile(r"[^\W_]+")


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors; zero for a text without words."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    kept: dict[str, tuple[int, float]] = {}

    def place(w: str) -> tuple[int, float]:
        if w not in kept:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            kept[w] = h % DIMENSIONS, 1.0 if h >> 63 else -1.0
        return kept[w]

    for k, t in enumerate(texts):
        for w in set(_WORD.findall(t.lower())):
            i, s = place(w)
            out[k, i] += s
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def _farthest_first(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of k rows: the smallest id first, then always the row farthest from those taken; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    v = v[order]
    near = np.full(len(v), np.inf, np.float32)
    taken = [0]
    for _ in range(min(k, len(v)) - 1):
        d = 2 - 2 * (v @ v[taken[-1]])
        near = np.minimum(near, d)
        near[taken[-1]] = -1
        taken.append(int(np.argmax(near)))
    return order[np.array(taken[:k], int)]


def _distances(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (v @ to.T), 0))


def local_search(v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, float, float]:
    """(indices, total distance before, after): from the farthest-first choice of k rows, a swap of a selected with an
    unselected row is made while any increases the total pairwise distance."""
    k = min(k, len(v))
    if k <= 0:
        return np.zeros(0, int), 0.0, 0.0
    chosen = _farthest_first(v, ids, k)
    inside = np.zeros(len(v), bool)
    inside[chosen] = True
    # in double precision, so that rounding stays far below the least gain and no swap is made back and forth
    v = v.astype(np.float64)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    v /= np.where(norms > 0, norms, 1)
    # each row's total distance to the selection, in which a selected row counts its distance to itself too
    total = np.concatenate([_distances(v[lo : lo + 2000], v[inside]).sum(1) for lo in range(0, len(v), 2000)])
    own = np.sqrt(np.maximum(2 - 2 * (v * v).sum(1), 0))

    def best(outs: np.ndarray, ins: np.ndarray) -> tuple[float, int, int]:
        top = (-np.inf, -1, -1)
        for lo in range(0, len(outs), 256):
            part = outs[lo : lo + 256]
            gain = total[ins][None, :] - (total - own)[part][:, None] - _distances(v[part], v[ins])
            a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[a, b] > top[0]:
                top = (float(gain[a, b]), int(part[a]), int(ins[b]))
        return top

    before = float((total - own)[inside].sum() / 2)
    sum_now = before
    while k < len(v):
        outs, ins = np.flatnonzero(inside), np.flatnonzero(~inside)
        outs = outs[np.argsort((total - own)[outs], kind="stable")]
        ins = ins[np.argsort(-total[ins], kind="stable")]
        least = 1e-6 * max(1.0, sum_now)
        # the least useful selected rows against the most useful others, and all pairs if none of these gains
        gain, out, new = best(outs[:32], ins[:64])
        if gain <= least:
            gain, out, new = best(outs, ins)
        if gain <= least:
            break
        inside[out], inside[new] = False, True
        sum_now += gain
        total += _distances(v, v[[new]])[:, 0] - _distances(v, v[[out]])[:, 0]
    picked = np.flatnonzero(inside)
    return picked[np.argsort(ids[picked], kind="stable")], before, sum_now


def _core(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k rows of the farthest-first traversal with their rank, so that a smaller core-set is a part of it."""
    got = pdf.iloc[_farthest_first(np.array(pdf["v"].tolist(), np.float32), pdf["record_id"].to_numpy(), k)]
    return got.assign(rank=np.arange(len(got), dtype=np.int32))


def _searched(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    at, before, after = local_search(np.array(pdf["v"].tolist(), np.float32), pdf["record_id"].to_numpy(), k)
    return pdf.iloc[at][["cell", "record_id"]].assign(sum_before=before, sum_after=after)


def represented(records: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(record_id, v) of one record for each text: equal texts (letter case and spacing aside) are one candidate, the one
    with the smallest id. Null ids and records whose first text is null or blank are no candidates."""
    first = records[text_cols[0]]
    text = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", *[records[c] for c in text_cols]), r"[\s_]+", " ")))
    one = records.where(records[id_col].isNotNull() & first.rlike(r"\w")).select(records[id_col].cast("bigint").alias("record_id"), text.alias("t"))
    one = one.groupBy("t").agg(F.min("record_id").alias("record_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"record_id": b["record_id"], "v": list(vectors(b["t"].tolist()))})

    return materialise(one.mapInPandas(run, "record_id bigint, v array<float>"), "varied-vectors")


def _dealt(df: DataFrame, parts: Column, seed: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "record_id"), parts))


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's part of a subset divided over its cells, by their rows."""
    pdf = pdf.sort_values("c").reset_index(drop=True)
    n = pdf["n"].to_numpy()
    return pdf[["name", "g", "c"]].assign(quota=sainte_lague(n.astype(float), n, int(pdf["q"].iloc[0])).astype(np.int32))


_CELL = "cell string, quota int, record_id bigint, v array<float>"


def search(cells: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(cell, record_id, sum_before, sum_after): of each cell's rows (cell, quota, record_id, v) quota varied ones, all where it
    has no more. Cells over a partition are thinned to core-sets, round by round; quota must be well below a partition."""
    cells, seed = materialise(cells, "varied-cells"), 1
    while True:
        large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > partition)
        large = materialise(large.select("cell", F.ceil(F.col("n") / partition).alias("parts")), "varied-large")
        if large.isEmpty():
            return cells.groupBy("cell").applyInPandas(lambda p: _searched(p, int(p["quota"].iloc[0])), "cell string, record_id bigint, sum_before double, sum_after double")
        dealt = _dealt(cells.join(large, "cell"), F.col("parts"), seed)
        core = dealt.groupBy("cell", "part").applyInPandas(lambda p: _core(p[["cell", "quota", "record_id", "v"]], int(p["quota"].iloc[0])).drop(columns="rank"), _CELL)
        cells = materialise(core.unionByName(cells.join(large, "cell", "left_anti")), "varied-cells")
        seed += 1


def select_all(candidates: DataFrame, sizes: dict[str, int], partition: int = PARTITION, per_cell: int | None = None) -> DataFrame:
    """(name, record_id, sum_before, sum_after) of varied subsets of represented(), each of its size or of all there are. A
    subset of several cells has a sum a cell."""
    per_cell = min(PER_CELL, partition // 8) if per_cell is None else per_cell
    spark, n = candidates.sparkSession, candidates.count()
    sizes = {name: min(k, n) for name, k in sizes.items() if min(k, n) > 0}
    large = {name: k for name, k in sizes.items() if k > per_cell}
    small = {f"s{name}": k for name, k in sizes.items() if k <= per_cell} | ({"anchors": min(ANCHORS, per_cell)} if large else {})
    schema = "cell string, record_id bigint, sum_before double, sum_after double"
    found = spark.createDataFrame([], schema)
    if small:
        # one traversal of each partition serves all subsets: a core-set of fewer rows is the first part of one of more
        most = max(small.values())
        core = candidates.withColumn("rank", F.lit(-1))
        if n > partition:
            dealt = _dealt(candidates, F.lit(-(-n // partition)), 0)
            core = materialise(dealt.groupBy("part").applyInPandas(lambda p: _core(p[["record_id", "v"]], most), "record_id bigint, v array<float>, rank int"), "varied-core")
        plan = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(k).alias("quota")) for c, k in small.items()])).alias("p")
        found = search(core.select(plan, "record_id", "v", "rank").where("rank < p.quota").select("p.cell", "p.quota", "record_id", "v"), partition)
        found = materialise(found, "varied-found")
    out = found.where("cell <> 'anchors'").withColumn("name", F.expr("substr(cell, 2)"))
    if large:
        points = np.array([r[0] for r in candidates.join(found.where("cell = 'anchors'").select("record_id"), "record_id").orderBy("record_id").select("v").collect()], np.float32)
        shared = spark.sparkContext.broadcast(points)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            return pd.Series(np.argmax(np.array(v.tolist(), np.float32) @ shared.value.T, axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

        # two columns: the vectors are not written again
        grouped = materialise(candidates.select("record_id", nearest("v").alias("g")), "varied-groups")
        held = {r[0]: r[1] for r in grouped.groupBy("g").count().collect()}
        rows = []
        for name, k in large.items():
            # equal parts, what a small group cannot take going to the others
            left, room = k, sorted(held, key=lambda g: (held[g], g))
            for j, g in enumerate(room):
                q = min(held[g], left // (len(room) - j) + (left % (len(room) - j) > 0))
                left -= q
                if q:
                    rows.append((name, int(g), -(-q // per_cell), int(q)))
        plan = spark.createDataFrame(rows, "name string, g int, cells bigint, q bigint")
        dealt = grouped.join(F.broadcast(plan), "g").withColumn("c", F.pmod(F.xxhash64(F.lit(7), "record_id"), F.col("cells")))
        counts = dealt.groupBy("name", "g", "c", "q").agg(F.count("*").alias("n"))
        quotas = counts.groupBy("name", "g").applyInPandas(_quotas, "name string, g int, c bigint, quota int").where("quota > 0")
        cells = dealt.select("name", "g", "c", "record_id").join(quotas, ["name", "g", "c"]).join(candidates, "record_id")
        cells = cells.select(F.concat_ws("/", "g", "c", "name").alias("cell"), "quota", "record_id", "v")
        out = out.unionByName(search(cells, partition).withColumn("name", F.expr("split(cell, '/', 3)[2]")))
    return out.select("name", "record_id", "sum_before", "sum_after")


def fill_sets(records: DataFrame, sets: DataFrame, id_col: str = "record_id", text_cols: tuple[str, ...] = ("positive_template", "concept"), partition: int = PARTITION) -> DataFrame:
    """(set_id, set_name, record_id) for every set that is not archived, filled to its target: a number of rows, or a share of
    all records in `metadata`. Sets without an id or a target are left out; a set is smaller than its target only if fewer
    different texts exist. The table of sets must be small, as each set is a part of the plan: more than MOST_SETS raise."""
    meta = F.from_json("metadata", "target double, target_share double")
    wanted = sets.where((F.lower(F.trim(F.coalesce("status", F.lit("")))) != "archived") & F.col("id").isNotNull()).select("id", "name", meta.alias("m")).select("id", "name", "m.target", "m.target_share").orderBy("id").limit(MOST_SETS + 1).collect()
    if len(wanted) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets: call once for each part of the table")
    everything = records.count() if any(r[2] is None and r[3] is not None for r in wanted) else 0
    sizes = {f"{i}": int(target) if target is not None else int(round((share or 0) * everything)) for i, _, target, share in wanted}
    names = sets.select(F.col("id").cast("string").alias("name"), F.col("id").cast("bigint").alias("set_id"), F.col("name").alias("set_name")).where("name is not null").dropDuplicates(["name"])
    got = select_all(represented(records, id_col, list(text_cols)), sizes, partition)
    return got.select("name", "record_id").join(names, "name").select("set_id", "set_name", "record_id")


#: Sets of one call.
MOST_SETS = 200
