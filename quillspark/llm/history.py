"""New batches against all accepted history: every record of a new batch with the earliest record it repeats.

The metric is the number of words in which two sets differ; a repeat lies within a radius that grows with their sizes.
Records of the same words are one class. A stored table holds each class with its words and its distances to fixed
pivots: PIVOTS disjoint parts of all words, in each of which the distance to the empty set, at most 1, says whether the
class has a word there, and the empty set itself, from which the distance is the size. As the parts are disjoint, the
triangle inequalities over them add up: two classes differ in at least as many words as distances, so a pair whose
distances differ by more than the radius is pruned without reading its words. What is left is verified on the words.

Candidates meet under near pivots: words under random priorities weighted by rarity, of which the ROWS nearest make one
key, BANDS times over. That misses some pairs at the edge of the radius; `exact` joins by ranges of the distance to the
empty set instead, which meets all pairs that the triangle inequality allows.

Pivots, priorities and the word frequencies behind them are fixed when the table is made. A new batch reads the table and
itself, never the texts of history; rows of its new classes are appended, and history is never compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import materialise, scratch, spread

from .text import prompt_words

#: Largest distance of a repeat: three quarters of n words stay, so 0.75 n of 1.25 n different words are shared.
RADIUS = 0.4
#: Near pivots in a key, keys of a class, buckets of the table of word frequencies (its size is fixed).
ROWS, BANDS, BUCKETS = 3, 20, 1 << 17
#: Bounds of a word's weight: a word of most texts still counts, so that large families of near copies meet, and rare words
#: do not outweigh the others, as they may be the ones that were replaced.
LIGHTEST, HEAVIEST = 1.0, 2.5
#: Classes under one key from which on it is hot, and about how many of them lead it.
HOT, LEADERS = 20_000, 64
#: Far pivots: distances of 0 or 1, as bits in two longs.
PIVOTS = 128
#: Parts into which either side of a range of the exact join is cut, so that no task holds a range.
SLICES = 16
_MASK = (1 << 64) - 1


_DIGEST = ["d1", "d2"]


def parsed(df: DataFrame, id_col: str, text_col: str, batch_col: str) -> DataFrame:
    """(id, batch, d1, d2, words) of each record: its words, sorted, with single spaces, and their digest of 128 bits. Null ids
    and batches, null or blank texts, and texts without a word of their own, are left out."""
    # through a generator, so that the words are worked out once and not again for the filter
    words = df.where(df[id_col].isNotNull() & df[batch_col].isNotNull()).select(df[id_col].cast("bigint").alias("id"), df[batch_col].cast("bigint").alias("batch"), F.explode(F.array(F.array_join(prompt_words(df[text_col]), " "))).alias("words"))
    return words.where("words <> ''").select("id", "batch", F.xxhash64("words").alias("d1"), F.xxhash64(F.lit(1), "words").alias("d2"), "words")


def _in_order(first: str, batch: str) -> Column:
    """The least id, which must lie in the least batch: ids rise with the batch, or no one record is the first."""
    later = F.min(F.struct(batch, first))[first] != F.min(first)
    return F.when(later, F.raise_error(F.lit("ids do not rise with the batch"))).otherwise(F.min(first))


def classes_of(rows: DataFrame) -> DataFrame:
    """(d1, d2, first_id, first_batch, last_batch, words) of parsed() rows, a row for each set of words."""
    return rows.groupBy(*_DIGEST).agg(_in_order("id", "batch").alias("first_id"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"), F.first("words").alias("words"))


def _hashes() -> Column:
    return F.transform(F.split("words", " "), lambda w: F.xxhash64(w))


def word_frequencies(classes: DataFrame) -> np.ndarray:
    """How many classes hold a word of each hash bucket: a table of fixed size, whatever the data."""
    counts = (
        classes.select(F.explode(_hashes()).alias("w"))
        .groupBy(F.pmod("w", F.lit(BUCKETS)).alias("b"))
        .count()
    )
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():
        out[r[0]] = r[1]
    return out


def pivot_rows(classes: DataFrame, frequencies: np.ndarray, total: int) -> DataFrame:
    """The pivot table: (first_id, first_batch, last_batch, size, keys, low, high) of classes: keys are those of the near pivots,
    size the distance to the empty set, low and high the distances to the far pivots."""
    shared = classes.sparkSession.sparkContext.broadcast(frequencies)
    n = ROWS * BANDS

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def priorities(h: int) -> np.ndarray:
            """-log(u) over the word's weight, for each of n random orders: the least is the nearest pivot."""
            x = np.uint64(h & _MASK) + steps
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-18
            weight = min(max(np.log((total + 1) / (shared.value[h % BUCKETS] + 1)), LIGHTEST), HEAVIEST)
            return (-np.log(u) / weight).astype(np.float32)

        salt = np.arange(BANDS, dtype=np.int64) * np.int64(0x1234567)
        for b in batches:
            keys, low, high = [], [], []
            with np.errstate(over="ignore"):
                for hs in b["hashes"]:
                    for h in hs.tolist():
                        if h not in seen:
                            if len(seen) > 60_000:
                                seen.clear()
                            seen[h] = priorities(h)
                    nearest = hs[np.argmin(np.stack([seen[h] for h in hs.tolist()]), axis=0)].reshape(BANDS, ROWS)
                    key = salt
                    for k in range(ROWS):
                        key = key * np.int64(1_000_003) + nearest[:, k]
                    keys.append(np.unique(key))
                    bits = (hs >> 20) & (PIVOTS - 1)
                    low.append(int(np.bitwise_or.reduce(np.where(bits < 64, np.int64(1) << (bits & 63), 0))))
                    high.append(int(np.bitwise_or.reduce(np.where(bits >= 64, np.int64(1) << (bits & 63), 0))))
            b["size"], b["keys"], b["low"], b["high"] = [len(x) for x in b["hashes"]], keys, low, high
            yield b.drop(columns="hashes")

    hashed = classes.select("first_id", "first_batch", "last_batch", _hashes().alias("hashes"))
    return hashed.mapInPandas(rows, _PIVOT_ROW)


_PIVOT_ROW = "first_id bigint, first_batch bigint, last_batch bigint, size int, keys array<bigint>, low bigint, high bigint"
#: The triangle inequality over the far pivots: sets within RADIUS differ in at most RADIUS / (2 - RADIUS) of |x| + |y|.
_NEAR_ENOUGH = f"bit_count(q.low ^ h.low) + bit_count(q.high ^ h.high) <= {RADIUS / (2 - RADIUS)} * (q.size + h.size) + 1e-6"


def _hot_keys(listed: DataFrame, hot: int) -> DataFrame:
    """(key, leader): partition keys that hold more than about `hot` classes, found by the classes of one hash value in 16,
    and the first_id up to which about LEADERS of their classes reach. Missing a hot key costs time, not rows."""
    seen = listed.where(F.pmod(F.xxhash64("first_id"), F.lit(16)) == 0).groupBy("key").count().where(F.col("count") > hot / 16).select("key")
    keys = materialise(seen, "history-hot")
    if keys.isEmpty():
        return keys.withColumn("leader", F.lit(0).cast("bigint"))
    sizes = listed.join(keys, "key").groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("first_id", F.array(*[F.lit(2.0**-k) for k in range(1, 31)]), 100_000).alias("p"))
    nth = F.least(F.lit(30), F.greatest(F.lit(1), F.floor(F.log2(F.col("n") / LEADERS)).cast("int")))
    return materialise(sizes.select("key", F.element_at("p", nth).alias("leader")), "history-leaders")


def _met(q: DataFrame, h: DataFrame, on: str, *more: str) -> DataFrame:
    """(q, h, first_batch of h) of different classes that meet and that the pivots do not prune, h begun before the last batch of q."""
    j = q.alias("q").join(h.alias("h"), F.expr(f"{on} and h.first_batch < q.last_batch and q.first_id <> h.first_id and {_NEAR_ENOUGH}"))
    return j.select(F.col("q.first_id").alias("q"), F.col("h.first_id").alias("h"), "h.first_batch", *more)


def _verified(pairs: DataFrame, asked: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs whose words lie within the radius."""
    both = pairs.join(asked.select(F.col("first_id").alias("q"), F.col("words").alias("qw")), "q").join(words.select(F.col("first_id").alias("h"), F.col("words").alias("hw")), "h")
    both = both.select("q", "h", "first_batch", F.split("qw", " ").alias("qw"), F.split("hw", " ").alias("hw"))
    shared = F.size(F.array_intersect("qw", "hw"))
    return both.where(shared >= (1 - RADIUS) * (F.size("qw") + F.size("hw") - shared)).select("q", "h", "first_batch")


def _near(new: DataFrame, old: DataFrame, asked: DataFrame, words: DataFrame, hot: int) -> DataFrame:
    """Pairs within the radius that share a key. Under a key that holds very many classes (a text sent again and again with
    small changes), new classes meet the earliest classes of the key first; only those that repeat none of them meet the
    others. As the smallest id is asked for, nothing is lost, and a large family of near copies does not meet itself in
    all pairs."""
    new, old = (df.withColumn("key", F.explode("keys")).drop("keys") for df in (new, old))
    keys = _hot_keys(old.select("key", "first_id"), hot)
    if keys.isEmpty():
        return _verified(_met(new, old, "q.key = h.key").distinct(), asked, words)
    plain = _met(new.join(keys, "key", "left_anti"), old.join(keys, "key", "left_anti"), "q.key = h.key")
    led = materialise(_met(new.join(keys.select("key"), "key"), old.join(keys, "key").where("first_id <= leader"), "q.key = h.key", "q.key"), "history-led")
    near = materialise(_verified(plain.unionByName(led.drop("key")).distinct(), asked, words), "history-near")
    # settled under a key: classes that repeat one of its leaders
    settled = led.join(near.select("q", "h"), ["q", "h"]).select("key", F.col("q").alias("first_id")).distinct()
    rest = new.join(keys.select("key"), "key").join(settled, ["key", "first_id"], "left_anti")
    met = _met(rest, old.join(keys, "key").where("first_id > leader"), "q.key = h.key")
    return near.unionByName(_verified(met.distinct(), asked, words))


def _near_exact(new: DataFrame, old: DataFrame, asked: DataFrame, words: DataFrame) -> DataFrame:
    """All pairs within the radius: the join is partitioned by ranges of the distance to the empty set. Sizes of a pair differ
    by a factor of 1 - RADIUS at most, so a class meets the ranges on both sides of its own; each range is cut in
    slices of both sides."""
    step = float(-np.log(1 - RADIUS))
    of = F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).cast("int")
    cut = lambda: F.pmod(F.xxhash64("first_id"), F.lit(SLICES))
    every = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    q = new.drop("keys").withColumn("bin", F.explode(F.array(of - 1, of, of + 1))).withColumn("a", cut()).withColumn("b", every)
    h = old.drop("keys").withColumn("bin", of).withColumn("b", cut()).withColumn("a", every)
    return _verified(_met(q, h, "q.bin = h.bin and q.a = h.a and q.b = h.b").distinct(), asked, words)


class HistoryIndex:
    """The stored table of history under a path: classes (words by digest), pivots and the frequencies they were made with."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._f: np.ndarray | None = None

    @classmethod
    def create(cls, rows: DataFrame, path: str) -> HistoryIndex:
        """A table of the parsed() rows of history."""
        self = cls(rows.sparkSession, path)
        self._add("classes", classes_of(rows))
        classes = self._table("classes")
        counts = np.append(word_frequencies(classes), classes.count())
        self.spark.createDataFrame([(k, int(n)) for k, n in enumerate(counts.tolist())], "bucket int, n bigint").coalesce(1).write.parquet(f"{self.path}/frequencies")
        self._add("pivots", self._pivots(classes))
        return self

    def _add(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _pivots(self, classes: DataFrame) -> DataFrame:
        if self._f is None:
            held = dict(self._table("frequencies").collect())
            self._f = np.array([held[k] for k in range(BUCKETS + 1)], np.int64)
        return pivot_rows(classes, self._f[:-1], int(self._f[-1]))

    def check(self, rows: DataFrame, hot: int = HOT, exact: bool = False, append: bool = True) -> DataFrame:
        """(first_id, record_id, exact) for the parsed() rows of new batches: the smallest id of a record of an earlier batch, in
        the table or among the rows, that each repeats; exact says that the words are the same. append adds the rows of new
        classes to the table, once however often a batch is checked.

        Ids must rise with the batch where records repeat each other; else the query fails."""
        rows = materialise(rows, "history-batch")
        stored = self._table("classes").select(*_DIGEST, F.col("first_id").alias("_id"), F.col("first_batch").alias("_batch"))
        asked = classes_of(rows).join(stored, _DIGEST, "left")
        wrong = (F.col("_id") < F.col("first_id")) != (F.col("_batch") <= F.col("first_batch"))
        first = F.when(F.col("_id").isNull() | (F.col("_id") == F.col("first_id")), F.col("first_id")).when(wrong, F.raise_error(F.lit("ids do not rise with the batch"))).otherwise(F.least("_id", "first_id"))
        asked = asked.select(*_DIGEST, first.alias("first_id"), F.least("first_batch", "_batch").alias("first_batch"), "last_batch", "words", F.col("_id").isNotNull().alias("known"))
        asked = materialise(asked, "history-asked")
        pivots = materialise(self._pivots(asked.select("first_id", "first_batch", "last_batch", "words")), "history-pivots")
        known = asked.where("known").select("first_id")
        fresh, fresh_words = pivots.join(known, "first_id", "left_anti"), asked.where("not known")
        old = self._table("pivots").unionByName(fresh).drop("last_batch")
        words = self._table("classes").select("first_id", "words").unionByName(fresh_words.select("first_id", "words"))
        new = pivots.drop("first_batch")
        near = _near_exact(new, old, asked, words) if exact else _near(new, old, asked, words, hot)
        own = asked.select(F.col("first_id").alias("q"), F.col("first_id").alias("h"), "first_batch")
        earliest = near.select("q", "h", "first_batch").unionByName(own).groupBy("q").agg(_in_order("h", "first_batch").alias("first_id"), F.min("first_batch").alias("first_batch"))
        found = rows.select("id", "batch", *_DIGEST).join(asked.select(*_DIGEST, F.col("first_id").alias("q")), _DIGEST).join(earliest, "q")
        found = found.where("first_batch < batch").select("first_id", F.col("id").alias("record_id"), (F.col("first_id") == F.col("q")).alias("exact")).distinct()
        if append:
            # what has been found is written first, as it reads the table as it was; classes come last, as they say what is stored
            found = materialise(found, "history-found")
            self._add("pivots", fresh)
            self._add("classes", fresh_words.drop("known"))
        return found


def check_new(records: DataFrame, batches: DataFrame, id_col: str = "record_id", text_col: str = "original_prompt", hot: int = HOT, exact: bool = False) -> DataFrame:
    """(first_id, record_id, exact) for each record of a batch whose state is `new` that repeats a record of an earlier
    batch; exact says that the words are the same. The records of all other batches become a HistoryIndex in the shared
    folder, against which the new ones are checked.

    Ids rise with the batch. Records without a batch, an id or a word are no cases; records of one batch are not repeats of each other; a record
    repeated by several is reported with the smallest id. Empty input gives no rows."""
    new = batches.where(F.lower(F.trim("batch_state")) == "new").select(F.col("batch_no").cast("bigint").alias("batch")).distinct()
    records = spread(records.select(records[id_col].alias("_id"), records[text_col].alias("_text"), records["batch_no"].cast("bigint").alias("_batch")))
    batch = records["_batch"]
    history = records.join(new, batch == new["batch"], "left_anti")
    arrived = records.join(new, batch == new["batch"], "left_semi")
    spark = records.sparkSession
    index = HistoryIndex.create(parsed(history, "_id", "_text", "_batch"), scratch(spark, "history-index"))
    return index.check(parsed(arrived, "_id", "_text", "_batch"), hot, exact, append=False)
