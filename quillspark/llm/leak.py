"""Evaluation items inside a corpus: which documents hold a passage of which items.

Greedy string tiling. Texts become streams of letters and digits without case, accents, spaces or punctuation, so words
broken in two and changed quote marks do not matter. A running Karp-Rabin hash over each document's stream is joined
with the hashes of all item streams (shared seeds); for each document and item that share seeds, the longest matches
are marked one after another where they overlap none marked before; the marked tiles decide by their coverage: enough
whole words in one tile, most of the item in tiles of any order, or a passage whose words between the tiles differ in
no more than the allowed part.

Items that say the same are one body; a sentence in more than COMMON bodies is common wording and left out of each,
unless little would be left of a body. Both hold over all items, however they are divided into blocks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise, spread

#: Letters of a seed: no more than four words in a row have in the items' language, which any passage that counts holds.
SEED = 12
#: Words in a row that are a leak; words of a passage that is one if no more than one word in MAX_ERROR is off.
RUN, PASSAGE, ONE_IN = 10, 18, 6
#: A sentence in more than so many different items is common wording, where more than half of an item is left without.
COMMON = 2
#: Part of an item's letters that makes a leak where tiles hold it, in whatever order.
COVER = 0.7
#: Bytes of item text a worker holds at a time, about forty times as much in memory: more is searched in further passes.
BLOCK = 4_000_000
_BASE = np.uint64(0x100000001B3)
_BITS = 22
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _hashes(stream: np.ndarray) -> np.ndarray:
    """The polynomial hash of every SEED letters of a stream of code points, by doubling."""
    if len(stream) < SEED:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, out, done = stream.astype(np.uint64), 1, None, 0
        base = _BASE
        left = SEED
        while True:
            if left & 1:
                if out is None:
                    out, done = h, width
                else:
                    n = len(stream) - done - width + 1
                    out = out[:n] * base + h[done : done + n]
                    done += width
            left >>= 1
            if not left:
                break
            h = h[:-width] * base + h[width:]
            base = base * base
            width *= 2
        return out * np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str) -> list[str]:
    """The sentences of a text as their folded words with single spaces, none empty."""
    return [x for t in re.split(r"(?<=[.!?])\s+", text) if (x := " ".join(_WORD.findall(folded(t))))]


class Items:
    """The item texts of a block as words with single spaces, with an index of their seeds."""

    def __init__(self, ids: list[str], texts: list[str]) -> None:
        self.ids, self.words = ids, [t.split() for t in texts]
        self.streams = ["".join(w) for w in self.words]
        self.starts = [np.concatenate([[0], np.cumsum([len(x) for x in w])]).astype(int).tolist() for w in self.words]
        hs = [_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in self.streams]
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        #: which item each seed is of, and where in it
        self.of = np.repeat(np.arange(len(hs)), [len(x) for x in hs])[order] if hs else np.zeros(0, int)
        self.at = np.concatenate([np.arange(len(x)) for x in hs])[order] if hs else np.zeros(0, int)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[h >> np.uint64(64 - _BITS)] = True

    def seeds(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the stream that hold a seed of some item, and the seed's first place in the index."""
        h = _hashes(stream)
        p = np.flatnonzero(self.filter[h >> np.uint64(64 - _BITS)])
        if not len(p) or not len(self.hashes):
            return p[:0], p[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[p]), len(self.hashes) - 1)
        same = self.hashes[k] == h[p]
        return p[same], k[same]


def tiles_of(doc: str, item: str, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc position, item position, length) that overlap in neither text. Seeds on one diagonal grow to
    their whole match; the longest unmarked match is marked first, and one cut by a mark is kept as far as it is free."""
    matches, reached = [], {}
    for d, i in sorted(seeds):
        if reached.get(d - i, -1) > d:
            continue
        n = 0
        most = min(len(doc) - d, len(item) - i)
        while n < most and doc[d + n] == item[i + n]:
            n += 1
        if n >= SEED:
            matches.append((n, d, i))
            reached[d - i] = d + n
    out: list[tuple[int, int, int]] = []
    matches.sort(key=lambda m: (-m[0], m[1], m[2]))
    while matches:
        n, d, i = matches.pop(0)
        out.append((d, i, n))
        left = []
        for m, e, j in matches:
            # the part of the match that is free of the new tile in both texts
            for s, t in ((d, e), (i, j)):
                if t < s + n and s < t + m:
                    head, tail = max(0, s - t), max(0, t + m - s - n)
                    if head >= tail:
                        m = head
                    else:
                        e, j, m = e + m - tail, j + m - tail, tail
            if m >= SEED:
                left.append((m, e, j))
        matches = sorted(left, key=lambda m: (-m[0], m[1], m[2]))
    return sorted(out, key=lambda t: t[1])


def _align(a: list[str], b: list[str]) -> list[tuple[bool, bool]]:
    """The cheapest way from words a to words b as steps (is a word of a, is an error); two words of one side that
    together make one of the other match."""
    n, m = len(a), len(b)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    move = [["d"] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best, how = 10**9, ""
            if i:
                best, how = cost[i - 1][j] + 1, "d"
            if j and cost[i][j - 1] + 1 < best:
                best, how = cost[i][j - 1] + 1, "i"
            if i and j:
                c = cost[i - 1][j - 1] + (a[i - 1] != b[j - 1])
                if c <= best:
                    best, how = c, "m" if a[i - 1] == b[j - 1] else "s"
                if j > 1 and a[i - 1] == b[j - 2] + b[j - 1] and cost[i - 1][j - 2] <= best:
                    best, how = cost[i - 1][j - 2], "2"
            cost[i][j], move[i][j] = best, how
    steps, i, j = [], n, m
    while i or j:
        how = move[i][j]
        steps.append((how != "i", how not in "m2"))
        i -= how != "i"
        j -= {"d": 0, "2": 2}.get(how, 1)
    return steps[::-1]


def _passage(steps: list[tuple[bool, bool]]) -> bool:
    """Whether some stretch of steps has PASSAGE words of the item and no more than one error in ONE_IN of them."""
    w, e = [0], [0]
    for word, error in steps:
        w.append(w[-1] + word)
        e.append(e[-1] + error)
    return any(
        w[y] - w[x] >= PASSAGE and (e[y] - e[x]) * ONE_IN <= w[y] - w[x]
        for x in range(len(steps))
        if not steps[x][1]
        for y in range(len(steps), x + PASSAGE - 1, -1)
    )


def _window(a: list[str], b: list[str]) -> bool:
    """Whether PASSAGE words in a row of a stand in b with so few errors that they count, by the edit distance of every such
    stretch to its nearest place in b, all stretches side by side. Where words round a passage match by chance, the one
    cheapest way through everything may run past it."""
    n, most = len(a) - PASSAGE + 1, PASSAGE // ONE_IN
    if n < 1:
        return False
    codes: dict[str, int] = {}
    code = lambda x: codes.setdefault(x, len(codes))
    stretches = np.lib.stride_tricks.sliding_window_view(np.array([code(x) for x in a]), PASSAGE)
    single, double = [code(x) for x in b], [-1, *(code(x + y) for x, y in zip(b, b[1:]))]
    last = np.zeros((len(b) + 1, n), np.int16)
    for i in range(PASSAGE):
        word = stretches[:, i]
        now = np.empty_like(last)
        now[0] = last[0] + 1
        for j in range(1, len(b) + 1):
            now[j] = np.minimum(np.minimum(last[j], now[j - 1]) + 1, last[j - 1] + (word != single[j - 1]))
            if j > 1:
                now[j] = np.where(word == double[j - 1], np.minimum(now[j], last[j - 2]), now[j])
        last = now
    return bool((last <= most).any())


def leaked(doc_words: list[str], doc_starts: list[int], doc: str, items: Items, k: int, seeds: list[tuple[int, int]]) -> bool:
    """Whether the document holds a passage of item k that counts."""
    item, words, starts = items.streams[k], items.words[k], items.starts[k]
    tiles = tiles_of(doc, item, seeds)
    if any(bisect_right(starts, i + n) - 1 - bisect_left(starts, i) >= RUN for _, i, n in tiles):
        return True
    if len(words) < PASSAGE:
        return False
    if sum(n for _, _, n in tiles) >= COVER * len(item):
        return True
    # stretches of tiles near each other in the document, aligned word by word with a margin on both sides
    tiles.sort()
    group: list[tuple[int, int, int]] = []
    for t in [*tiles, None]:
        if group and (t is None or t[0] - (group[-1][0] + group[-1][2]) > 80):
            lo, hi = group[0][0], max(d + n for d, _, n in group)
            first = min(i for _, i, _ in group)
            last = max(i + n for _, i, n in group)
            x, y = bisect_right(starts, first) - 1, bisect_left(starts, last)
            u, v = bisect_right(doc_starts, lo) - 1, bisect_left(doc_starts, hi)
            # the passage may have its only tile at either end
            margin = PASSAGE - 1
            a = words[max(0, x - margin) : y + margin]
            b = doc_words[max(0, u - margin - 2) : v + margin + 2]
            # so many of PASSAGE words in a row of the item must be there at all, which is quickly seen; then free ends: words
            # of the document beside the passage cost nothing
            there = {*b, *map("".join, zip(b, b[1:]))}
            seen = np.cumsum([0, *(w in there for w in a)])
            if len(a) >= PASSAGE and (seen[PASSAGE:] - seen[:-PASSAGE]).max() >= PASSAGE - PASSAGE // ONE_IN and (_passage(_align(a, b)) or _window(a, b)):
                return True
            group = []
        if t is not None:
            group.append(t)
    return False


def _search(items: Items, ids: pd.Series, texts: pd.Series) -> Iterator[tuple[int, str]]:
    words = [_WORD.findall(folded(t)) for t in texts]
    docs = ["".join(w) for w in words]
    ends = np.cumsum([len(d) + 1 for d in docs])
    stream = np.frombuffer("\x00".join([*docs, ""]).encode("utf-32-le"), np.uint32)
    found = defaultdict(lambda: defaultdict(list))
    at, index = items.seeds(stream)
    which = np.searchsorted(ends, at, side="right")
    for p, s, x in zip(at.tolist(), index.tolist(), which.tolist()):
        h = items.hashes[s]
        local = p - (int(ends[x - 1]) if x else 0)
        while s < len(items.at) and items.hashes[s] == h:
            found[x][int(items.of[s])].append((local, int(items.at[s])))
            s += 1
    ids = ids.tolist()
    for x, by_item in found.items():
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words[x]])]).astype(int).tolist()
        for k, seeds in by_item.items():
            if leaked(words[x], starts, docs[x], items, k, seeds):
                yield ids[x], items.ids[k]


def bodies(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, bodies). members: (item_id, body) of every item with a word; bodies: (body, words), what of each different
    text is its own. Items are the same body where their letters and digits are."""
    wanted = items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].alias("t")).where("item_id is not null and t is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "s": [sentences(t) for t in b["t"]]})

    letters = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    each = wanted.mapInPandas(cut, "item_id bigint, s array<string>").where("size(s) > 0")
    each = materialise(each.withColumn("body", F.md5(letters(F.array_join("s", "")))), "leak-items")
    whole = each.groupBy("body").agg(F.min("s").alias("s"))
    line = whole.select("body", F.posexplode("s").alias("k", "x")).withColumn("key", F.md5(letters(F.col("x")))).withColumn("n", F.size(F.split("x", " ")))
    common = line.select("body", "key").distinct().groupBy("key").count().where(F.col("count") > COMMON).select("key", F.lit(True).alias("common"))
    line = line.join(common, "key", "left").groupBy("body").agg(
        F.sort_array(F.collect_list(F.struct("k", "x", "common"))).alias("s"), F.sum("n").alias("n"), F.sum(F.when(F.col("common"), 0).otherwise(F.col("n"))).alias("own")
    )
    kept = F.filter("s", lambda x: x["common"].isNull() | (F.col("own") * 2 <= F.col("n")))
    return each.select("item_id", "body").distinct(), line.select("body", F.array_join(F.transform(kept, lambda x: x["x"]), " ").alias("words"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id), distinct: the document holds at least RUN words in a row of the item, or a passage of at least
    PASSAGE words of it with no more than one word in ONE_IN replaced, dropped or added, or COVER of its letters in tiles
    of any order.

    Case, accents, punctuation, spacing and broken words do not matter; an item given several times is found as often, and a
    sentence shared by many different items does not count. Workers hold item texts of about `block` bytes at a time;
    documents are read once for each such block, whole. Null ids or texts, and items shorter than a seed, match nothing;
    an empty table gives no rows."""
    spark = docs.sparkSession
    members, own = bodies(items, item_id, item_text)
    own = materialise(own, "leak-bodies")
    blocks = max(1, -(-(own.agg(F.sum(F.length("words"))).first()[0] or 0) // block))
    whole = spread(docs.select(docs[doc_id].cast("bigint").alias("d"), docs[doc_text].alias("t")).where("d is not null and t is not null"))
    out = None
    for b in range(blocks):
        rows = (own.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == b) if blocks > 1 else own).collect()
        rows.sort()
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = Items(*shared.value)
            for x in batches:
                for lo in range(0, len(x), 500):
                    part = x.iloc[lo : lo + 500]
                    yield pd.DataFrame(list(_search(held, part["d"], part["t"])), columns=["doc_id", "body"]).astype({"doc_id": "int64", "body": str})

        found = whole.mapInPandas(search, "doc_id bigint, body string")
        out = found if out is None else out.unionByName(found)
    return out.distinct().join(members, "body").select("doc_id", "item_id").distinct()
