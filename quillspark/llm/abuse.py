"""Abusive, hateful and sexual content: a score for every text, and rates per source.

Compression-distance classification. zstandard dictionaries are made of the windows of labelled texts, one of ordinary
text and one of each category; a window of a text is as near to a category as the share of bytes that the category's
dictionary saves over the ordinary one when the window is compressed. The least saving that counts is calibrated for
each category on labelled texts that its dictionary has not seen. Every window is scored so, and nothing else decides.
Disguised spellings are undone first.

The dictionaries hold the mined windows themselves, indexed at every byte. zstandard's own training keeps only what
recurs most in its samples, and finds less.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

from .spelling import phrases

CATEGORIES = ("abusive", "hateful", "sexual")
ORDINARY = "none"
#: At most this many labelled texts are fitted on: a sample by hash of the text where there are more.
MAX_LABELLED = 20_000
#: Words of a window and its step, for phrases of more than LONG words.
WINDOW, STEP, LONG = 7, 2, 9
#: Letters of a match: shorter ones let a rare name save a byte or two by chance.
MATCH = 6
#: What a wrongly flagged text weighs against a missed one: labelled samples hold far more cases than the corpus does.
WRONG = 5
#: Phrases whose result a worker keeps.
_KEPT = 400_000


def windows(phrase: str) -> list[str]:
    """The phrase, or where it is long windows that cover all its words."""
    w = phrase.split()
    if len(w) <= LONG:
        return [phrase]
    starts = [*range(0, len(w) - WINDOW, STEP), len(w) - WINDOW]
    return [" ".join(w[i : i + WINDOW]) for i in starts]


def _grams(window: str) -> list[str]:
    w = window.split()
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def _mined(texts: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    """Windows by category out of (category, windows) of labelled texts.

    A label is of a whole text, most of which is ordinary. A window is a category's if it holds a word or pair of words
    found in enough texts, most of them of the category, and is labelled so more often than ordinary."""
    held: dict[str, Counter] = defaultdict(Counter)
    for category, own in texts:
        held[category].update({g for w in own for g in _grams(w)})
    total = Counter()
    for c in held.values():
        total.update(c)
    share = Counter(c for c, _ in texts)
    least = {c: max(2, share[c] // 120) for c in share}
    marks = {c: {g for g, n in held[c].items() if n >= least[c] and n >= 0.7 * total[g]} for c in CATEGORIES}
    every = set().union(*marks.values())
    harmless = {g for g, n in held[ORDINARY].items() if " " in g and n >= 3 and n >= 0.9 * total[g]}
    votes: dict[str, Counter] = defaultdict(Counter)
    for category, own in texts:
        for w in set(own):
            if category == ORDINARY:
                # a harmless use of a marked word has pairs of words of its own; a window without is a wrong label
                if not any(g in every for g in _grams(w)) or any(g in harmless for g in _grams(w)):
                    votes[w][ORDINARY] += 1
            elif core := _core(w, marks[category]):
                votes[core][category] += 1
    out: dict[str, list[str]] = {c: [] for c in (*CATEGORIES, ORDINARY)}
    for w, v in votes.items():
        out[max(v, key=lambda c: (v[c], c != ORDINARY))].append(w)
    # nearest the end of the ordinary dictionary: what many texts hold, and what shares words with the categories
    close = {g for c in CATEGORIES for w in out[c] for g in w.split()}
    shared = {w: sum(g in close for g in w.split()) / (1 + w.count(" ")) for w in out[ORDINARY]}
    out[ORDINARY].sort(key=lambda w: (shared[w] > 0.5, votes[w].total(), w))
    return out


def _core(window: str, marks: set[str]) -> str:
    """The words of a window from the first to the last that bear a mark, and those between; empty if none does."""
    w = window.split()
    at = {k for k, x in enumerate(w) if x in marks} | {j for k in range(len(w) - 1) if f"{w[k]} {w[k + 1]}" in marks for j in (k, k + 1)}
    return " ".join(w[min(at) : max(at) + 1]) if at else ""


class Compressor:
    """Bytes of a text compressed with a dictionary of samples. The dictionary is the samples themselves, whole, indexed at
    every byte: the fast levels index every third byte and miss most of what a short window shares."""

    def __init__(self, samples: list[str]) -> None:
        content = "\n".join(samples).encode()
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own = zstandard.ZstdCompressionParameters.from_level(
            13, source_size=64, dict_size=max(len(content), 1 << 20), strategy=zstandard.STRATEGY_BTLAZY2, min_match=MATCH,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        made.precompute_compress(compression_params=own)
        self._c = zstandard.ZstdCompressor(dict_data=made, compression_params=own)

    def size(self, data: bytes) -> int:
        return len(self._c.compress(data))


class Model:
    """Dictionaries and the least saving that counts, by category. Holds samples only, so that it can be sent."""

    def __init__(self, samples: dict[str, list[str]], thresholds: dict[str, float]) -> None:
        self.samples, self.thresholds = samples, thresholds
        self._by: dict[str, Compressor] | None = None
        self._kept: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self):
        return self.samples, self.thresholds

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def saving(self, window: str) -> tuple[str, int] | None:
        """The category that saves most of the bytes of the ordinary dictionary, and their share in thousandths; None if
        none saves any."""
        if window in self._kept:
            return self._kept[window]
        if self._by is None:
            # a category's dictionary is the ordinary one with the category's windows after it, so that only they save
            ordinary = self.samples.get(ORDINARY, [])
            self._by = {c: Compressor([*(ordinary if c != ORDINARY else []), *s]) for c, s in self.samples.items() if s}
        data = window.encode()
        plain = self._by[ORDINARY].size(data) if ORDINARY in self._by else len(data)
        best = max(((plain - self._by[c].size(data), c) for c in CATEGORIES if c in self._by), default=(0, ""))
        if len(self._kept) >= _KEPT:
            self._kept.clear()
        out = self._kept[window] = (best[1], 1000 * best[0] // plain) if best[0] > 0 else None
        return out

    def scores(self, text: str | None) -> dict[str, tuple[int, str]]:
        """By category the largest share of bytes saved on a window of the text, in thousandths, and the window."""
        out: dict[str, tuple[int, str]] = {}
        for p in phrases(text) if text else ():
            for w in windows(p):
                s = self.saving(w)
                if s and s[1] > out.get(s[0], (0, ""))[0]:
                    out[s[0]] = (s[1], w)
        return out


def _best_threshold(scored: list[tuple[int, bool]]) -> float:
    """The least score at which F1 is highest, where a wrong one weighs as WRONG missed ones; among equal ones the middle. With
    no positives nothing passes."""
    scored.sort(key=lambda x: -x[0])
    positives = sum(y for _, y in scored)
    if not positives:
        return math.inf
    best, at, hit = 0.0, math.inf, 0
    for k, (s, y) in enumerate(scored):
        hit += y
        following = scored[k + 1][0] if k + 1 < len(scored) else 0
        if following < s and s > 0:
            f = 2 * hit / (hit + WRONG * (k + 1 - hit) + positives)
            if f > best:
                best, at = f, (s + max(following, 0)) / 2
    return at


def fit(labelled: list[tuple[str, str]], folds: int = 3) -> Model:
    """A model of (category, text). Categories other than CATEGORIES count as ordinary. Each threshold is chosen on texts
    scored by dictionaries made without them."""
    texts = sorted({(c if c in CATEGORIES else ORDINARY, tuple(w for p in phrases(t) for w in windows(p))) for c, t in labelled if t})
    fold = [int(hashlib.md5("|".join(w).encode()).hexdigest(), 16) % folds for _, w in texts]
    scored: dict[str, list[tuple[int, bool]]] = defaultdict(list)
    for k in range(folds):
        held = Model(_mined([t for t, f in zip(texts, fold) if f != k]), {})
        for (category, own), f in zip(texts, fold):
            if f == k:
                best: dict[str, int] = {}
                for w in own:
                    if s := held.saving(w):
                        best[s[0]] = max(best.get(s[0], 0), s[1])
                for c in CATEGORIES:
                    scored[c].append((best.get(c, 0), c == category))
    return Model(_mined(texts), {c: _best_threshold(scored[c]) for c in CATEGORIES})


def fit_on(labels: DataFrame, texts: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of labels (table_name, record_id, category) joined with texts (table_name, record_id, text): of at most
    max_labelled labels, by hash, and the different texts that stand under their ids."""
    known = labels.select("table_name", "record_id", F.lower(F.trim("category")).alias("category")).where("category is not null").distinct()
    rows = (
        texts.where("text is not null").select("table_name", "record_id", "text").join(F.broadcast(known.orderBy(F.xxhash64("table_name", "record_id")).limit(max_labelled)), ["table_name", "record_id"])
        .select("category", "text").distinct().collect()
    )
    return fit(sorted((r[0], r[1]) for r in rows))


def score(texts: DataFrame, model: Model) -> DataFrame:
    """(table_name, record_id, source, category, score, window, flagged) for each text and each category of which some window is
    nearer than ordinary text; score is the share of bytes saved, in thousandths. Null and blank texts score nothing. All windows of the whole
    text count, however long."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for b in batches:
            rows = []
            for name, i, source, text in b.itertuples(index=False):
                for c, (s, w) in held.scores(text).items():
                    rows.append((name, i, source, c, s, w, s >= held.thresholds[c]))
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "source", "category", "score", "window", "flagged"])

    cols = spread(texts.select("table_name", F.col("record_id").cast("bigint").alias("record_id"), "source", "text").where("text is not null"))
    return cols.mapInPandas(run, "table_name string, record_id bigint, source string, category string, score int, window string, flagged boolean")


def rates(texts: DataFrame, scored: DataFrame) -> DataFrame:
    """(table_name, source, texts, abusive, hateful, sexual, flagged, rate) per table and source: texts that are not
    null or blank, those flagged by category, those flagged at all and their share."""
    flags = scored.where("flagged").groupBy("table_name", "record_id").agg(*[F.max((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES])
    whole = texts.where(F.col("text").rlike(r"\S")).select("table_name", "record_id", "source").join(flags, ["table_name", "record_id"], "left")
    any_of = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in CATEGORIES])
    out = whole.groupBy("table_name", "source").agg(
        F.count("*").alias("texts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CATEGORIES], F.sum(any_of).alias("flagged")
    )
    return out.withColumn("rate", F.col("flagged") / F.col("texts"))
