"""Splitting texts over a size limit into pieces at natural boundaries, with an overlap.

The tokenizer runs once over a text and gives a string with one letter a token, the strongest boundary at the token's
end, and the characters of each token. Bounded-quantifier regular expressions over that string, with alternatives in
order of boundary strength, cut it into runs of at most the limit; a run without any boundary falls back to characters.
Array functions turn runs into offsets, look back for the overlap and cut the text, all in time in proportion to its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

from .tokens import RANKS_FILE, encoder, parts, token_sizes

#: Boundary letters from strong to weak: paragraph, line, sentence, clause, word, character; x is inside a character.
STRENGTHS = "plscwt"
#: Tokens of the longest character; the most limits of one call, each of which is an expression of the plan.
LEAST, MOST_LIMITS = 4, 1_000
_LINE_ENDS = re.compile(r"(?:\r\n|\r|\n)\s*")
_P, _L, _S, _C, _W, _T, _X = range(7)
_LETTERS = np.frombuffer((STRENGTHS + "x").encode(), np.uint8)


def _class(of: str) -> np.ndarray:
    """A table over the first 65,536 code points."""
    out = np.zeros(1 << 16, bool)
    out[[ord(c) for c in of]] = True
    return out


_SPACE = np.array([chr(c).isspace() for c in range(1 << 16)])
_ALNUM = np.array([chr(c).isalnum() for c in range(1 << 16)])
_STOP, _CLOSE, _PAUSE, _UNDERSCORE = _class(".!?…"), _class("\"'”’»)]"), _class(",;:"), _class("_")
_CJK_STOP, _CJK_CLOSE, _CJK_PAUSE = _class("。！？"), _class("」』）"), _class("、，；：")


def _strengths(text: str, codes: np.ndarray) -> np.ndarray:
    """For each number of characters, how strong a boundary lies after so many."""
    out = np.full(len(codes) + 1, _T, np.uint8)
    c = np.minimum(codes, 0xFFFF)
    last, following = c[:-1], c[1:]
    space = _SPACE[following]
    inner = out[1:-1]
    inner[(space & ~_SPACE[last]) | (_UNDERSCORE[last] & _ALNUM[following])] = _W
    inner[(_PAUSE[last] & space) | _CJK_PAUSE[last]] = _C
    stop, cjk = _STOP[c], _CJK_STOP[c]
    for _ in range(2):
        # closing marks after the stop belong to the sentence
        stop[1:] |= stop[:-1] & _CLOSE[c[1:]]
        cjk[1:] |= cjk[:-1] & _CJK_CLOSE[c[1:]]
    inner[stop[:-1] & space] = _S
    inner[cjk[:-1] & ~(cjk[1:])] = _S
    for m in _LINE_ENDS.finditer(text):
        lines = m[0].count("\n") or m[0].count("\r")
        out[m.end()] = _P if lines > 1 else _L
    return out


def boundaries(text: str, ranks: str = RANKS_FILE) -> tuple[str, np.ndarray, np.ndarray | None]:
    """A letter for each token of the text, the number of bytes up to each token's end, and the number of characters,
    None where it is the same. A token that ends within a character counts to the character's end."""
    sizes, encode = token_sizes(ranks), encoder(ranks).encode_ordinary
    ids = [t for part in parts(text) for t in encode(part)]
    ends = np.cumsum(sizes[ids])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    chars = inside = None
    if not text.isascii():
        begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        inside = ~np.append(begins, True)[ends]
        chars = np.append(0, np.cumsum(begins))[ends]
        ends = np.append(np.flatnonzero(begins), len(begins))[chars]
    marks = _strengths(text, codes)[ends if chars is None else chars]
    if inside is not None:
        marks[inside] = _X
    if len(marks):
        marks[-1] = _P
    return _LETTERS[marks].tobytes().decode(), ends.astype(np.int32), None if chars is None else chars.astype(np.int32)


def pattern(most: int) -> str:
    """Runs of at most `most` letters: what is left if it fits; else up to the strongest boundary in the run's second
    half, else up to any boundary, else to the end of a character, else as it comes."""
    half = max(0, most // 2 - 1)
    strong = [f".{{{half},{most - 1}}}{b}" for b in STRENGTHS[:-1]]
    weak = [f".{{0,{most - 1}}}[{STRENGTHS[:-1]}]"] if half else []
    return "|".join([f".{{1,{most}}}$", *strong, *weak, f".{{0,{most - 1}}}t", f".{{1,{most}}}"])


def limits_of(limits: DataFrame) -> list[tuple[str, int, int]]:
    """(name, most, overlap) of each limit. A character has up to LEAST tokens, so that is the least limit, and an overlap
    leaves so much of a piece for new text."""
    got = limits.select("limit_name", "max_tokens", "overlap_tokens").where("limit_name is not null and max_tokens is not null").distinct().limit(MOST_LIMITS + 1).collect()
    if len(got) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits: each is an expression of its own, so call once for each part of the table")
    if small := [r[0] for r in got if r[1] < LEAST]:
        raise ValueError(f"limits below {LEAST} tokens cannot hold every character: {small}")
    return sorted((r[0], int(r[1]), max(0, min(int(r[2] or 0), int(r[1]) // 2, int(r[1]) - LEAST))) for r in got)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrays of integers as one list column, None as null, without turning their elements into objects."""
    sizes = np.array([0 if x is None else len(x) for x in arrays], np.int64)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    values = pa.array(np.concatenate([x for x in arrays if x is not None]) if sizes.any() else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in arrays]))


#: The sum of sizes up to and with each element, by doubling: each of the log2(n) rounds is one pass over the array, where
#: an array that grows by an element at a time would be copied for each.
_SUMS = """aggregate(sequence(0, cast(ceil(log2(greatest(size(r.sizes), 2))) as int) - 1), r.sizes,
    (acc, k) -> transform(acc, (x, i) -> x + if(i >= shiftleft(1, k), get(acc, i - shiftleft(1, k)), 0)))"""


def pieces(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS_FILE) -> DataFrame:
    """(limit_name, doc_id, piece_no, start, end, overlap_chars, tokens, boundary, piece) for each document of more tokens than
    a limit: its pieces in order, of at most max_tokens tokens. piece is text[start:end] in characters; each piece but the
    first begins overlap_chars before the last one's end, at most overlap_tokens tokens, fewer where the overlap would
    begin within a word that can be left out whole or within a character. boundary is the letter of STRENGTHS on which
    the piece ends.

    Without the overlaps the pieces make up the text exactly. Null ids and null or short texts give no rows, nor does a
    limit without max_tokens or name; a limit below LEAST raises. An overlap of half the limit or more counts as half.
    Equal rows of documents give equal rows of pieces. Time is in proportion to the length of a text."""
    wanted = limits_of(limits)
    d = spread(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null and text <> ''"))

    @F.arrow_udf("marks string, ends array<int>, chars array<int>")
    def marked(texts: pa.Array) -> pa.Array:
        got = [boundaries(t.as_py(), ranks) for t in texts]
        return pa.StructArray.from_arrays([pa.array([m for m, _, _ in got], pa.string()), _lists([e for _, e, _ in got]), _lists([c for _, _, c in got])], ["marks", "ends", "chars"])

    # so marked, the optimiser runs the function once and not for each use of its result
    once = marked.asNondeterministic()
    least = min((m for _, m, _ in wanted), default=0)
    m = d.select("doc_id", F.col("text").cast("binary").alias("bytes"), once("text").alias("b"))
    # text and letters as bytes: a part of them is cut out in place, where a string is walked through from its start
    m = m.select("doc_id", "bytes", "b.marks", F.col("b.marks").cast("binary").alias("letters"), "b.ends", "b.chars").where(F.length("marks") > least)
    cut = []
    for name, most, overlap in wanted:
        runs = F.regexp_extract_all("marks", F.lit(pattern(most - overlap)), 0)
        sizes = F.transform(runs, lambda r: F.length(r))
        cut.append(F.when(F.length("marks") > most, F.struct(F.lit(name).alias("limit_name"), F.lit(overlap).alias("overlap"), sizes.alias("sizes"))))
    if not cut:
        none = m.where("false").select(F.lit("").alias("limit_name"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.lit(0).alias("end"))
        return none.selectExpr("*", "0 as overlap_chars", "0 as tokens", "'' as boundary", "'' as piece")
    each = m.select("doc_id", "bytes", "letters", "ends", "chars", F.explode(F.filter(F.array(*cut), lambda r: r.isNotNull())).alias("r"))
    each = each.select("doc_id", "bytes", "letters", "ends", "chars", "r.limit_name", "r.overlap", F.expr(_SUMS).alias("lasts"))
    word = STRENGTHS[:-1]
    # the pieces of a text are worked out side by side as arrays, and only the finished ones make rows: no row holds a
    # copy of the text. `before` is what may begin a piece: the letters of the overlap and of the token ahead of it
    steps = f"""
        transform(
          transform(
            transform(
              transform(lasts, (last, i) -> struct(i + 1 as no, if(i = 0, 0, lasts[i - 1]) as first, last)),
              p -> struct(p.no, p.first, p.last, least(p.first, overlap) as reach,
                          cast(substring(letters, p.first - least(p.first, overlap), least(p.first, overlap) + 1) as string) as before)),
            p -> struct(p.no, p.first, p.last, p.reach, length(regexp_extract(p.before, '^([^{word}]*[{word}])', 1)) - 1 as skip,
                        length(regexp_extract(p.before, '^(x*[^x])', 1)) - 1 as whole)),
          p -> struct(p.no, p.first, p.last, case when p.first <= p.reach then p.reach when p.skip >= 0 and p.skip < p.reach then p.reach - p.skip
                      when p.whole >= 0 then p.reach - p.whole else 0 end as lead))
    """
    char = lambda k: f"if({k} > 0, get(coalesce(chars, ends), {k} - 1), 0)"
    byte = lambda k: f"if({k} > 0, get(ends, {k} - 1), 0)"
    # letters and text as variables, as each use of a binary column copies it
    finished = f"""
        flatten(transform(array(struct(letters as letters, bytes as bytes)), held -> transform({steps.replace("letters", "held.letters")}, p -> struct(
          p.no as piece_no, {char("p.first - p.lead")} as start, {char("p.last")} as end, {char("p.first")} - {char("p.first - p.lead")} as overlap_chars,
          p.last - p.first + p.lead as tokens, cast(substring(held.letters, p.last, 1) as string) as boundary,
          cast(substring(held.bytes, {byte("p.first - p.lead")} + 1, {byte("p.last")} - {byte("p.first - p.lead")}) as string) as piece))))
    """
    return each.select("limit_name", "doc_id", F.explode(F.expr(finished)).alias("p")).select("limit_name", "doc_id", "p.*")
