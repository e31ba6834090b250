"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: The vocabulary file, as base64 token and rank a line, and the pattern that cuts text into the words it encodes.
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = RANKS_FILE):
    """The tokenizer of a file; one per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_sizes(path: str = RANKS_FILE) -> np.ndarray:
    """The bytes of each token."""
    with open(path, "rb") as lines:
        by = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, lines)}
    out = np.zeros(max(by) + 1, np.int64)
    out[list(by)] = list(by.values())
    return out


def count(text: str | None, path: str = RANKS_FILE) -> int:
    """Tokens of a text; 0 of null. Very long runs without white space are encoded in parts of 20,000 characters, so that
    time stays in proportion to length; the count of such a run may differ by a token a part."""
    return sum(len(encoder(path).encode_ordinary(p)) for p in parts(text)) if text else 0


def parts(text: str, most: int = 20_000) -> list[str]:
    """A text cut where white space follows a word so that no part is much longer than most; a longer run without white
    space is cut at most."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        k = text.rfind(" ", at + 1, cut)
        if k > at and not text[k - 1].isspace():
            cut = k
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]
