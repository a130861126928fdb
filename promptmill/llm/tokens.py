"""Tokenizers from public vocabulary files. The path is a parameter; files are read where the worker runs."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the number of bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
