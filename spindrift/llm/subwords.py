"""Ids of a public byte-level BPE, the same as the ``tokenizers`` library gives for its JSON file.

``byte_bpe_50k.tiktoken`` holds the vocabulary of ``byte_bpe_50k.json`` as ranks; the rank
encoder gives the same ids several times faster (the tests compare both).  Strings of special
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(path: str, size: int | None = None):
    """path: a rank file.  size: only the first so many ranks, that is fewer merges."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if size:
        ranks = {k: v for k, v in ranks.items() if v < size}
    return tiktoken.Encoding(f"ranks-{size}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str, size: int | None = None) -> np.ndarray:
    """Ids of the whole text as uint32; null counts as empty."""
    return np.asarray(encoder(path, size).encode_to_numpy(text), dtype="<u4") if text else np.zeros(0, "<u4")
