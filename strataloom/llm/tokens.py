"""Counting tokens with a public byte-level BPE, by tiktoken.

The vocabulary file is a parameter; executors read it from the same path.
"""

from __future__ import annotations

import base64
import functools

import numpy as np


def default_path() -> str:
    """The installed vocabulary that counts are taken with unless a path is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoding(path: str):
    """The tokenizer of a rank file, once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


@functools.cache
def _lengths(path: str) -> np.ndarray:
    enc = encoding(path)
    return np.array([len(b) for b in sorted(enc.token_byte_values(), key=enc.encode_single_token)], dtype=np.int64)


def starts(text: str, ids: list[int], path: str) -> list[int]:
    """The character at, or within, which each token of a text starts."""
    lengths = _lengths(path)[np.asarray(ids, dtype=np.int64)]
    at = np.cumsum(lengths) - lengths
    if text.isascii():
        return at.tolist()
    # as the tokenizer does, with lone surrogates replaced
    raw = np.frombuffer(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8"), dtype=np.uint8)
    heads = (raw & 0xC0) != 0x80
    return (np.cumsum(heads)[at] - 1).tolist()
