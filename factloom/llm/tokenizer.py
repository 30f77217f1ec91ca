"""Public byte-level tokenizers, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import functools
import os

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def folder() -> str:
    """TOKENIZER_DIR, or the default folder."""
    return os.environ.get("TOKENIZER_DIR", DEFAULT_FOLDER)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str):
    """One encoder a Python worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def splitter():
    import regex

    return regex.compile(PATTERN)


def vocabulary(name: str = BYTE_BPE, tokenizer_dir: str | None = None) -> str:
    return os.path.join(tokenizer_dir or folder(), name)
