"""Reading public vocabulary files, and encoding single pre-tokens by their ranks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

from codestrata.llm import pretok

#: Fixed value: the special string that the JSON vocabulary adds, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a .tiktoken file: a base64 token and a number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def load_json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE .json file, whose characters stand for bytes.

    Its ids follow the order of its merges, so they serve as ranks as well. Special tokens are left out.
    """
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # Printable bytes stand for themselves; the others, in order, for the characters from 256 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def word_encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encodes a string as one pre-token: merges by rank, without splitting it first."""
    import tiktoken

    return tiktoken.Encoding("single", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_STORES: dict[bytes, pretok.WordIds] = {}


def shared_store(broadcast) -> pretok.WordIds:
    """This worker's store of encoded words for a broadcast vocabulary; it lives as long as the worker."""
    digest = hashlib.sha256()
    for token, rank in broadcast.value.items():
        digest.update(b"%d %d " % (rank, len(token)) + token)
    key = digest.digest()
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = pretok.WordIds(word_encoder(broadcast.value))
    return _STORES[key]
