"""Byte-level BPE ids by a public tokenizer file.

Ids are those of the `tokenizers` library for the same file with add_special_tokens=False: the
string of an added token in a text is that token with `added`, else ordinary text. They are computed by the `tiktoken` library from
the vocabulary in that file, which takes a quarter of the time.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

END = 0
#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes that vocabulary files are written in."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str) -> None:
        held = json.load(open(path, encoding="utf-8"))
        byte_of = _byte_of()
        special = {token["content"]: token["id"] for token in held["added_tokens"]}
        ranks = {}
        for token, number in held["model"]["vocab"].items():
            if token not in special:
                ranks[bytes(byte_of[c] for c in token)] = number
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.library = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str, added: bool = False) -> np.ndarray:
        """Ids as unsigned 16-bit numbers."""
        library = self.library
        return np.array(library.encode(text, allowed_special="all") if added else library.encode_ordinary(text), np.uint16)

    def decode(self, ids) -> str:
        return self.library.decode(list(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
