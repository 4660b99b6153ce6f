"""Byte-level BPE ids, the same as the `tokenizers` library gives for the vocabulary's JSON file."""

from __future__ import annotations

import functools
import json

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable alphabet of byte-level BPE: visible Latin-1 stands for itself, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(text) of one text. Most texts take the fast engine over the same merge ranks; a text that holds
    the string of a special token, or that the fast engine refuses, takes `tokenizers` itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.pattern = public_tokenizers.PATTERN
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except BaseException as e:  # the engine's own panics are no subclass of Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.asarray(self.reference.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
