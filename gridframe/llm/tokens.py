"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary is a `tokenizers` JSON file.  Where its ids are in merge order (each id is then its own rank), tiktoken
computes the same ids several times faster; any other file, and a text that holds an added token, is run by `tokenizers`
itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.path, self.slow, self.fast, self.added = path, None, None, ()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        #: One more than the largest id.
        known = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
        self.size = max([-1, *known, *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
        if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            byte = _bytes_of()
            self.added = tuple(t["content"] for t in spec.get("added_tokens", []))
            ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in self.added}
            self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> list[int]:
        """The ids by `tokenizers`."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.exact(text), np.uint32)
        return np.asarray(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
