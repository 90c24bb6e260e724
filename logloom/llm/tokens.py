"""Token ids and token lengths from tokenizer files, inside tasks."""

from __future__ import annotations

import functools
import json

import numpy as np

# Fixed values of byte-level BPE: how its regex cuts text, and which bytes stand for themselves in its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))


def default_tokenizer() -> str:
    """The public byte-level BPE vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelBpe:
    """Ids as the tokenizers library gives them for a plain byte-level BPE file, by tiktoken, which is several times faster.

    A token is a run of bytes of the text, so its length gives its place. Strings of added tokens in a text are those tokens.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        shape = made["pre_tokenizer"] or {}
        plain = made["model"]["type"] == "BPE" and shape.get("type") == "ByteLevel" and shape.get("use_regex", True)
        if not plain or shape.get("add_prefix_space") or made["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        letters = {chr(b): b for part in PLAIN_BYTES for b in part}
        others = [b for b in range(256) if chr(b) not in letters]
        letters |= {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.lengths[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, allowed_special=self.special)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteLevelBpe:
    return ByteLevelBpe(path)
