"""Byte-pair ids of whole texts."""

from __future__ import annotations

import json
import os
import re

import numpy as np


def default_vocabulary(name: str) -> str:
    """Path of a public vocabulary file by name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class BytePairEncoder:
    """Ids that ``tokenizers`` gives with a byte-level BPE file, special tokens
    not added.

    ``tiktoken`` gives the same ids from the same file's vocabulary and pattern
    at a fifth of the cost. It takes every text whose white space is blanks and
    line ends, in runs below 1,000, and that spells no special token; any other
    text, which the two might read differently, goes to the tokenizer itself. A sample is
    compared when a worker starts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = _byte_of_character()
        ranks = {bytes(of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.unlike = re.compile("|".join([r"[^\S \n]", r"\s{1000}", *(re.escape(x) for x in sorted(special))]))
        self.largest = max([*spec["model"]["vocab"].values(), *special.values()])
        sample = "It's a token = \"0af3\", déjà  vu;\n\n 12½ Äpfel!? <x> ß "
        if self.fast.encode(sample, disallowed_special=()) != self.encoder.encode(sample, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level vocabulary whose ids follow its merges")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            ids = self.encoder.encode(t, add_special_tokens=False).ids if self.unlike.search(t) else self.fast.encode_to_numpy(t, disallowed_special=())
            out.append(np.asarray(ids, "<u4").tobytes())
        return out
