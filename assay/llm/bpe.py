"""Byte-level BPE encoders for executor tasks.

``encoder(path)`` reads a ``tokenizers`` JSON file.  A plain byte-level BPE without normaliser (checked in the file)
is run by the rank-based engine, built from the vocabulary in that same file: it gives the same ids several times
faster.  Every ``AUDIT``-th text is encoded by ``tokenizers`` as well, and a difference raises.  Any other file is run
by ``tokenizers`` alone.  ``.model`` files are run by ``sentencepiece``.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np

#: One text in this many is encoded by both engines and compared.
AUDIT = 512

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE with ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def version(path: str) -> str:
    """Digest of the tokenizer file: counts stored under another digest are never used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves,
    the others follow from 256 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _rank_engine(path: str):
    spec = json.loads(open(path, encoding="utf-8").read())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens") or []
    plain = (model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout")
             and not model.get("byte_fallback") and not model.get("ignore_merges")
             and not any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") or a.get("normalized") for a in added))
    if not plain:
        return None
    import tiktoken
    byte = _byte_of_char()
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(byte[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in special}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """``ids(text)``: numpy array of token ids, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.seen = 0
        self.fast = self.slow = self.piece = None
        if path.endswith(".model"):
            import sentencepiece
            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(path)
            self.slow.no_truncation()
            self.slow.no_padding()
            self.fast = _rank_engine(path)

    def ids(self, text: str) -> np.ndarray:
        if self.piece is not None:
            return np.asarray(self.piece.encode(text), np.uint32)
        if self.fast is None:
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        out = self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        self.seen += 1
        if self.seen % AUDIT == 1:
            want = np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
            if not np.array_equal(out, want):
                raise ValueError("the rank engine and the tokenizer file disagree")
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def resolve(name: str) -> str:
    """Path of a public tokenizer by file name; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
