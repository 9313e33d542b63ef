"""Whole-text byte-pair tokenisation with a cache of words."""

from __future__ import annotations

import base64
import os
import zlib
from array import array

import numpy as np
import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as merge ranks, for single words.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries a worker keeps; about 200 bytes each.
CACHE = 700_000
_coders: dict[tuple[str, str], "Coder"] = {}


class Coder(dict):
    """Text -> token ids as little-endian uint32 bytes.

    The pre-tokeniser never joins what lies left and right of a single space
    between two non-space characters, so such units (" word") are encoded once
    and remembered while there is room. A text with other white space beside a
    space, or with the string of one of the tokenizer's own special tokens, is
    encoded in one piece by the tokenizer's plain call.
    """

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})._core_bpe
        self.piece, self.text = core.encode_single_piece, core.encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        bare = unit[1:] if unit[0] == " " else unit
        if bare.isalpha():
            got = array("I", self.piece(unit.encode()))
        elif bare[-1] in ".,!" and bare[:-1].isalpha():
            got = array("I", self.piece(unit[:-1].encode()) + self.piece(unit[-1].encode()))
        else:
            got = array("I", self.text(unit))
        got = got.tobytes()
        if len(self) < CACHE and len(unit) <= 64:
            self[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        if any(map(text.__contains__, self.special)):
            return self.whole(text)
        units = text.split(" ")
        for u in units:
            if not u or u[0].isspace() or u[-1].isspace():
                return self.whole(text) if text else b""
        units[1:] = [" " + u for u in units[1:]]
        return b"".join(map(self.__getitem__, units))


def coder(path: str = TOKENIZER, ranks: str = RANKS) -> Coder:
    if (path, ranks) not in _coders:
        _coders[path, ranks] = Coder(path, ranks)
    return _coders[path, ranks]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
