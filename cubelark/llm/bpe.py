"""Byte-pair encoding by public rank or merge files."""

from __future__ import annotations

import base64
import json
import unicodedata
from array import array

import public_tokenizers


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and what no class is sure of, as ranges of a regular expression.

    Sure are letters and numbers of the basic plane that Unicode 3.2 had already, and what is
    neither; libraries may know later letters or not, and may know some that are unassigned here.
    Of the other planes only the pictographs are sure, which keeps the sets fast.
    """
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "?": []}
    for code in range(0x10000):
        category = unicodedata.category(chr(code))
        kind = category[0] if category[0] in "LN" else "?" if category in ("Cn", "Cs") else None
        if kind in ("L", "N") and unicodedata.ucd_3_2_0.category(chr(code))[0] != kind:
            kind = "?"
        if kind and ranges[kind] and ranges[kind][-1][1] == code - 1:
            ranges[kind][-1][1] = code
        elif kind:
            ranges[kind].append([code, code])
    ranges["?"] += [[0x10000, 0x1EFFF], [0x1F100, 0x1F10C], [0x1FB00, 0x10FFFF]]
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in ("L", "N", "?"))


#: Letters, numbers and unsure code points, for the pre-token pattern's \p{L} and \p{N}; and its white space.
LETTERS, NUMBERS, UNSURE = _classes()
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in .json vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken or a byte-level .json vocabulary."""
    if path.endswith(".json"):
        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def load_added(path: str) -> dict[str, int]:
    """Added tokens of a .json vocabulary and their ids; a .tiktoken file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens that are not plain strings: {path}")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers in a row."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=load_added(path))

    def encode(self, text: str, added_tokens: bool = False) -> bytes:
        """The ids of `text`, each pre-token encoded on its own.

        With `added_tokens` the text is first split at the vocabulary's added tokens, each of
        which is one id, as the tokenizers library does; without, they are text like any other.
        """
        ids = self.library.encode(text, allowed_special="all") if added_tokens else self.library.encode_ordinary(text)
        return array("I", ids).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the ids' tokens in a row."""
        return self.library.decode_bytes(memoryview(ids).cast("I").tolist()) if ids else b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
