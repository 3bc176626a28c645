"""Token ids of whole texts with the ``tokenizers`` library, in Python workers.

A byte-level BPE encodes each pre-token on its own, so a worker encodes each distinct
pre-token once with the library's model and keeps the result in a bounded cache; texts
are then joins of cached byte strings. Tokenizers of another build go to the library's
batch encoder. Both give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Distinct pre-tokens that a worker keeps; at the bound the cache starts anew.
CACHE_WORDS = 400_000

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern over the first 256 code points, where the standard library's bitmap classes are far faster.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_LATIN = rf" ?[{_L}]++|'(?:[stmd]|re|ve|ll)| ?[{_N}]++| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]++"
_find: list = []


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; joined they are the text."""
    if not _find:
        import regex

        _find[:] = [re.compile(_LATIN).findall, regex.compile(PATTERN).findall]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _find[1](text)
    return _find[0](text)


def byte_letters() -> dict[int, int]:
    """Byte -> code point that stands for it in a byte-level vocabulary: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return dict(zip(own, own)) | {b: 256 + i for i, b in enumerate(rest)}


class _Words(dict):
    """Pre-token -> its ids as bytes."""

    def __init__(self, model, code: str) -> None:
        super().__init__()
        self.model, self.code, self.letters = model, code, byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Encoder of one tokenizer file. ``special_as_text``: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_word = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])]
        self.words = _Words(self.tokenizer.model, self.code)

    def token_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian integers of ``dtype``; null counts as empty."""
        if not text:
            return b""
        if not self.by_word or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, pretokens(text)))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.token_bytes(text), self.dtype)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder of ``path``, loaded once."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]


def public_path(name: str) -> str:
    """Place of a public vocabulary file; the package is looked up here only, so operators work with any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
