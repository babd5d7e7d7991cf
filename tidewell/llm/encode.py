"""Token ids of whole texts by the tokenizers library, with a cache of pre-tokens.

A byte-level tokenizer cuts a text into pre-tokens by a published pattern and
merges inside each one only, so a text's ids are its pre-tokens' ids in order,
and a pre-token that was seen before needs no second merge.

For texts of ASCII and Latin-1 characters the pattern's classes can be written
out, so Python cuts them the same way and hands each new pre-token to the
library's model. Any other text is encoded whole by the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The byte-level pattern over Latin-1; letters come first, which can't change a match.
PRETOKEN = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\t-\r {_L}{_N}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
OUTSIDE = re.compile("[^\t-\r -~¡-ÿ]")
#: Longer pre-tokens are merged each time, so that junk can't fill the cache.
CACHED_CHARS = 48

_encoders: dict[str, "TextEncoder"] = {}


def _byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class _Ids(dict):
    """Little-endian unsigned 32-bit ids by pre-token; two generations of at most ``entries`` each."""

    def __init__(self, tokenizer, entries: int):
        self.tokenize, self.entries, self.old = tokenizer.model.tokenize, entries, {}
        self.table = dict(enumerate(_byte_table()))

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            coded = word.encode().decode("latin-1").translate(self.table)
            ids = np.array([t.id for t in self.tokenize(coded)], "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Encodes texts; equal to ``Tokenizer.encode_batch(add_special_tokens=False)``, added tokens in texts included."""

    def __init__(self, path: str, entries: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        kind = told.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        self.by_word = bool(plain and not told.get("normalizer"))
        added = [t["content"] for t in told.get("added_tokens") or [] if t["content"]]
        #: None where no text can hold an added token.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.ids = _Ids(self.tokenizer, entries)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null is an empty text."""
        get, out = self.ids.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.by_word and not (self.added and self.added.search(text)) and (text.isascii() and not _CONTROL.search(text) or not OUTSIDE.search(text)):
                out.append(b"".join(map(get, PRETOKEN.findall(text))))
            else:
                done = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
                out.append(np.array(done.ids, "<u4").tobytes())
        return out


_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def encoder(path: str) -> TextEncoder:
    """This process's encoder for a tokenizer file; a worker keeps it from task to task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
