"""Public tokenizers by pre-token: each distinct pre-token is encoded once and remembered.

Byte-pair merges never cross pre-tokens, so a text's ids are those of its pre-tokens in order. The special
strings of a file are cut out of a text first, as the library does by default. Stretches of printable ASCII and
Latin letters are split here by the patterns of the public tokenizer files; every stretch with any other
character goes through the library's own normalizer and pre-tokenizer, whose Unicode tables are its own.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

#: The byte-level and the word-end pattern for stretches of printable ASCII and Latin letters, where the
#: classes of the standard library's engine mean the same.
_BYTE_LEVEL_LATIN = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_WORD_END_LATIN = r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+"
#: Visible characters of those stretches: up to Latin-1, and with the two Latin extensions.
_LATIN_1, _LATIN = "\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


def _shown() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_SHOWN = _shown()
_BYTE = {c: b for b, c in _SHOWN.items()}


def shown(pre_token: str) -> str:
    """A pre-token as the models of both files take it."""
    return pre_token.encode("utf-8").decode("latin-1").translate(_SHOWN)


def _plain(pre_token: str) -> str:
    """The inverse of ``shown``."""
    return bytes(_BYTE[c] for c in pre_token).decode("utf-8")


_cached: dict[object, object] = {}


def tokenizer(path: str):
    """The tokenizers library's object for a file, once per worker."""
    if path not in _cached:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _cached[path] = Tokenizer.from_file(path)
    return _cached[path]


def special_strings(path: str) -> list[str]:
    """Strings that the library takes out of texts before pre-tokenization."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


class Splitter:
    """Parts of a whole text: its special strings, and pre-tokens of all between them."""

    def __init__(self, path: str, latin: str, visible: str):
        library = tokenizer(path)
        self.find = re.compile(latin).findall
        self.odd = re.compile(f"[^\t\n\r {visible}]").search
        # Before one space between two visible characters no pre-token goes on and no normal form reaches over.
        self.stretches = re.compile(f"(?<=[{visible}])(?= [{visible}])").split
        self.normalize = library.normalizer.normalize_str if library.normalizer else None
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        self.special = special_strings(path)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def library_pre_tokens(self, text: str) -> list[str]:
        return [_plain(p) for p, _ in self.pre_tokenize(self.normalize(text) if self.normalize else text)]

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not self.odd(text):
            return self.latin(text)
        return [p for part in self.stretches(text) for p in (self.library_pre_tokens(part) if self.odd(part) else self.latin(part))]

    def latin(self, text: str) -> list[str]:
        return self.find(text)

    def parts(self, text: str | None) -> Iterator[tuple[str | None, list[str]]]:
        """(special string or None, pre-tokens) in order."""
        if text and self.special and any(s in text for s in self.special):
            for k, part in enumerate(self.split(text)):
                yield (part, []) if k % 2 else (None, self.plain(part))
        elif text:
            yield None, self.plain(text)


class WordEndPreTokens(Splitter):
    """Pre-tokens of a whole text under a word-end tokenizer file; special strings with a space before them.

    No pre-token of such a file holds a space. Latin stretches are lower-cased here: no normal form changes them.
    """

    def __init__(self, path: str):
        super().__init__(path, _WORD_END_LATIN, _LATIN_1)

    def latin(self, text: str) -> list[str]:
        return self.find(text.lower())

    def __call__(self, text: str | None) -> list[str]:
        out: list[str] = []
        for special, pre in self.parts(text):
            out.extend(pre if special is None else (" " + special,))
        return out


def piece_count(path: str):
    """Function from a list of what ``WordEndPreTokens`` gives to their numbers of pieces."""
    tokenize = tokenizer(path).model.tokenize
    return lambda pre: [1 if p[0] == " " else len(tokenize(shown(p))) for p in pre]


class ByteLevelEncoder(dict):
    """Ids of whole texts as little-endian uint16; as a dict it maps a pre-token to its ids' bytes.

    Vocabularies of up to 65,536 ids fit. The memory of pre-tokens is bounded by ``keep``.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        super().__init__()
        self.library, self.keep = tokenizer(path), keep
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.splitter = Splitter(path, _BYTE_LEVEL_LATIN, _LATIN)
        self.tokenize = self.library.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.clear()
        for s in self.splitter.special:
            self[s] = array("H", [self.library.token_to_id(s)]).tobytes()

    def __missing__(self, pre_token: str) -> bytes:
        ids = self[pre_token] = array("H", [t.id for t in self.tokenize(shown(pre_token))]).tobytes()
        return ids

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of some texts."""
        if len(self) > self.keep:
            self._forget()
        return [self(t) for t in texts]

    def __call__(self, text: str | None) -> bytes:
        parts = self.splitter.parts(text)
        return b"".join([b"".join(map(self.__getitem__, pre if special is None else (special,))) for special, pre in parts])


def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One encoder for a worker's life: later tasks find the pre-tokens of earlier ones."""
    key = ("byte", path)
    if key not in _cached:
        _cached[key] = ByteLevelEncoder(path)
    return _cached[key]
