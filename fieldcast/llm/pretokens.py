"""Pre-tokens of byte-level and word-end BPE vocabularies, exactly as the tokenizers library cuts them.

Texts over a plain repertoire (Latin letters, digits, common punctuation) are cut by one compiled pattern whose
classes are written out. Any other character may belong to another class in another Unicode version, so texts with
one are cut by the library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\x09-\x0d\x20\x85\xa0"
#: anything outside these ranges is left to the library, and so are the separators that only Python takes for spaces
UNUSUAL = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
BYTE_LEVEL = re.compile(
    rf" ?[{LETTER}]+| ?[{NUMBER}]+|{ENDINGS}| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_END = re.compile(rf"[{LETTER}]+|[{NUMBER}]|{ENDINGS}|[^{SPACE}{LETTER}{NUMBER}]+")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, the alphabet of byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """A BPE tokenizer file of one of the two kinds, with the library beside it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.lower = spec["normalizer"] is not None
        self.find = (WORD_END if self.lower else BYTE_LEVEL).findall
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("special tokens that change the text around them are not handled")
        by_length = sorted(map(re.escape, self.specials), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(by_length)})") if by_length else None
        self.alphabet = byte_alphabet()
        self.to_byte = {c: b for b, c in self.alphabet.items()}
        self.model = self.library.model

    def plain_pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special string."""
        if UNUSUAL.search(text) is None:
            return self.find(text.lower() if self.lower else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a whole text; special strings are pieces of their own."""
        if self.special is None or self.special.search(text) is None:
            return self.plain_pieces(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.plain_pieces(part)
        return out

    def mapped(self, piece: str) -> str:
        """The piece in the byte alphabet, as the model takes it."""
        return piece.encode().decode("latin-1").translate(self.alphabet)

    def merge(self, piece: str) -> list[int]:
        """Token ids of one pre-token by the merges."""
        if piece in self.specials:
            return [self.specials[piece]]
        return [t.id for t in self.model.tokenize(self.mapped(piece))]

    def token_bytes(self) -> dict[int, bytes]:
        """Bytes of every token of a byte-level vocabulary, special strings included."""
        out = {i: bytes(self.to_byte[c] for c in token) for token, i in self.vocab.items()}
        return out | {i: content.encode() for content, i in self.specials.items()}


class Memo(dict):
    """Values by piece, computed when missing; cut back to the fixed entries when `limit` others have gathered."""

    def __init__(self, fixed: dict, compute: Callable, limit: int = 200_000):
        super().__init__(fixed)
        self.fixed, self.compute, self.limit = fixed, compute, limit + len(fixed)

    def __missing__(self, piece: str):
        value = self[piece] = self.compute(piece)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.update(self.fixed)
