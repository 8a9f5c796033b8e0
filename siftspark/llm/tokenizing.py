"""Token ids of whole texts by the tokenizers library, with the library's answers remembered per word.

Byte-level BPE splits a text into pre-tokens that never run from a non-space into white space. So a text cut before runs of
white space encodes to the ids of its parts, one after the other, and the same part always has the same ids. Each worker
keeps the ids of parts and pre-tokens it met first, in tables of bounded size (frequent words come early, so they are in).
A part it doesn't know goes to the library: letters with marks behind them, the common case, as pre-tokens straight to
the library's BPE model, whatever else through the library's whole encoder. Added tokens (``<|endoftext|>``) are cut out first,
as the library does, leftmost and longest; where one has rules of its own about the text around it, a text that holds one
goes to the library whole. The ids are the library's own, and tests hold them against a fresh tokenizer's answers for whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

import regex

#: Parts and pre-tokens that a worker remembers, at about 200 bytes each.
CACHE_PARTS, CACHE_PRETOKENS = 400_000, 500_000
#: The Unicode property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PARTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Cutting before every single space is right where spaces and line breaks stand alone and no other white space is there.
_RUNS = ("  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: Marks that, alone behind a word, are a pre-token of their own.
_MARKS = frozenset(".,;:!?)")
#: A word, perhaps after a line break, perhaps with marks behind it: up to three pre-tokens. An apostrophe may begin a contraction, so it isn't here.
_WORD = regex.compile(r"([\n\t\r]?)( ?\p{L}+)([^\s\p{L}\p{N}'\x1c-\x1f]*)")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself if it is one, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Remembered(dict):
    """Answers of ``ask``, the first ``bound`` of which are kept."""

    def __init__(self, ask: Callable[[str], bytes], bound: int):
        super().__init__()
        self._ask, self._bound = ask, bound

    def __missing__(self, key: str) -> bytes:
        got = self._ask(key)
        if len(self) < self._bound:
            self[key] = got
        return got


class PartEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self._added = {t.content: array("I", [self.tokenizer.token_to_id(t.content)]).tobytes() for t in added}
        self._added_apart = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self._cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        self._pretoken = _Remembered(self._ask_model, CACHE_PRETOKENS).__getitem__
        self._piece = _Remembered(self._ask, CACHE_PARTS // 4).__getitem__
        self._after_space = _Remembered(self._ask_spaced, CACHE_PARTS).__getitem__
        plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self._direct = plain and self._whole("Ab é-x") == b"".join(map(self._pretoken, ("Ab", " é", "-", "x")))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ask_model(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalpha():
            shown = word.replace(" ", "\u0120")
        else:
            shown = word.encode("utf-8").decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def _ask_spaced(self, word: str) -> bytes:
        """The ids of a word behind one space; letters with at most one mark go the short way."""
        if self._direct:
            if word.isalpha():
                return self._pretoken(" " + word)
            if word[-1:] in _MARKS and word[:-1].isalpha():
                return self._pretoken(" " + word[:-1]) + self._pretoken(word[-1])
        return self._ask(" " + word)

    def _ask(self, part: str) -> bytes:
        m = _WORD.fullmatch(part) if self._direct else None
        if m:
            return b"".join([self._pretoken(x) for x in m.groups() if x])
        pieces = _PARTS.findall(part)
        return self._whole(part) if len(pieces) < 2 else b"".join(map(self._piece, pieces))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; a null or empty text has none."""
        if not text:
            return b""
        if any(x in text for x in self._added):
            if not self._added_apart:
                return self._whole(text)
            # Every other piece is an added token.
            return b"".join([self._added[x] if k % 2 else self._plain(x) for k, x in enumerate(self._cut_added(text))])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if any(x in text for x in _RUNS):
            return b"".join(map(self._piece, _PARTS.findall(text)))
        first, *rest = text.split(" ")
        return (self._piece(first) if first else b"") + b"".join(map(self._after_space, rest))

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_ENCODERS: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """One encoder a worker process and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]
