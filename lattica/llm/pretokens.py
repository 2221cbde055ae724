"""Cutting texts where a byte-level tokenizer cuts them, and remembering what the pieces encode to."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from operator import attrgetter

import regex

#: Fixed value: the pattern of byte-level BPE pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S)(?= )").split
#: Letters whose class no version of Unicode changes, and the same pattern over ASCII and these.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(f"[\\x00-\\x7f{_LATIN}]*").fullmatch
_PARTS = re.compile(rf" ?[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r {_LATIN}0-9]+| ?[0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
_ALL_PARTS = regex.compile(PATTERN).findall
#: Longer pieces are encoded each time, so that a memo's keys are short.
LONGEST_KEY = 64
_ID = attrgetter("id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pretokens(text: str) -> list[str]:
    """All matches of PATTERN."""
    return _PARTS(text) if _SIMPLE(text) else _ALL_PARTS(text)


class Memo(dict):
    """Ids of pieces as bytes (little-endian unsigned 32-bit), found when first asked for and remembered.

    A text of ASCII and Latin letters is cut into pre-tokens; any other, and one with one of ``specials``, is cut before
    the spaces that follow a non-space, which no pre-token crosses, and there into pre-tokens or left whole. ``encode``
    takes either, ``single`` only a pre-token of ASCII and Latin letters without ``specials``. There are two generations: when the young one holds ``limit`` pieces it becomes the old one, and what is
    asked for again moves on; the rest is forgotten.
    """

    def __init__(self, encode: Callable[[str], list[int]], specials: tuple[str, ...] = (), limit: int = 250_000, single: Callable[[str], Iterable[int]] | None = None):
        self.encode, self.specials, self.limit, self.old, self.single = encode, specials, limit, {}, single or encode

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("I", (self.single if self._plain(piece) else self.encode)(piece)).tobytes()
        if len(piece) <= LONGEST_KEY:
            self[piece] = found
        return found

    def _plain(self, text: str) -> bool:
        if _SIMPLE(text) is None:
            return False
        for s in self.specials:
            if s in text:
                return False
        return True

    def _pieces(self, text: str) -> list[str]:
        if self._plain(text):
            return _PARTS(text)
        return [p for c in _CUT(text) if c for p in (_PARTS(c) if self._plain(c) else (c,))]

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        get, out = self.__getitem__, []
        for t in texts:
            if len(self) > self.limit:
                self.old = dict(self)
                self.clear()
            out.append(b"".join(map(get, self._pieces(t))))
        return out


def batches_of(texts: list[str], most: int = 1 << 20):
    """Index ranges of ``texts`` with at most ``most`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _byte_characters() -> dict[int, int]:
    """The character that byte-level tokenizers write for each byte: itself where it is printable, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in shown else 256 + sum(c not in shown for c in range(b)) for b in range(256)}


class Library:
    """``encode(text)`` of the tokenizers library, its special strings treated as it does by default.

    A single pre-token of ASCII and Latin letters goes straight to the library's BPE model, anything else through the
    whole tokenizer. Single-threaded: Spark runs the tasks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.table = self.tokenizer.model.tokenize, _byte_characters()
        self.space = chr(self.table[32])
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def single(self, text: str) -> Iterable[int]:
        """``encode`` of one pre-token of ASCII and Latin letters that holds no special string."""
        if text.isascii() and text.removeprefix(" ").isalpha():
            return map(_ID, self.tokenize(text.replace(" ", self.space)))
        return map(_ID, self.tokenize(text.encode().decode("latin-1").translate(self.table)))

    def encode(self, text: str) -> list[int]:
        if _SIMPLE(text) and not any(s in text for s in self.specials) and len(_PARTS(text)) == 1:
            return list(self.single(text))
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def memo(self, limit: int = 250_000) -> Memo:
        return Memo(self.encode, self.specials, limit, self.single)
