"""Pre-tokens of byte-level BPE: how a text is cut before merges, and what of the tokenizer's file the operators need."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import regex

#: Fixed value: the pattern of byte-level pre-tokenizers of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same where letters and digits are those of Latin alphabets, for the faster library. PLAIN: where that holds.
LATIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u017f\u2010-\u201f\u2026]*")


class Splitter:
    """Cuts a text into pre-tokens; strings of added tokens, if any, come out whole as (id,)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.model = json.load(file)
        kind = self.model.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or self.model.get("normalizer"):
            raise ValueError("only byte-level tokenizers without prefix space and normalizer are cut here")
        self.every, self.latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.added = {x["content"]: x["id"] for x in self.model.get("added_tokens", [])}
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def find(self, text: str) -> list[str]:
        return self.latin(text) if PLAIN.fullmatch(text) else self.every(text)

    def __call__(self, text: str) -> list:
        if self.special is None or not any(name in text for name in self.added):
            return self.find(text)
        out: list = []
        for k, piece in enumerate(self.special.split(text)):
            if k % 2:
                out.append((self.added[piece],))
            else:
                out += self.find(piece)
        return out


def byte_symbols() -> dict[str, int]:
    """Which character of a vocabulary file stands for which byte: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Numbers(dict):
    """A number for each distinct pre-token, given when it is first asked for; `new` has those since the last look."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Learned:
    """Values of numbered pre-tokens: `look` computes them for new ones; all are dropped once there are `most`."""

    def __init__(self, look: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int):
        self.look, self.most = look, most
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.sizes, self.starts, self.values, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def __call__(self, texts: list[str], split: Callable[[str], list]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of all texts, and the n + 1 offsets of texts; values of new words are looked up."""
        if len(self.numbers) > self.most:
            self.clear()
        # Each text's words are numbered as soon as they are cut, while they are in the processor's cache.
        numbers = [self.numbers.of(split(text)) for text in texts]
        if self.numbers.new:
            sizes, values = self.look(self.numbers.new)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            if self.used + len(values) > len(self.values):
                self.values = np.concatenate([self.values[: self.used], np.empty(max(len(values), self.used, 1 << 16), values.dtype)])
            self.values[self.used : self.used + len(values)] = values
            self.used += len(values)
            self.numbers.new = []
        return np.concatenate(numbers) if numbers else np.empty(0, np.int64), np.concatenate([[0], np.cumsum([len(n) for n in numbers])])
