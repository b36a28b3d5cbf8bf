"""Exact token ids of whole texts, with each distinct word encoded once per task."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from medlink.llm.common import KEPT

#: A tokenizer that drops white space, so words between spaces or line feeds are encoded independently.
WORD_TOKENIZER = "word_bpe_49k.json"
#: Words that a task keeps with their ids; a full store is emptied and filled again.
MAX_WORDS = 500_000


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    return public_tokenizers.path(name)


#: Latin letters, then at most one run of signs: one or two parts for the tokenizer, each ending in an end-of-word id.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ſ]+([!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-]*)").fullmatch


def _folded(text: str) -> str:
    """Lower case, as the tokenizer's own first step does it, where the text is Latin and so no case depends on context."""
    if "<|" in text:  # may be a special token, which is found before lower-casing
        return text
    if text.isascii():
        return text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return text.lower() if codes.max() < 0x180 and not (codes == 0x130).any() else text


_LETTERS = np.array([chr(c).isalnum() for c in range(256)])


def _spaced(text: str) -> str:
    """Set commas and full stops that end a word apart, where every one follows a letter or digit: fewer different words.

    The tokenizer parts signs from letters and digits anyway, and drops the space. A run of signs has to stay together.
    """
    try:
        codes = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return text
    mark = codes[1:-1]
    at = np.flatnonzero(((mark == 44) | (mark == 46)) & (codes[2:] == 32))
    return text.replace(", ", " , ").replace(". ", " . ") if len(at) and _LETTERS[codes[at]].all() and text[0] not in ",." else text


class WordEncoder:
    """Ids of texts by a lower-casing tokenizer with word ends that drops white space and joins nothing across it.

    Texts are cut at spaces and line feeds only; other white space stays inside a word and is left to the tokenizer.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks use the cores; threads of their own only cost
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _plain_ids(self, words: list[str], parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, length of each word): words share calls, joined by spaces, as each part has one end-of-word id."""
        lines = [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) != sum(parts):
            return self._any_ids(words)
        return ids, np.diff(np.r_[0, ends[np.cumsum(parts) - 1] + 1])

    def _any_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, each word by itself."""
        one = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(one), np.array([len(x) for x in one], np.int64)

    def _add(self, words: list[str]) -> None:
        plain, parts, rest = [], [], []
        for word in words:
            if word.isascii() and word.isalpha():
                plain.append(word)
                parts.append(1)
            elif found := _PLAIN(word):
                plain.append(word)
                parts.append(2 if found[1] else 1)
            else:
                rest.append(word)
        if plain:
            self._keep(plain, *self._plain_ids(plain, parts))
        if rest:
            self._keep(rest, *self._any_ids(rest))

    def _keep(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        first, last = len(self.index), len(self.index) + len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while last > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first:last] = self.used + np.cumsum(length) - length
        self.length[first:last] = length
        self.used += len(ids)
        self.index.update(zip(words, range(first, last)))

    def _words(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the end of each text among them."""
        if len(self.index) > self.max_words:
            self._clear()
        words: list[str] = []
        ends = []
        for text in texts:
            words += _spaced(_folded(text).replace("\n", " ")).split(" ")
            ends.append(len(words))
        number = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            self._add(list(dict.fromkeys([words[i] for i in missing])))
            number[missing] = [self.index[words[i]] for i in missing]
        return number, np.array(ends, np.int64)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        number, ends = self._words(texts)
        total = np.r_[0, np.cumsum(self.length[number])]
        return np.diff(np.r_[0, total[ends]])

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text among them); end_id follows every text if it is given."""
        number, ends = self._words(texts)
        length = self.length[number]
        total = np.r_[0, np.cumsum(length)]
        ids = self.ids[np.repeat(self.start[number] - total[:-1], length) + np.arange(total[-1])]
        ends = total[ends]
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept for its next task."""
    if path not in KEPT:
        KEPT[path] = WordEncoder(path)
    return KEPT[path]
