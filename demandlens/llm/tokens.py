"""Token ids of whole texts with a given public tokenizer."""

from __future__ import annotations

import json
import re
import sys
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that NFC leaves alone and that Arrow and the tokenizer lower alike, then signs without an apostrophe or a special token.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-;=?-@\[-`{}~]*)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_size(path: str) -> int:
    """The number of ids of a tokenizer: one more than its largest."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return 1 + max(chain(told["model"]["vocab"].values(), (t["id"] for t in told.get("added_tokens", []))))


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class Memory:
    """The ids of the strings it was told, one after the other in one array."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.starts, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32), 0

    def add(self, keys: list[str], ids: list[list[int]]) -> None:
        flat, first = np.fromiter(chain.from_iterable(ids), np.uint32), len(self.at)
        ends = self.used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + len(keys) >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first + 1 : first + 1 + len(keys)] = ends
        self.used += len(flat)
        self.at.update(zip(keys, range(first, first + len(keys)), strict=True))

    def spans(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of ids of each entry."""
        first = self.starts[index]
        return first, self.starts[index + 1] - first


def gathered(source: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs source[first : first + size] in a row, and where each starts, with one more for the end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(first - (ends - sizes), sizes) + np.arange(total)], np.concatenate((np.zeros(1, np.int64), ends))


class WordTokenizer:
    """A tokenizer of the kind that drops white space and marks word ends, with a bounded memory of the words it has met.

    White space never joins tokens of this kind, so a text's ids are those of its words in turn. A plain word is letters and signs; its
    lower-cased letters and its signs go to the BPE model as the tokenizer would pass them on, and are remembered apart, so that a word
    in other letters or before another sign costs nothing. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str, memory: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), memory
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.direct = told["model"].get("end_of_word_suffix") == "</w>" and [n["type"] for n in told["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}  # how byte-level BPE writes bytes
        self.known = Memory()

    def _piece(self, piece: str) -> list[int]:
        if not piece:
            return []
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(words), 1000) for e in self.tokenizer.encode_batch_fast(words[k : k + 1000], add_special_tokens=False)]

    def _find(self, keys: list[str], ids_of) -> np.ndarray:
        """Places of keys in the memory; ids_of gives the ids of those that are new."""
        at = list(map(self.known.at.get, keys))
        new = [k for k, p in zip(keys, at, strict=True) if p is None]
        if new:
            new = list(dict.fromkeys(new))
            self.known.add(new, ids_of(new))
            at = map(self.known.at.get, keys)
        return np.fromiter(at, np.int64, len(keys))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without repeats in a row, and where each word's ids start, with one more for the end."""
        if len(self.known.at) > self.limit:
            self.known = Memory()
        known = self.known
        parts = pc.extract_regex(words, PLAIN) if self.direct else pa.nulls(len(words), pa.struct([("core", pa.string()), ("signs", pa.string())]))
        odd = np.flatnonzero(parts.is_null().to_numpy(zero_copy_only=False))
        core, signs = pc.struct_field(parts, 0), pc.struct_field(parts, 1)
        core, signs = pc.utf8_lower(pc.fill_null(core, "")).dictionary_encode(), pc.fill_null(signs, "").dictionary_encode()
        # a word that is not plain is remembered behind a blank, which no part of a plain word has
        each = [self._find(strings(a.dictionary), lambda new: [self._piece(p) for p in new])[a.indices.to_numpy()] for a in (core, signs)]
        if len(odd):
            each[0][odd] = self._find([" " + w for w in strings(words.take(pa.array(odd)))], lambda new: self._whole([w[1:] for w in new]))
        known = self.known
        pairs = np.stack(each, axis=1).reshape(-1)
        ids, starts = gathered(known.ids, *known.spans(pairs))
        return ids, starts[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the place where each text's ids start, with one more for the end. Null counts as empty."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = parts.flatten().dictionary_encode()
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        table, places = self._words(flat.dictionary)
        index = flat.indices.to_numpy()
        ids, ends = gathered(table, places[index], (places[1:] - places[:-1])[index])
        return ids, ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def shared_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python process, with the words that its earlier tasks met."""
    kept = sys.modules.setdefault("_demandlens_kept", ModuleType("_demandlens_kept")).__dict__.setdefault("tokenizers", {})
    if path not in kept:
        kept.clear()  # one tokenizer at a time bounds the memory
        kept[path] = WordTokenizer(path)
    return kept[path]


def encoded_batches(batches, text_at: int, path: str, end_id: int, most_chars: int = 4_000_000):
    """For each batch, cut so that its texts have about most_chars, the slice, all ids with end_id after each text, and the places where texts start."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = shared_tokenizer(path)
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(text_at)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            before = int(sizes[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + most_chars, "right")))
            b = whole.slice(at, stop - at)
            ids, starts = tokenizer.encode(b.column(text_at))
            ids = np.insert(ids, starts[1:], end_id)
            yield b, ids, starts + np.arange(len(starts))
            at = stop
