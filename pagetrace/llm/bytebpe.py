"""Whole-text encoding with a byte-level BPE of the tokenizers library, many texts at once.

Such a vocabulary cuts a text before it merges, and always before the white
space that follows something else, and before a mark that follows a letter or
digit.  So a text's ids are those of its chunks in turn, a word with the white
space before it or marks up to the next word; each distinct chunk is encoded once
in a task.  That holds for vocabularies without a
normaliser and with the plain byte-level pre-tokenizer; any other is encoded
text by text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from . import textscan
from .wordbpe import _CHARS, WordEncoder

#: Bytes that white space begins with or may be taken for; chunks begin at the first six only.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NEAR = _BLANK.copy()
_NEAR[28:32] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~_ALNUM[33:127]
_LINE = _BLANK.copy()
_LINE[32] = False
#: Bytes that white space beyond ASCII begins with.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SAME = np.arange(256, dtype=np.uint8)
_RAW = np.arange(1, 257, dtype=np.uint64)


def _wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space beyond ASCII, or may be."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0xA0) | (c == 0x85))
    three = ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80))
    return two | three


class ByteEncoder(WordEncoder):
    """As WordEncoder, for byte-level vocabularies."""

    def _splits(self, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut, model = rules.get("pre_tokenizer") or {}, rules.get("model", {})
        return (
            rules.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex") is True
            and not cut.get("add_prefix_space")
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and all(x["content"].startswith("<|") for x in rules.get("added_tokens", []))
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in rules.get("added_tokens", []))
        )

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__(path, most)

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk: of single words, which are not cut any further, by the model alone; of others by the library's whole way."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        word = [(t[1:] if t[0] == " " else t).isalpha() and (t.isascii() or max(t) < "Ā") for t in texts]
        tokenize = self.whole.model.tokenize
        words = b"\n".join([c for c, w in zip(chunks, word) if w]).decode("latin-1").translate(_CHARS)
        found = iter([[t.id for t in tokenize(w)] for w in words.split("\n")] if words else [])
        rest = iter(self.whole.encode_batch_fast([t for t, w in zip(texts, word) if not w], add_special_tokens=False))
        return [next(found) if w else next(rest).ids for w in word]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's ids begin (one more entry: the end)."""
        if not self.by_chunk:
            return self._each(texts)
        data, at = textscan.joined(texts)
        blank = np.flatnonzero(_BLANK[data])
        begins = np.zeros(len(data), bool)
        begins[blank[(blank > 0) & ~_NEAR[data[np.maximum(blank - 1, 0)]] & ~_wide(data, blank)]] = True
        if b"<|" not in data.tobytes():  # special tokens have letters and marks
            begins[1:] |= _MARK[data[1:]] & _ALNUM[data[:-1]]
        # one character of white space that is no blank leaves what follows alone
        begins[1:] |= begins[:-1] & _LINE[data[:-1]] & ~_NEAR[data[1:]] & ~_LEAD[data[1:]]
        ends = at[1:] - 1  # of the texts, whose line feeds are ours
        begins[at[:-1]] = True
        begins[ends] = False
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        stop = np.minimum(np.r_[starts[1:], len(data)], ends[np.searchsorted(ends, starts)])
        entry = self._entries(data, starts, stop, _RAW, _SAME, False)
        lengths = self.lengths[entry]
        begin = np.cumsum(lengths) - lengths
        return self.ids[textscan.ragged(self.starts[entry], lengths)], np.r_[begin, lengths.sum()][np.searchsorted(starts, at)]
