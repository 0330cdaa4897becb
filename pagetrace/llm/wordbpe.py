"""Whole-text encoding with a word-level BPE of the tokenizers library, many texts at once.

The vocabulary splits at white space before it merges, so a text's ids are the
ids of its white-space-separated chunks in turn.  Each distinct chunk is encoded
once in a task and the ids of all texts are gathered from those.  Chunks of up to
seven bytes are found by those bytes, longer ones by a 64-bit hash, and they count
as known only if their bytes agree.  That holds
for vocabularies with the normaliser and pre-tokenizer below; any other is
encoded text by text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textscan

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True  # comma, full stop
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_RAW = np.arange(1, 257, dtype=np.uint64)
#: Bytes as the characters that a byte-level vocabulary writes them with.
_BYTES = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
_BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)}
_CHARS = {b: c for b, c in _BYTES.items() if b != 10}
#: Bytes with ASCII letters in lower case.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


#: What a vocabulary does before it merges, if chunks can be encoded by themselves.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_chunk(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal, cut = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        normal.get("normalizers") == NORMALIZERS
        and [x.get("type") for x in cut] == ["Split", "ByteLevel"]
        and (cut[0].get("pattern"), cut[0].get("behavior"), cut[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and not (cut[1].get("add_prefix_space") or cut[1].get("use_regex"))
        and rules.get("model", {}).get("type") == "BPE"
        and not rules["model"].get("dropout")
        and all(x["content"].startswith("<|") for x in rules.get("added_tokens", []))
    )


class WordEncoder:
    """Encodes Arrow string arrays to flat ids; keeps what it has met, up to `most` chunks."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.most, self.by_chunk = most, self._splits(path)
        self.stops = {c: self.whole.encode(chr(c), add_special_tokens=False).ids for c in (44, 46)}
        self.forget()

    def _splits(self, path: str) -> bool:
        return _by_chunk(path)

    def forget(self) -> None:
        self.known = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        self.count = self.used = 0
        self.starts = np.empty(1 << 16, np.int64)
        self.lengths = np.empty(1 << 16, np.int64)
        self.ids = np.empty(1 << 18, np.uint32)
        self.byte_starts = np.empty(1 << 16, np.int64)
        self.bytes = np.empty(1 << 18, np.uint8)
        self.byte_used = 0

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk: of single words that normalisation leaves as they are, but for case, by the model alone; of others by the library's whole way."""
        texts = b"\n".join(chunks).decode("utf-8", "replace").split("\n")
        word = [t.isalpha() and (t.isascii() or max(t) < "Ā") for t in texts]
        tokenize = self.whole.model.tokenize
        words = "\n".join([t for t, w in zip(texts, word) if w]).lower().encode().decode("latin-1").translate(_CHARS)
        found = iter([[t.id for t in tokenize(w)] for w in words.split("\n")] if words else [])
        rest = iter(self.whole.encode_batch_fast([t for t, w in zip(texts, word) if not w], add_special_tokens=False))
        return [next(found) if w else next(rest).ids for w in word]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        for known, entry in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                found[hit] = entry[at[hit]]
        return found

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        new = self._ids(chunks)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        begin, count = self.used + np.cumsum(lengths) - lengths, self.count + len(new)
        used = self.used + int(lengths.sum())
        while len(self.starts) < count:  # in place where it can be: the arrays are large
            self.starts.resize(2 * len(self.starts), refcheck=False)
            self.lengths.resize(2 * len(self.lengths), refcheck=False)
        while len(self.ids) < used:
            self.ids.resize(2 * len(self.ids), refcheck=False)
        self.starts[self.count : count], self.lengths[self.count : count] = begin, lengths
        self.ids[self.used : used] = np.fromiter((i for x in new for i in x), np.uint32, used - self.used)
        held = np.fromiter(map(len, chunks), np.int64, len(chunks))
        while len(self.byte_starts) <= count:
            self.byte_starts.resize(2 * len(self.byte_starts), refcheck=False)
        while len(self.bytes) < self.byte_used + int(held.sum()):
            self.bytes.resize(2 * len(self.bytes), refcheck=False)
        self.byte_starts[self.count : count + 1] = self.byte_used + np.r_[0, np.cumsum(held)]
        self.bytes[self.byte_used : self.byte_used + int(held.sum())] = np.frombuffer(b"".join(chunks), np.uint8)
        self.byte_used += int(held.sum())
        entry = np.arange(self.count, count)
        self.count, self.used = count, used
        if not len(keys):
            return
        self.known.append((keys, entry))  # keys come sorted
        while len(self.known) > 1 and (len(self.known[-2][0]) < 4 * len(self.known[-1][0])):
            (a, x), (b, y) = self.known.pop(), self.known.pop()
            both, places = np.r_[a, b], np.r_[x, y]
            order = np.argsort(both, kind="stable")
            self.known.append((both[order], places[order]))

    def _differ(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Places of the chunks whose bytes are not those that their entry was learnt from; short ones differ in length or not at all."""
        first = self.byte_starts[entry]
        wrong = self.byte_starts[entry + 1] - first != lengths
        rest = np.flatnonzero(~wrong & (lengths > 7))
        same = fold[data[textscan.ragged(starts[rest], lengths[rest])]] == fold[self.bytes[textscan.ragged(first[rest], lengths[rest])]]
        if not same.all():
            wrong[rest[np.unique(np.searchsorted(np.cumsum(lengths[rest]), np.flatnonzero(~same), "right"))]] = True
        return np.flatnonzero(wrong)

    def _apart(self, chunks: list[bytes]) -> np.ndarray:
        """Entries of chunks that no key leads to."""
        begin = self.count
        self._learn(np.empty(0, np.uint64), chunks)
        return np.arange(begin, self.count)

    def _each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() without chunks."""
        found = [e.ids for e in self.whole.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, fold: np.ndarray, marked: bool) -> np.ndarray:
        """The entry of each chunk data[start:end]; new ones are learnt.  fold says which bytes count as equal, values hashes them alike."""
        size = ends - starts
        keys = textscan.run_hashes(data, starts, ends, values) ^ size.astype(np.uint64)
        short = np.flatnonzero(size <= 7)  # bytes and length, whatever the hash
        ahead = np.ndarray((len(data),), "<u8", np.r_[fold[data], np.zeros(8, np.uint8)], strides=(1,))[starts[short]]
        own = size[short].astype(np.uint64)
        keys[short] = textscan.mix((ahead & ((np.uint64(1) << own * np.uint64(8)) - np.uint64(1))) | own << np.uint64(56))
        if marked:
            keys = ~keys
        coded = pa.array(keys).dictionary_encode()
        distinct, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if self.count > self.most:
            self.forget()
        entry = self._find(distinct)
        if len(new := np.flatnonzero(entry < 0)):
            view, new = memoryview(data), new[np.argsort(distinct[new])]
            self._learn(distinct[new], [bytes(view[starts[i] : ends[i]]) for i in first[new]])
            entry = self._find(distinct)
        entry = entry[code]
        if len(other := self._differ(data, starts, size, entry, fold)):  # two chunks with one hash
            entry[other] = self._apart([data[starts[i] : ends[i]].tobytes() for i in other])
        return entry

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's ids begin (one more entry: the end)."""
        if not self.by_chunk:
            return self._each(texts)
        data, at = textscan.joined(texts)
        starts, ends = textscan.runs(_SPACE[data])
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        # "word," and "word." are the word and a mark of its own; case is ignored.
        last = data[ends - 1]
        cut = _STOP[last] & (ends - starts > 1)
        cut[cut] = _ALNUM[data[ends[cut] - 2]]
        core = ends - cut
        marked = b"<|" in data.tobytes()  # special tokens are told apart by case
        entry = self._entries(data, starts, core, _RAW if marked else textscan.LOWER, _SAME if marked else _FOLDED, marked)
        lengths = self.lengths[entry]
        # a mark has one id, after those of its word
        total = lengths + cut
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[textscan.ragged(begin, lengths)] = self.ids[textscan.ragged(self.starts[entry], lengths)]
        for c, ids in self.stops.items():
            out[(begin + lengths)[cut & (last == c)]] = ids[0]
        docs = np.searchsorted(starts, at)
        return out, np.r_[begin, len(out)][docs]


_ENCODERS: dict[tuple[type, str], WordEncoder] = {}


def encoding(path: str, batches: Iterator[pa.RecordBatch], kind: type[WordEncoder] = WordEncoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, the flat ids of their texts and where each text's ids begin.

    The vocabulary stays with the worker, which outlives its tasks; what was
    learnt goes with the task.
    """
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    encoder = _ENCODERS[kind, path]
    try:
        for part in textscan.slices(batches, limit=textscan.SLICE):
            yield part, *encoder.encode(part.column("text"))
    finally:
        encoder.forget()
        textscan.trim()
