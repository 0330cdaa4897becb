"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over hashed character
n-grams (logistic regression) predicts each bit; a text's language is the one
whose codeword has the least loss, each bit weighted by how well its classifier
did in training.  A small gap to the second codeword marks the text ambiguous.

Whole texts are read when training and when predicting.  Training uses a bounded
sample: at most about `sample` labelled rows of each language, taken by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, stash

UNKNOWN = "und"
FEATURES = 1 << 13
_LETTERS = textscan.WORD.copy()
_LETTERS[[*range(48, 58), 95]] = False
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def codewords(languages: int) -> np.ndarray:
    """A row of -1/+1 for each language.

    Up to seven languages have the exhaustive code (every way to part them in
    two, once); more have random columns, 15 for each doubling, none constant.
    """
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        cols = np.arange(1, 2 ** (languages - 1))
        bits = (cols[None, :] >> np.arange(languages)[:, None]) & 1
    else:
        draw = np.random.default_rng(7)
        bits = draw.integers(0, 2, (languages, 15 * int(np.ceil(np.log2(languages)))))
        bits[0, bits.min(0) == bits.max(0)] ^= 1
    return (bits * 2 - 1).astype(np.int8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashed 1- to 3-gram weights of unit length, and which texts have a letter.

    Runs of letters in lower case, other characters as one blank; n-grams are of
    UTF-8 bytes, so that no text is decoded one character at a time.  Weights
    are square roots of shares, so a long text weighs no more than a short one.
    """
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, at = textscan.joined(lower)
    inside = _LETTERS[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one blank after each run
    place = np.flatnonzero(keep)
    value = np.where(inside[place], data[place], 32).astype(np.uint64)
    bounds = np.searchsorted(place, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    out = np.zeros((len(at) - 1, FEATURES), np.float32)
    flat, gram = out.reshape(-1), np.zeros(len(value), np.uint64)
    for n, seed in enumerate(_SEEDS):
        gram = gram[: len(value) - n] * np.uint64(257) + value[n:] + seed if n else value + seed
        slot = (textscan.mix(gram) & np.uint64(FEATURES - 1)).astype(np.int64)
        own = owner[: len(slot)]
        same = own == owner[n:]
        flat += np.bincount(own[same] * FEATURES + slot[same], minlength=flat.size)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    out /= np.maximum(norm, 1e-12)
    letters = pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    return out, letters


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    bit_weight: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and whether the decision is ambiguous, for each text."""
        x, letters = features(texts)
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]) @ self.bit_weight
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = np.where(letters, share[np.arange(len(best)), best], 0.0)
        second = np.partition(share, -2, 1)[:, -2] if len(self.languages) > 1 else np.zeros(len(best))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, score.clip(0, 1), ~letters | (score - second < 0.1)


class Rows:
    """Feature rows of which only those asked for are dense at a time."""

    def __init__(self, lengths: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.begin, self.at, self.value = np.r_[0, np.cumsum(lengths)], at, value

    def __len__(self) -> int:
        return len(self.begin) - 1

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        lengths = np.diff(self.begin)[rows]
        own = textscan.ragged(self.begin[rows], lengths)
        out = np.zeros((len(rows), FEATURES), np.float32)
        out[np.repeat(np.arange(len(rows)), lengths), self.at[own]] = self.value[own]
        return out


def fit(x: Rows | np.ndarray, labels: list[str], rounds: int = 15, rate: float = 2.0, decay: float = 1e-5) -> LanguageModel:
    """Logistic regression of every bit at once, by Adagrad over shuffled mini-batches."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    index = {l: i for i, l in enumerate(languages)}
    own = np.array([index[l] for l in labels], np.int64)
    y = (code[own] > 0).astype(np.float32) if len(own) else np.zeros((0, code.shape[1]), np.float32)
    weights = np.zeros((FEATURES, code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    if len(languages) > 1:
        # every language counts alike, however many rows it has
        each = (len(own) / len(languages) / np.bincount(own))[own].astype(np.float32)[:, None]
        past, past_bias = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
        draw = np.random.default_rng(1)
        for _ in range(rounds):
            for part in np.array_split(draw.permutation(len(own)), max(1, len(own) // 256)):
                own = x[part]
                p = 1 / (1 + np.exp(-(own @ weights + bias)))
                err = each[part] * (p - y[part]) / len(part)
                grad, down = own.T @ err + decay * weights, err.sum(0)
                past += grad * grad
                past_bias += down * down
                weights -= rate * 0.1 * grad / np.sqrt(past)
                bias -= rate * 0.1 * down / np.sqrt(past_bias)
        right = sum(((x[part] @ weights + bias > 0) == (y[part] > 0)).sum(0) for part in np.array_split(np.arange(len(labels)), len(labels) // 256 + 1)) / len(labels)
        trust = np.maximum(right - 0.5, 1e-3)
    else:
        trust = np.ones(code.shape[1])
    return LanguageModel(languages, code.astype(np.float32), weights, bias, trust / trust.mean())


def train(docs: DataFrame, sample: int = 800, in_all: int = 4000, least: int = 16) -> LanguageModel:
    """Fit on text and lang of a bounded sample of the rows that may be learnt from.

    Those are rows whose lang is not null and whose crc32(doc_id as text) mod 5
    is not 0 (a null doc_id counts as empty text).  Every value of lang is learnt.
    About `sample` rows of each and `in_all` rows together, but `least` of each
    however many values there are, are chosen by a hash of doc_id and text; rows
    equal in both count once among them.
    """
    textscan.lean()  # the driver's Python has the sample once and gives it back
    known = in_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang", F.xxhash64("doc_id", "text").alias("_h"))
    counts = stash(known.groupBy("lang").agg(F.count("*").alias("_n")))
    languages = counts.count()
    if not languages:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    each = min(sample, max(least, in_all / languages))
    # a row for each language, as the model on the driver has
    told = known.join(F.broadcast(counts), "lang")
    chosen = told.where(F.shiftrightunsigned("_h", 11) < F.lit(each) / F.col("_n") * 2.0**53).groupBy("lang", "_h").agg(F.first("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches, limit=1 << 18):
            for i in range(0, part.num_rows, 64):
                own = part.slice(i, 64)
                x, letters = features(own.column("text"))
                row, col = np.nonzero(x)
                cuts = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [own.column("lang"), own.column("_h"), pa.array(letters), pa.ListArray.from_arrays(cuts, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(x[row, col]))],
                    ["lang", "_h", "letters", "at", "value"],
                )

    got = chosen.mapInArrow(rows, "lang string, _h long, letters boolean, at array<int>, value array<float>").where("letters").toArrow()
    got = got.sort_by([("_h", "ascending"), ("lang", "ascending")]).combine_chunks()  # the same whatever order the rows came in
    if not got.num_rows:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    model = fit(Rows(at.value_lengths().to_numpy(), at.flatten().to_numpy(), value.flatten().to_numpy()), got.column("lang").to_pylist())
    del got, at, value
    textscan.trim()
    return model


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and ambiguous to the columns `keep` of docs (all but those names if not given).

    A null text and one without any letter are `und` with score 0, as is every
    text if the model has met no language.
    """
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "ambiguous")]
    docs = in_batches(docs)
    wanted = docs.select(*names) if "text" in names else docs.select(*names, "text")
    fields = [f for f in wanted.schema.fields if f.name in names]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, ambiguous boolean"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches, limit=1 << 18):
            for i in range(0, part.num_rows, 64):
                own = part.slice(i, 64)
                lang, score, ambiguous = model.predict(own.column("text"))
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous)], [*names, "lang_pred", "score", "ambiguous"])

    return wanted.mapInArrow(tell, shape)


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, whose language the model tells with a score of `least` or more."""
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches, limit=1 << 18):
            for i in range(0, part.num_rows, 64):
                own = part.slice(i, 64)
                lang, score, _ = model.predict(own.column("text"))
                yield own.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(lang, score)], pa.bool_()))

    return in_batches(docs).select(*names).mapInArrow(keep, docs.schema)
