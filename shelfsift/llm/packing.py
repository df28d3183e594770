"""Packing along a space-filling curve: hashed document vectors, Hilbert keys, neighbouring documents together."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import map_frames, running_total, stored

LENGTH, END = 4096, 2
BUCKETS, DIMENSIONS, BITS = 256, 3, 12
#: Stems a worker remembers from one piece of work to the next (some 20 MB) and characters of a piece, unless a text has more.
REMEMBERED, PIECE = 150_000, 1 << 22
#: A word of Latin letters and the marks at its end; the tokenizer parts the two whatever they are.
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
# Steps of a tokenizer that lower-cases, parts letters from marks and drops white space.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def goes_by_words(tokenizer) -> bool:
    """Whether the ids of a text are those of its words, and those of a word of letters don't hang on their case."""
    steps = json.loads(tokenizer.to_str())
    normal, pieces, model = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}, steps["model"]
    first = (pieces.get("pretokenizers") or [{}])[0]
    return (
        [step["type"] for step in normal.get("normalizers", [])] == _NORMALIZERS
        and first.get("pattern") == {"Regex": _PIECES} and first.get("behavior") == "Removed"
        and model["type"] == "BPE" and not model["dropout"]
    )


def _byte_letters() -> dict[int, str]:
    """How the tokenizer's model writes the bytes of Latin letters beyond ASCII."""
    from tokenizers.pre_tokenizers import ByteLevel

    written = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: written.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}


def _gathered(pool: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that ``codes`` name, one behind the other, and their lengths; ``pool`` holds all runs in order."""
    starts = np.cumsum(lengths) - lengths
    chosen = lengths[codes]
    ends = np.cumsum(chosen)
    place = np.repeat(starts[codes] - (ends - chosen), chosen) + np.arange(ends[-1] if len(ends) else 0)
    return pool[place], chosen


class WordIds:
    """Ids of whole texts, made word by word where no token of the vocabulary reaches over a space or line end.

    The ids of a word then depend on the word alone, and words that differ in their case or the marks at their end share
    those of their letters. Texts are taken in pieces: the distinct words of a piece are found and parted column by
    column, each distinct stem is tokenized once, and the ids are gathered. Texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.by_words = goes_by_words(self.tokenizer)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = self._packed([END])
        self.stems: dict[str, bytes] = {}
        if self.by_words:
            self.pieces, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _stem(self, stem: str) -> bytes:
        """Ids of lower-case Latin letters, straight from the model: no pattern parts them."""
        return self._packed([t.id for t in self.pieces(stem if stem.isascii() else stem.translate(self.letters))])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words in order and how many each has, all in one call; the tokenizer tells the word of every id."""
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, self.kind), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def _stemmed(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stems in order and how many each has."""
        known = self.stems
        found = []
        for stem in stems:
            ids = known.get(stem)
            if ids is None:
                ids = known[stem] = self._stem(stem)
            found.append(ids)
        if len(known) > REMEMBERED:
            self.stems = dict(zip(stems[:REMEMBERED], found))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        return np.frombuffer(b"".join(found), self.kind), lengths

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in order and how many each has."""
        parted = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(parted)
        stems = pc.utf8_lower(pc.fill_null(pc.struct_field(parted, "stem"), "")).dictionary_encode()
        others = pc.if_else(plain, pc.fill_null(pc.struct_field(parted, "marks"), ""), words).dictionary_encode()
        runs = (self._stemmed(stems.dictionary.to_pylist()), self._encoded(others.dictionary.to_pylist()))
        pool, lengths = (np.concatenate(both) for both in zip(*runs))
        codes = np.empty(2 * len(words), np.int64)
        codes[0::2] = stems.indices.to_numpy(zero_copy_only=False)
        codes[1::2] = others.indices.to_numpy(zero_copy_only=False) + len(stems.dictionary)
        ids, chosen = _gathered(pool, lengths, codes)
        return ids, chosen[0::2] + chosen[1::2]

    def _piece(self, texts: list[str]) -> list[bytes]:
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids, lengths = _gathered(*self._distinct(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(lengths)])[words.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() + self.end for a, b in zip(ends, ends[1:])]

    def many(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text and the end mark."""
        texts = [text or "" for text in texts]
        if not self.by_words:
            return [self._packed(self.tokenizer.encode(t, add_special_tokens=False).ids) + self.end for t in texts]
        found: list[bytes] = []
        piece, size = [], 0
        for text in texts:
            if piece and size + len(text) > PIECE:
                found += self._piece(piece)
                piece, size = [], 0
            piece.append(text)
            size += len(text)
        return found + self._piece(piece) if piece else found

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per worker process, so that its tasks share the stems that they have learned."""
    return WordIds(path)


def projection(size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every id, and random directions of the buckets."""
    ids = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    directions = np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS))
    return (ids >> np.uint64(64 - 8)).astype(np.int64), directions


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers, by bit exchanges from the top level down."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(n):
            flip = (x[:, d] & bit) > 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, d] ^= swap
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            key = key << 1 | x[:, d] >> level & 1
    return key


def tokenized(docs: DataFrame, keys: list[str], tokenizer: str, text: str = "text") -> DataFrame:
    """``keys``, curve, n and the ids of every document, the end mark included."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(tokenizer)
        bucket, directions = projection(encode.tokenizer.get_vocab_size() + 1)
        for frame in frames:
            ids = encode.many(frame.pop("__text"))
            vectors = np.zeros((len(ids), BUCKETS))
            for i, b in enumerate(ids):
                vectors[i] = np.bincount(bucket[np.frombuffer(b, encode.kind)], minlength=BUCKETS)
            np.sqrt(vectors, out=vectors)
            vectors /= np.sqrt((vectors ** 2).sum(1, keepdims=True))
            cells = ((vectors @ directions) + 4) * ((1 << BITS) / 8)
            curve = hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64)) if len(ids) else []
            yield frame.assign(curve=curve, n=[len(b) // encode.kind.itemsize for b in ids], ids=ids)

    rows = docs.select(*keys, F.col(text).alias("__text"))
    return map_frames(rows, keys, run, "curve long, n long, ids binary")


def pack(
    docs: DataFrame, keys: list[str], tokenizer: str, length: int = LENGTH, text: str = "text",
) -> DataFrame:
    """One row per piece: ``keys``, start, length, ids (4 bytes each, little-endian), doc_tokens, sequence_id, offset.

    Documents are laid end to end in the order of their Hilbert keys and the line is cut every ``length`` ids, so only
    the last sequence is padded. A null text is an empty one and still has its end mark; equal keys are
    ordered by row, so copies of a third of all rows are dealt out like any others. An empty table packs to nothing.
    """
    tokens = stored(tokenized(docs, keys, tokenizer, text).withColumn("__uid", F.monotonically_increasing_id()), "pack-ids")
    places = running_total(tokens.select("__uid", "curve", "n"), ["curve", "__uid"], "n", "__place")
    placed = tokens.join(places.select("__uid", "__place"), "__uid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            row, start, size, ids = [], [], [], []
            for i, (place, n, packed) in enumerate(zip(frame["__place"], frame["n"], frame["ids"])):
                wide = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4")
                cuts = [0, *range(length - place % length, n, length), n]
                for a, b in zip(cuts, cuts[1:]):
                    row.append(i)
                    start.append(a)
                    size.append(b - a)
                    ids.append(wide[a:b].tobytes())
            out = frame[[*keys, "n", "__place"]].iloc[row].reset_index(drop=True)
            place = out.pop("__place") + np.array(start, np.int64)
            yield out.rename(columns={"n": "doc_tokens"}).assign(
                start=start, length=size, ids=ids, sequence_id=place // length, offset=place % length)

    return map_frames(
        placed.select(*keys, "n", "ids", "__place"), keys, run,
        "doc_tokens long, start long, length long, ids binary, sequence_id long, offset long")

