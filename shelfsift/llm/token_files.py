"""Files of token ids: static range asymmetric numeral system over shared frequency tables.

A folder holds ``frequencies`` (the shared table), ``ids/`` (files of independent blocks) and ``manifest`` (Parquet: where
every block lies). A block is, little-endian throughout:

    magic, lanes, checkpoints, ids, words, checksum of the ids, checksum of what follows, bytes of the document table
    document table: zlib of JSON [[key as text or null, number of ids], ...]
    checkpoints: the word each one starts at, then every lane's state there
    words: 32 bits each

Id i of a block is coded by lane i modulo lanes; all lanes share the words in the order in which a decoder asks for them.
A checkpoint stands before the first id and every CHECKPOINT steps, so that decoding may start at any of them.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.llm.common import map_frames, stored
from shelfsift.llm.packing import word_ids

#: Ids of a block, unless its last document has more; lanes of a long block; steps of all lanes between checkpoints.
BLOCK, LANES, CHECKPOINT = 1 << 18, 1024, 128
#: States stay in [2^31, 2^63) and shed 32 bits at a time.
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
HEADER, MAGIC = struct.Struct("<4sIIQQIII"), b"IDS1"
TABLE, TABLE_MAGIC = struct.Struct("<4sIII"), b"FRQ1"


def quantised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Shares of 2^bits in proportion to the counts, one at least for every id."""
    spare = (1 << bits) - len(counts)
    total = int(counts.sum())
    shares = np.ones(len(counts), np.uint64)
    if total:
        shares += np.array([int(c) * spare // total for c in counts.tolist()], np.uint64)
    shares[int(counts.argmax())] += np.uint64((1 << bits) - int(shares.sum()))
    return shares


class Coder:
    """Codes ids by the shares of one frequency table."""

    def __init__(self, shares: np.ndarray, bits: int):
        self.shares, self.bits = shares.astype(np.uint64), np.uint64(bits)
        self.starts = np.cumsum(self.shares) - self.shares
        self.owner = np.repeat(np.arange(len(shares), dtype=np.uint32), shares.astype(np.int64))

    def to_bytes(self) -> bytes:
        body = self.shares.astype("<u4").tobytes()
        return TABLE.pack(TABLE_MAGIC, int(self.bits), len(self.shares), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Coder:
        magic, bits, size, check = TABLE.unpack_from(data)
        body = data[TABLE.size:TABLE.size + 4 * size]
        if magic != TABLE_MAGIC or zlib.crc32(body) != check:
            raise ValueError("damaged frequency table")
        return cls(np.frombuffer(body, "<u4"), bits)

    def encode(self, ids: np.ndarray, table: list, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        """One block of ``ids`` with its document table; coded from the last id to the first."""
        n = len(ids)
        lanes = max(1, min(lanes, n // every))
        share, start = self.shares[ids], self.starts[ids]
        limit = share << (np.uint64(63) - self.bits)
        state = np.full(lanes, LOW, np.uint64)
        shed, points = [], []
        steps = -(-n // lanes)
        for step in range(steps - 1, -1, -1):
            own = slice(step * lanes, min(n, (step + 1) * lanes))
            x, f = state[:own.stop - own.start], share[own]
            full = x >= limit[own]
            shed.append(x[full].astype("<u4"))
            np.right_shift(x, WORD, out=x, where=full)
            whole, rest = np.divmod(x, f)
            np.add((whole << self.bits) + start[own], rest, out=x)
            if step % every == 0:
                points.append((sum(map(len, shed[len(shed) - min(every, steps - step):])), state.copy()))
        # Words before a checkpoint are those that the steps from the block's start up to it ask for.
        sizes = [size for size, _ in points[::-1]]
        places = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8") if points else np.zeros(0, "<u8")
        states = np.array([s for _, s in points[::-1]], "<u8")
        words = np.concatenate(shed[::-1]) if shed else np.zeros(0, "<u4")
        docs = zlib.compress(json.dumps(table).encode())
        body = docs + places.tobytes() + states.tobytes() + words.tobytes()
        check = zlib.crc32(np.asarray(ids, "<u4").tobytes())
        return HEADER.pack(MAGIC, lanes, len(points), n, len(words), check, zlib.crc32(body), len(docs)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None, every: int = CHECKPOINT):
        """(ids from ``first`` to before ``last``, document table); starts at the checkpoint before ``first``."""
        magic, lanes, points, n, count, check, body_check, docs = HEADER.unpack_from(block)
        body = memoryview(block)[HEADER.size:]
        if magic != MAGIC or zlib.crc32(body) != body_check:
            raise ValueError("damaged block")
        last = n if last is None else min(last, n)
        table = json.loads(zlib.decompress(body[:docs]))
        ids = np.zeros(n, np.uint32)
        if points and first < last:
            places = np.frombuffer(body, "<u8", points, docs)
            states = np.frombuffer(body, "<u8", points * lanes, docs + 8 * points).reshape(points, lanes)
            words = np.frombuffer(body, "<u4", count, docs + 8 * points * (1 + lanes)).astype(np.uint64)
            at = first // (lanes * every)
            state, place = states[at].astype(np.uint64), int(places[at])
            mask = np.uint64((1 << int(self.bits)) - 1)
            for low in range(at * every * lanes, last, lanes):
                high = min(n, low + lanes)
                x = state[:high - low]
                slot = x & mask
                own = self.owner[slot]
                ids[low:high] = own
                x = self.shares[own] * (x >> self.bits) + slot - self.starts[own]
                short = np.flatnonzero(x < LOW)
                x[short] = x[short] << WORD | words[place:place + len(short)]
                place += len(short)
                state[:high - low] = x
        if first == 0 and last == n and zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("ids differ from their checksum")
        return ids[first:last], table


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _read(path: str, at: int = 0, length: int | None = None) -> bytes:
    system, place = _opened(path)
    with system.open_input_file(place) as file:
        return file.read_at(file.size() if length is None else length, at)


def _write_frequencies(spark: SparkSession, ids: DataFrame, kind: str, size: int, folder: str) -> Coder:
    """Counts every id of the corpus and writes the shared table; a row per id of the vocabulary reaches the driver."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size, np.int64)
        for frame in frames:
            for packed in frame["ids"]:
                seen += np.bincount(np.frombuffer(packed, kind), minlength=size)
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"id": found, "n": seen[found]})

    counts = np.zeros(size, np.int64)
    for token, n in ids.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[token] = n
    bits = max(20, size.bit_length() + 2)
    coder = Coder(quantised(counts, bits), bits)
    system, place = _opened(folder)
    system.create_dir(f"{place}/ids", recursive=True)
    with system.open_output_stream(f"{place}/frequencies") as file:
        file.write(coder.to_bytes())
    return coder


def write(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Writes the ids of every whole text, each with an end mark, in ascending order of ``key`` to files under ``folder``.

    A null text is an empty one and has its end mark; null keys come first; rows of one key follow each other in any
    order, dealt out over tasks like others. A text longer than a block makes a block of its own. An empty table gives
    no blocks. Other columns are not read. Every attempt of a task writes a file of its own and the manifest names those
    of the attempts that were committed, so lost executors leave unread files at most.
    """
    spark = docs.sparkSession
    kind, size = word_ids(tokenizer).kind.str, word_ids(tokenizer).tokenizer.get_vocab_size()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer)
        for frame in frames:
            yield frame[["key"]].assign(ids=ids_of.many(frame["text"]))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids = stored(
        map_frames(rows, ["key"], encode, "ids binary").withColumn("uid", F.monotonically_increasing_id()), "token-ids")
    coder = _write_frequencies(spark, ids, kind, size, folder)
    shares, bits = coder.shares, int(coder.bits)

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, system, name, out, at, number = Coder(shares, bits), None, "", None, 0, 0
        table, held, waiting = [], [], 0

        def blocks(done: bool) -> Iterator[dict]:
            nonlocal system, name, out, at, number, table, held, waiting
            if not table or (waiting < block and not done):
                return
            if out is None:
                system, place = _opened(folder)
                name = f"{part:06d}-{uuid.uuid4().hex}"
                out = system.open_output_stream(f"{place}/ids/{name}")
            data = coder.encode(np.concatenate(held), table)
            out.write(data)
            yield {"part": part, "block": number, "path": f"{folder}/ids/{name}", "at": at, "length": len(data),
                   "n_docs": len(table), "n_ids": waiting}
            at, number = at + len(data), number + 1
            table, held, waiting = [], [], 0

        part = 0
        for frame in frames:
            for part, name_of, packed in zip(frame["part"], frame["key"], frame["ids"]):
                own = np.frombuffer(packed, kind)
                table.append([name_of, len(own)])
                held.append(own)
                waiting += len(own)
                for row in blocks(False):
                    yield pd.DataFrame([row])
        for row in blocks(True):
            yield pd.DataFrame([row])
        if out is not None:
            out.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(parts, "key", "uid").sortWithinPartitions("key", "uid")
    dealt = dealt.select(F.spark_partition_id().alias("part"), F.col("key").cast("string").alias("key"), "ids")
    dealt.mapInPandas(
        save, "part int, block int, path string, at long, length long, n_docs long, n_ids long",
    ).write.parquet(f"{folder}/manifest")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block of the files with the number of ids before it; the totals of the files pass the driver."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    start, starts = 0, []
    for part, total in sorted(map(tuple, manifest.groupBy("part").agg(F.sum("n_ids")).collect())):
        starts.append((part, start))
        start += total
    offsets = spark.createDataFrame(starts, "part int, __start long")
    before = F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    found = manifest.join(F.broadcast(offsets), "part")  # a row per file
    return found.withColumn("start", F.col("__start") + F.coalesce(before, F.lit(0))).drop("__start")


def read(spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """Per document, from the files: ``key``, start (ids of all documents before it), n_tokens, ids (4 bytes each).

    Blocks are decoded independently of each other; damaged ones raise an error.
    """
    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = None
        for frame in frames:
            coder = coder or Coder.from_bytes(_read(f"{folder}/frequencies"))
            for path, at, length, start in zip(frame["path"], frame["at"], frame["length"], frame["start"]):
                ids, table = coder.decode(_read(path, at, length))
                cuts = np.cumsum([0] + [n for _, n in table])
                packed = ids.astype("<u4").tobytes()
                yield pd.DataFrame({
                    "key": [name for name, _ in table], "start": start + cuts[:-1], "n_tokens": np.diff(cuts),
                    "ids": [packed[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks(spark, folder).select("path", "at", "length", "start").repartition(parts, "path", "at")
    found = found.mapInPandas(load, "key string, start long, n_tokens long, ids binary")
    return found.select(F.col("key").cast(kind).alias(key), "start", "n_tokens", "ids")


def read_span(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(start, ids) pieces of the ids from place ``first`` to before ``last``; only the blocks they lie in are opened."""
    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = None
        for frame in frames:
            coder = coder or Coder.from_bytes(_read(f"{folder}/frequencies"))
            for path, at, length, start in zip(frame["path"], frame["at"], frame["length"], frame["start"]):
                low = max(0, first - start)
                ids, _ = coder.decode(_read(path, at, length), low, last - start)
                yield pd.DataFrame({"start": [start + low], "ids": [ids.astype("<u4").tobytes()]})

    found = blocks(spark, folder).filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    return found.select("path", "at", "length", "start").mapInPandas(load, "start long, ids binary")
