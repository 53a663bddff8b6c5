"""Token ids of documents as binary blocks, entropy-coded by a static range asymmetric numeral system.

Texts are tokenised once, whole, into blocks of whole documents. Counts of tokens over all documents make one
frequency table, scaled to 2 ** BITS, that all blocks share. A block is encoded by itself with ``LANES`` interleaved
states: token i belongs to lane i % LANES, and one vectorised step moves all lanes by one token. Each block carries its
documents and their lengths, a checksum of the tokens, and checkpoints (all states, the place in the stream and a checksum
of the tokens up to the next) every ``CHECKPOINT`` tokens. Every part from one checkpoint to the next is decoded and
checked by itself, so the parts of a block are decoded in parallel.

Defined results: null texts and ids are left out; an empty text is a document of length 0; repeated rows are encoded
as often as they occur, and rows that share an id one by one; a document longer than a block is a block of its own; an empty
table gives the table row alone. Columns beside id and text don't matter. A part or block whose checksum fails raises.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.shared import cut, keyed, table

#: A byte-level BPE vocabulary as ranks, and how it splits texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 18
LANES = 512
CHECKPOINT = 1 << 16
#: The frequency table sums to 2 ** BITS.
BITS = 20
_LOW = np.uint64(1 << 31)


class Tokenizer:
    """The tokens of whole texts, remembering those of words.

    Where a space has no other white space beside it the splitting pattern always ends a piece before it, so the tokens of a
    text are those of its space-separated parts; texts with other white space beside a space are encoded directly.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.tokens, self.starts, self.memo = array("I"), array("q", [0]), _Memo(self)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens end to end, and how many each text has."""
        if len(self.memo) > self.remembered:
            self.forget()
        look, found, counts = self.memo.__getitem__, [], []
        for text in texts:
            first, *rest = text.split(" ")
            ids = list(map(look, rest))
            if -1 in ids or first[-1:].isspace() and rest:
                self.tokens.extend(self.encoding.encode_ordinary(text))
                self.starts.append(len(self.tokens))
                ids = [len(self.starts) - 2]
            elif first:
                self.tokens.extend(self.encoding.encode_ordinary(first))
                self.starts.append(len(self.tokens))
                ids.insert(0, len(self.starts) - 2)
            found.append(ids)
            counts.append(len(ids))
        ids = np.fromiter(chain.from_iterable(found), np.int64, sum(counts))
        starts = np.array(self.starts)
        sizes = starts[ids + 1] - starts[ids] if len(ids) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - sizes), sizes)
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        before = np.concatenate([[0], ends])
        return np.array(self.tokens, np.uint32)[at], before[edges[1:]] - before[edges[:-1]]


class _Memo(dict):
    def __init__(self, owner: Tokenizer):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            return -1
        o = self.owner
        o.tokens.extend(o.encoding.encode_ordinary(" " + word))
        o.starts.append(len(o.tokens))
        self[word] = len(o.starts) - 2
        return self[word]


def tokenised(docs: DataFrame, path: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """block, doc_ids, lengths, tokens (uint32, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = Tokenizer(path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        ids: list[int] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, lengths, held, size
            blob = np.concatenate(held).astype("<u4").tobytes() if held else b""
            out = pa.record_batch([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["block", "doc_ids", "lengths", "tokens"])
            number, ids, lengths, held, size = number + 1, [], [], [], 0
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                tokens, counts = tokenize(part.column("text").to_pylist())
                ends = np.cumsum(counts)
                for doc_id, n, end in zip(part.column("doc_id").to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                    if size and size + n > block:
                        yield flush()
                    ids.append(doc_id)
                    lengths.append(n)
                    held.append(tokens[end - n : end])
                    size += n
        if ids:
            yield flush()

    return keyed(docs).mapInArrow(run, "block long, doc_ids array<long>, lengths array<long>, tokens binary")


class Table:
    """Frequencies of the tokens that occur, scaled so that each has at least 1 and all sum to 2 ** BITS."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, n = tokens[by].astype(np.int64), counts[by].astype(np.float64)
        if len(n) > 1 << BITS:
            raise ValueError("more tokens than the table has room for")
        f = np.maximum(1, np.floor(n * ((1 << BITS) / n.sum()))).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        while len(f) and (off := (1 << BITS) - int(f.sum())):
            # What is over or missing goes to the commonest tokens, which feel it least.
            top = np.argsort(-f, kind="stable")[: max(1, min(len(f), abs(off)))]
            step = np.full(len(top), max(1, abs(off) // len(top)))
            f[top] += step if off > 0 else -np.minimum(step, f[top] - 1)
        self._set(f)

    def _set(self, f: np.ndarray) -> None:
        self.freqs = f.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64) if len(f) else np.zeros(0, np.uint64)
        self.at = np.full(int(self.tokens[-1]) + 1 if len(self.tokens) else 1, -1, np.int64)
        self.at[self.tokens] = np.arange(len(self.tokens))

    def to_bytes(self) -> bytes:
        return np.stack([self.tokens, self.freqs.astype(np.int64)]).astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        out = cls.__new__(cls)
        pair = np.frombuffer(raw, "<u4").reshape(2, -1).astype(np.int64)
        out.tokens = pair[0]
        out._set(pair[1])
        return out


def encode(tokens: np.ndarray, shared: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The words of the stream, and checkpoints: (token, word, states) from which decoding can begin; the first is the block's begin."""
    rows = -(-len(tokens) // lanes)
    at = shared.at[tokens.astype(np.int64)]
    freqs, starts = shared.freqs[at], shared.starts[at]
    x = np.full(lanes, _LOW, np.uint64)
    every = max(1, checkpoint // lanes)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    n = 0
    for row in range(rows - 1, -1, -1):
        f, c = freqs[row * lanes : (row + 1) * lanes], starts[row * lanes : (row + 1) * lanes]
        y = x[: len(f)]
        over = y >= f << np.uint64(63 - BITS)
        if over.any():
            words.append(y[over].astype(np.uint32))  # the low half
            n += len(words[-1])
            y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[: len(f)] = (q << np.uint64(BITS)) + (y - q * f) + c
        if row % every == 0:
            marks.append((row * lanes, n, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    return stream.astype("<u4").tobytes(), [(t, n - emitted, states) for t, emitted, states in reversed(marks)]


def decode(payload: bytes, mark: tuple[int, int, bytes], end: int, shared: Table, slots: np.ndarray | None = None) -> np.ndarray:
    """The tokens from a checkpoint up to ``end`` (the block's size, or the next checkpoint)."""
    begin, word, states = mark
    stream = np.frombuffer(payload, "<u4")
    x = np.frombuffer(states, "<u8").astype(np.uint64)
    lanes = len(x)
    slots = np.repeat(np.arange(len(shared.tokens)), shared.freqs.astype(np.int64)) if slots is None else slots
    out = np.empty(end - begin, np.uint32)
    for lo in range(begin, end, lanes):
        m = min(lanes, end - lo)
        y = x[:m]
        slot = y & np.uint64((1 << BITS) - 1)
        at = slots[slot.astype(np.int64)]
        out[lo - begin : lo - begin + m] = shared.tokens[at]
        y = shared.freqs[at] * (y >> np.uint64(BITS)) + slot - shared.starts[at]
        under = np.flatnonzero(y < _LOW)
        y[under] = y[under] << np.uint64(32) | stream[word : word + len(under)].astype(np.uint64)
        word += len(under)
        x[:m] = y
    return out


_COLUMNS = "block long, doc_ids array<long>, lengths array<long>, n_tokens long, crc long, checkpoints array<struct<token:long,word:long,states:binary,crc:long>>, payload binary"


def encoded(docs: DataFrame, path: str = TOKENIZER, block: int = BLOCK, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> DataFrame:
    """A row for each block, and one with block -1 whose payload is the frequency table."""
    spark = docs.sparkSession
    # Rows of a megabyte: the writer looks at a page's size after a few rows, not after its usual hundred.
    blocks = cut(tokenised(docs, path, block), "tokens", **{"parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "4"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("tokens"):
                c = np.bincount(np.frombuffer(blob.as_buffer(), "<u4").astype(np.int64), minlength=len(n))
                c[: len(n)] += n
                n = c
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["token", "n"])

    # As many rows as the vocabulary has tokens, whatever the input.
    counted = blocks.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    shared = Table(counted["token"].to_numpy(np.int64), counted["n"].to_numpy(np.int64))
    sent = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("tokens")[i].as_py()
                tokens = np.frombuffer(raw, "<u4")
                payload, marks = encode(tokens, sent.value, lanes, checkpoint)
                ends = [t for t, _, _ in marks[1:]] + [len(tokens)] * bool(marks)
                told = [{"token": t, "word": w, "states": s, "crc": zlib.crc32(raw[4 * t : 4 * end])} for (t, w, s), end in zip(marks, ends, strict=True)]
                yield pa.record_batch(
                    [
                        batch.column("block").slice(i, 1),
                        batch.column("doc_ids").slice(i, 1),
                        batch.column("lengths").slice(i, 1),
                        pa.array([len(tokens)]),
                        pa.array([zlib.crc32(raw)]),
                        pa.array([told], pa.list_(pa.struct([("token", pa.int64()), ("word", pa.int64()), ("states", pa.binary()), ("crc", pa.int64())]))),
                        pa.array([payload], pa.binary()),
                    ],
                    ["block", "doc_ids", "lengths", "n_tokens", "crc", "checkpoints", "payload"],
                )

    head = spark.createDataFrame([(-1, [], [], 0, zlib.crc32(shared.to_bytes()), [], shared.to_bytes())], _COLUMNS)
    return blocks.mapInArrow(run, _COLUMNS).unionByName(head)


def decoded_parts(blocks: DataFrame) -> DataFrame:
    """block, part, tokens (uint32, little-endian) of every part, each decoded from its own stretch of the stream."""
    raw = blocks.where("block = -1").select("payload").first()
    if raw is None:
        raise ValueError("the row with the frequency table is missing")
    sent = blocks.sparkSession.sparkContext.broadcast(bytes(raw["payload"]))  # as many entries as the vocabulary has tokens
    each = blocks.where("block >= 0").select("block", "n_tokens", "checkpoints", "payload", F.posexplode("checkpoints").alias("part", "mark"))
    after = F.get("checkpoints", F.col("part") + 1)
    stop = F.coalesce(after["word"], F.floor(F.length("payload") / 4))
    stretch = F.substring("payload", (4 * F.col("mark.word") + 1).cast("int"), (4 * (stop - F.col("mark.word"))).cast("int"))
    each = each.select("block", "part", "mark.states", "mark.crc", (F.coalesce(after["token"], "n_tokens") - F.col("mark.token")).alias("n"), stretch.alias("stretch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.from_bytes(sent.value)
        slots = np.repeat(np.arange(len(shared.tokens)), shared.freqs.astype(np.int64))
        for batch in batches:
            blobs = []
            for row in batch.to_pylist():
                blobs.append(decode(row["stretch"], (0, 0, row["states"]), row["n"], shared, slots).astype("<u4").tobytes())
                if zlib.crc32(blobs[-1]) != row["crc"]:
                    raise ValueError(f"part {row['part']} of block {row['block']} is damaged")
            yield pa.record_batch([batch.column("block"), batch.column("part"), pa.array(blobs, pa.binary())], ["block", "part", "tokens"])

    # The parts of a block go to different tasks.
    return each.repartition("block", "part").mapInArrow(run, "block long, part int, tokens binary")


def decoded(blocks: DataFrame) -> DataFrame:
    """doc_id, tokens of every document."""
    parts = decoded_parts(blocks).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "tokens"))).alias("parts"))
    whole = blocks.where("block >= 0").select("block", "doc_ids", "lengths", "crc").join(parts, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = b"".join(p["tokens"] for p in row["parts"] or [])
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"block {row['block']} is damaged")
                edges = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int32)
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(edges, pa.array(np.frombuffer(raw, "<u4").astype(np.int32)))], ["doc_id", "tokens"])

    return whole.mapInArrow(run, "doc_id long, tokens array<int>")


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
