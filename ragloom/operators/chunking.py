"""Documents to chunks.

A text is split into units, its units are counted and packed into windows in one Arrow-batched pass, linear in the text: the
fold over windows is sequential, and the JVM's functions on arrays would evaluate the split once for each use of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T

SIZE, OVERLAP = 512, 64
#: Characters of chunks that leave a task at once.
HELD = 1 << 20


def pack(units: list[str], sizes: list[int], size: int, overlap: int, joiner: str = " ") -> list[str]:
    """Windows of at most ``size`` tokens; each begins with the last units of the one before, up to ``overlap`` tokens.

    A unit that is larger by itself is a window by itself, and overlap and a unit together may exceed the size.
    """
    out: list[str] = []
    begin, held = 0, 0  # the open window is units[begin:i] with so many tokens
    for i, n in enumerate(sizes):
        if i > begin and held + n > size:
            out.append(joiner.join(units[begin:i]))
            first, begin, held = begin, i, 0
            while overlap > 0 and begin > first and held + sizes[begin - 1] <= overlap:
                begin -= 1
                held += sizes[begin]
        held += n
    if units:
        out.append(joiner.join(units[begin:]))
    return out


_BLANKS = " \t\n\x0b\f\r"
_SENTENCES, _PARAGRAPHS = re.compile(T.SENTENCE_BREAK, re.A), re.compile(T.PARAGRAPH_BREAK, re.A)

Counter = Callable[[str], int]


def pieces(text: str, pattern: re.Pattern) -> list[str]:
    """What ``T.pieces`` gives for the pattern."""
    return [p for part in pattern.split(text.strip(_BLANKS)) if (p := part.strip(_BLANKS))]


def remembered(count: Counter) -> Counter:
    """The same counter, which counts a text once that is a unit and then a chunk; what it remembers is some four times HELD characters."""
    known: dict[str, int] = {}
    held = 0

    def run(text: str) -> int:
        nonlocal held
        if (n := known.get(text)) is None:
            if held > 4 * HELD:
                known.clear()
                held = 0
            n = known[text] = count(text)
            held += len(text)
        return n

    return run


def _sentence_windows(text: str, size: int, overlap: int, count: Counter, joiner: str = " ") -> list[str]:
    units = pieces(text, _SENTENCES)
    return pack(units, [count(u) for u in units], size, overlap, joiner)


def _auto(text: str, size: int, overlap: int, count: Counter) -> list[str]:
    units, sizes = [], []
    for p in pieces(text, _PARAGRAPHS):
        n = count(p)
        parts = [p] if n <= size else pieces(p, _SENTENCES)
        units += parts
        sizes += [n] if n <= size else [count(u) for u in parts]
    return pack(units, sizes, size, overlap, "\n\n")


def _by_paragraph(text: str, size: int, overlap: int, count: Counter) -> list[str]:
    """Small paragraphs are chunks, large ones are packed by sentence."""
    out = []
    for p in pieces(text, _PARAGRAPHS):
        out += [p] if count(p) <= size else _sentence_windows(p, size, overlap, count)
    return out


STRATEGIES = {"auto": _auto, "sentences": _sentence_windows, "paragraphs": _by_paragraph}


def in_parts(split: Callable[[str], list[str]], count: Counter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, index, text, token_count of batches of doc_id and text; what is held of a batch is one text and some HELD characters of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            at, index, out, held = [], [], [], 0
            for i in range(len(texts)):
                parts = [] if (t := texts[i].as_py()) is None else split(t)
                at += [i] * len(parts)
                index += range(len(parts))
                out += parts
                held += sum(map(len, parts))
                if held > HELD or i == len(texts) - 1:
                    yield pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(out, pa.string()), pa.array(map(count, out), pa.int64())], ["doc_id", "index", "text", "token_count"])
                    at, index, out, held = [], [], [], 0

    return run


def last_documents(docs: DataFrame, order: str) -> DataFrame:
    """Of documents that share an id the last by the column ``order``."""
    return docs.groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), order).alias("d")).select("d.*")


def chunks(docs: DataFrame, strategy: Callable[[str], list[str]] | str = "auto", size: int = SIZE, overlap: int = OVERLAP, count: Counter | None = None, order: str | None = None) -> DataFrame:
    """chunk_id, doc_id, index, text, token_count of docs (doc_id, text).

    A strategy may also be a function from text to a list of texts, and count one from text to its number of tokens (words
    and signs without one). Blank chunks are left out and keep their index. Ids of chunks are as distinct as those of documents;
    with order, the name of a column, the last document of an id wins. Null texts have no chunks.
    """
    if not callable(strategy) and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    own, count = strategy, remembered(count or T.counted)

    split = own if callable(own) else lambda t: STRATEGIES[own](t, size, overlap, count)
    docs = last_documents(docs, order) if order else docs
    rows = docs.select("doc_id", "text").mapInArrow(in_parts(split, count), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, index int, text string, token_count long")
    rows = rows.where(T.strip("text") != "")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#chunk"), F.col("index")).alias("chunk_id"), "doc_id", "index", "text", "token_count")


def passages(docs: DataFrame) -> DataFrame:
    """title, text: one passage for each title, the first by ord; docs: ord, title, text."""
    return docs.groupBy("title").agg(F.min_by("text", "ord").alias("text")).withColumn("passage_id", F.substring(F.sha1("title"), 1, 16))
