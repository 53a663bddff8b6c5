"""Benchmark decontamination: passages of test items in training texts, found with an FM-index per training shard.

Words (runs of letters, marks and numbers, in lower case) of the test items get ids; every other word is one symbol
that no test phrase has. A shard's texts become one sequence of ids in which runs of that symbol shrink to one and
stretches with fewer words than the shortest phrase are left out; neither changes what can be found. The shard is indexed, every
test phrase (each run of ``n`` words of an item, or the whole item where it is shorter but has ``least`` words) is
searched backwards through the wavelet tree, occurrences are located by sampled suffix positions, and overlapping or
touching ones become one span.

Every task holds the phrases of a block of items of about ``ITEM_BYTES``; a larger benchmark is searched in several
blocks, one run over the texts for each, whose spans are merged.

Defined results: null texts, null ids and null items hold nothing; items with fewer than ``least`` words are not
searched, as they would match by chance; repeated rows give each their spans, once for each distinct pair of id and
text; texts that share an id are told apart by their MD5. Texts are searched whole; columns beside id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.fmindex import FMIndex
from ragloom.llm.shared import WORD_CLASS, buffers, cut, fresh, keyed, named, normalised, slices, table, word_hashes, words

#: Words in a phrase, and the fewest for an item that is shorter than a phrase.
PHRASE = 13
LEAST = 8
#: Bytes of text in a shard: the index of one is all that a task keeps in memory.
SHARD_BYTES = 8 << 20
#: Bytes of test items that a task holds at once.
ITEM_BYTES = 32 << 20

_WORDS = regex.compile(rf"[{WORD_CLASS}]+")


class Phrases:
    """The distinct phrases of the test items as rows of word ids; ids are places among sorted word hashes, from 2."""

    def __init__(self, items: list[str], n: int, least: int):
        data, offsets = buffers(normalised(pa.array(items, pa.string())))
        starts, ends, before = words(data, offsets)
        hashed = word_hashes(data, starts, ends)
        counts = np.diff(before)
        self.n = n
        self.vocabulary = np.unique(hashed)
        ids = np.searchsorted(self.vocabulary, hashed) + 2
        rows = set()
        for b, m in zip(before[:-1], counts, strict=True):
            if m >= least:
                size = min(n, int(m))
                rows.update((-1,) * (n - size) + tuple(ids[i : i + size].tolist()) for i in range(b, b + m - size + 1))
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, n)
        self.sizes = (self.rows >= 0).sum(1)
        self.shortest = int(self.sizes.min()) if len(self.rows) else n

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        """Ids of words, 1 for those that no item has."""
        if not len(self.vocabulary):
            return np.ones(len(hashed), np.int64)
        # A small table of hash ends tells nearly all foreign words before the search.
        at = np.searchsorted(self.vocabulary, hashed)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashed, at + 2, 1)


def occurrences(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of one shard: place of the text, first word, word after the last."""
    none = np.empty(0, np.int64)
    data, offsets = buffers(normalised(texts))
    starts, ends, before = words(data, offsets)
    if not len(starts) or not len(phrases.rows):
        return none, none, none
    ids = phrases.ids(word_hashes(data, starts, ends))
    # Stretches of known words within one text, long enough for a phrase.
    known = ids > 1
    fresh = known.copy()
    fresh[1:] &= ~known[:-1]
    firsts = before[:-1][before[:-1] < before[1:]]
    fresh[firsts] = known[firsts]
    opens = np.flatnonzero(fresh)
    if not len(opens):
        return none, none, none
    stops = np.minimum.reduce([np.append(opens[1:], len(ids)), _next(~known, opens), before[np.searchsorted(before, opens, "right")]])
    long = stops - opens >= phrases.shortest
    opens, stops = opens[long], stops[long]
    if not len(opens):
        return none, none, none
    sizes = stops - opens + 1  # with the symbol that ends each
    place = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(place[-1]) + np.repeat(opens - place[:-1], sizes)
    sequence = np.where(source < np.repeat(stops, sizes), ids[np.minimum(source, len(ids) - 1)], 1)
    index = FMIndex(sequence, len(phrases.vocabulary) + 2)
    lo, hi = index.search(phrases.rows)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none, none, none
    n_found = (hi - lo)[found]
    spots = np.arange(n_found.sum()) + np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n_found)[:-1]]), n_found)
    first = source[index.locate(spots)]
    last = first + np.repeat(phrases.sizes[found], n_found)
    by = np.lexsort((last, first))
    first, last = first[by], last[by]
    text = np.searchsorted(before, first, "right") - 1
    reach = np.maximum.accumulate(last)  # places grow from text to text, so no span reaches into the next
    new = np.concatenate([[True], (first[1:] > reach[:-1]) | (text[1:] != text[:-1])])
    begins = np.flatnonzero(new)
    return text[begins], first[begins] - before[text[begins]], reach[np.append(begins[1:], len(first)) - 1] - before[text[begins]]


def _next(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first set flag at or after each place."""
    at = np.flatnonzero(flags)
    return np.append(at, len(flags))[np.searchsorted(at, places)]


def contamination(docs: DataFrame, items: list[str], n: int = PHRASE, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, th (hash of the text), text_md5, span (from 0), first_word, end_word, begin_char, end_char; ends are exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, n, least)
        for batch in batches:
            _, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets, shard_bytes):
                part = batch.slice(lo, hi - lo)
                at, first, end = occurrences(part.column("text"), phrases)
                out: dict[str, list] = {c: [] for c in ("doc_id", "th", "text_md5", "span", "first_word", "end_word", "begin_char", "end_char")}
                for k in np.unique(at):
                    text = part.column("text")[k].as_py()
                    ranges, md5 = [m.span() for m in _WORDS.finditer(text)], hashlib.md5(text.encode()).hexdigest()
                    for i, j in enumerate(np.flatnonzero(at == k)):
                        a, b = int(first[j]), int(end[j])
                        for c, v in zip(out, (part.column("doc_id")[k].as_py(), part.column("th")[k].as_py(), md5, i, a, b, ranges[a][0], ranges[b - 1][1]), strict=True):
                            out[c].append(v)
                yield pa.record_batch([pa.array(v, pa.string() if c == "text_md5" else pa.int64()) for c, v in out.items()], list(out))

    texts = keyed(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return texts.mapInArrow(run, "doc_id long, th long, text_md5 string, span long, first_word long, end_word long, begin_char long, end_char long")


def item_blocks(spark: SparkSession, sf_dir: str, most: int | None = None) -> Iterator[list[str]]:
    """The distinct test items in blocks of about ``most`` bytes, by a hash."""
    items = table(spark, sf_dir, "benchmark").select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (most or ITEM_BYTES)))
    blocked = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))
    for k in range(n):
        yield [r["text"] for r in blocked.where(F.col("block") == k).collect()]


def merged(parts: list[DataFrame]) -> DataFrame:
    """Spans of several blocks of items as if they had been searched at once."""
    if len(parts) == 1:
        return parts[0]
    text = Window.partitionBy("doc_id", "th").orderBy("first_word", "end_word")
    rows = reduce(DataFrame.unionByName, parts).distinct()
    reach = F.max("end_word").over(text.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("new", F.when(F.col("first_word") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("doc_id", "th", "text_md5", "run").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.min("begin_char").alias("begin_char"), F.max("end_char").alias("end_char"))
    return whole.select("doc_id", "th", "text_md5", (F.col("run") - 1).alias("span"), "first_word", "end_word", "begin_char", "end_char")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merged([contamination(docs, items) for items in item_blocks(spark, sf_dir)]).drop("th").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are cut out of texts; every row stays.

    Each text is decided by itself, so nothing is shuffled; only the spans of several blocks of items meet their texts by a join.

    Defined results: rows without a text stay as they are; rows without an id are searched by their text like all others (but
    for a benchmark of several blocks, where they stay as they are); repeated rows, and rows that share an id, are edited one by
    one; a text of which nothing stays is an empty text. n_chars, where there is one, follows the text.
    """
    blocks = list(item_blocks(spark, sf_dir))
    if len(blocks) > 1:
        return _cut_out(docs, merged([contamination(docs, items) for items in blocks]))
    items = blocks[0]

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(items, PHRASE, LEAST)
        for texts in batches:
            out = texts.tolist()
            held = [i for i, t in enumerate(out) if t is not None]
            whole = pa.array([out[i] for i in held], pa.large_string())
            _, offsets = buffers(whole)
            for lo, hi in slices(offsets, SHARD_BYTES):
                at, first, end = occurrences(whole.slice(lo, hi - lo), phrases)
                for k in np.unique(at):
                    text = out[held[lo + k]]
                    ranges = [m.span() for m in _WORDS.finditer(text)]
                    kept, begin = [], 0
                    for a, b in zip(first[at == k], end[at == k], strict=True):
                        kept.append(text[begin : ranges[a][0]])
                        begin = ranges[b - 1][1]
                    out[held[lo + k]] = "".join(kept) + text[begin:]
            yield pd.Series(out, dtype=object)

    edited = docs.withColumn("text", cleaned(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return edited.select(*docs.columns)


def _cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    rows, key, th = named(docs)
    (places,) = fresh(rows, "spans")
    by_text = cut(spans.groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.array_sort(F.collect_list(F.array("begin_char", "end_char"))).alias(places)), "spans")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            for begin, end in list(found if found is not None and text is not None else [])[::-1]:
                text = text[:begin] + text[end:]
            out.append(text)
        return pd.Series(out, dtype=object)

    edited = rows.join(by_text.hint("shuffle_hash"), [key, th], "left").withColumn("text", cleaned(F.col("text").cast("string"), places))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return edited.select(*docs.columns)


SQL = rf"""
with pieces as (select doc_id, regexp_extract_all(text, '[^{WORD_CLASS}]*[{WORD_CLASS}]+') as ps from documents where doc_id is not null and text is not null),
cut as (select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) as k from pieces),
tokens as (select doc_id, k - 1 as k, lower(regexp_replace(piece, '[^{WORD_CLASS}]+', '', 'g')) as word,
    sum(length(piece)) over (partition by doc_id order by k)::bigint as stop, length(regexp_replace(piece, '[^{WORD_CLASS}]+', '', 'g')) as size from cut),
texts as (select doc_id, list(word order by k) as ws from tokens group by doc_id),
items as (select distinct list_transform(regexp_extract_all(text, '[{WORD_CLASS}]+'), lambda w: lower(w)) as ws from benchmark where text is not null),
phrases as (select distinct array_to_string(ws[i : i + least({PHRASE}, len(ws)) - 1], ' ') as phrase, least({PHRASE}, len(ws)) as n
    from items, lateral (select unnest(generate_series(1, len(ws) - least({PHRASE}, len(ws)) + 1)) as i) where len(ws) >= {LEAST}),
sizes as (select distinct n from phrases),
grams as (select doc_id, i - 1 as k, n, array_to_string(ws[i : i + n - 1], ' ') as phrase from texts, sizes, lateral (select unnest(generate_series(1, len(ws) - n + 1)) as i)),
hits as (select doc_id, k, max(k + n) as stop from grams join phrases using (n, phrase) group by doc_id, k),
edges as (select *, max(stop) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding) as reach from hits),
runs as (select *, sum(case when reach is null or k > reach then 1 else 0 end) over (partition by doc_id order by k) as run from edges),
spans as (select doc_id, run - 1 as span, min(k) as first_word, max(stop) as end_word from runs group by doc_id, run)
select s.doc_id, d.md5 as text_md5, s.span::bigint as span, s.first_word, s.end_word, (a.stop - a.size)::bigint as begin_char, b.stop as end_char
from spans s join (select doc_id, md5(text) as md5 from documents) d using (doc_id) join tokens a on a.doc_id = s.doc_id and a.k = s.first_word join tokens b on b.doc_id = s.doc_id and b.k = s.end_word - 1
"""
