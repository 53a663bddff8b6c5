"""Toxic documents by a weighted lexicon.

Texts are folded (lower case, homoglyphs and accents to plain letters, digits and signs inside words to the letters
they stand for) and matched by one Aho-Corasick automaton. A match counts where it is a whole word, or the beginning
of one for lexicon entries that end in ``*``; matches inside an exception phrase don't. The score is the summed
weight per 100 words, so that length doesn't matter.

The lexicon has a fixed part and one fitted on labelled documents: words, and beginnings of words, that are common in
toxic documents (8 at least, and one in 100) and all but absent from clean ones (one for 50 toxic), weighted by their
log odds. Fitting reads a sample of at most ``SAMPLE`` labelled documents, chosen by a hash of their ids: toxic ones for up to half
of it, as they are rare, and clean ones for the rest. Of documents with the same label and the same smallest shingle hash, which
copies have, one is counted. Words and beginnings are counted and matched both folded and as written, that is
with their accents, as a toxic word may differ from a clean one in an accent only. A fitted entry is folded if that form
qualifies; else the form as written is taken if it does, and begins with ``=``.

Defined results: null texts, null ids and texts without a word score nothing and are never toxic; repeated rows, and
rows that share an id, give a result each; labels that are null or contradict each other are not used; without labels the fixed
lexicon is all there is; texts are matched whole, whatever their length. Columns beside id and text don't matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.minhash import shingle_hashes
from ragloom.llm.shared import keyed, table

#: Score (weight per 100 words) from which a document is toxic.
THRESHOLD = 0.3
#: Most labelled documents that the lexicon is fitted on.
SAMPLE = 12_000
#: Log odds of a fitted entry that weighs 1; weights are kept from 0.5 to 1.5.
ODDS = 6.0

LEXICON = {
    "idiot": 1.0, "idiots": 1.0, "moron": 1.0, "morons": 1.0, "scum": 1.0, "stupid": 0.8, "pathetic": 0.8, "worthless": 0.9, "disgusting": 0.8, "loser": 0.8, "losers": 0.8, "trash": 0.7, "clown": 0.7, "clowns": 0.7,
    "imbecile": 1.0, "dumbass": 1.2, "bastard": 1.2, "vermin": 0.9, "retard": 1.5, "subhuman": 1.5,
}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown nose", "sore loser rule", "pond scum", "scum line", "vermin control", "idiot proof")

_LOOKALIKES = dict(
    zip(
        "аеорсхуіјѕԁԛвнкмтгпиАВЕКМНОРСТХУІЈЅοαερτυικνβηωχΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıⅼßøłđœæ",
        [*"aeopcxyijsdqbhkmtrnuabekmhopctxyijsoaeptuiknbnwxabezhikmnoptyxagil", "ss", "o", "l", "d", "oe", "ae"],
        strict=True,
    )
)
_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
#: A run of word signs and stand-ins in which a stand-in touches a letter.
_MIXED = re.compile(r"(?:[a-z]+[0134578@$!|]+|[0134578@$!|]+[a-z]+)[a-z0134578@$!|]*")
_STANDIN = re.compile(r"[0134578@$!|]")
_MARKS = re.compile(r"[̀-ͯ]")


class _Written(dict):
    """By code point what a letter is as written: itself if it has an accent, else what folding makes of it."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        apart = unicodedata.normalize("NFKD", sign)
        base = _MARKS.sub("", apart).translate(_FOLD).lower()
        self[code] = sign if base != apart and len(base) == 1 and _MARKS.search(apart) else base
        return self[code]


_WRITTEN = _Written()


def fold(text: str) -> str:
    """Lower case without accents, homoglyphs or stand-ins; only letters that stand in for others change length."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_FOLD).lower()
    return _MIXED.sub(lambda m: _unmask(m[0]), text)


def forms(text: str) -> tuple[str, str]:
    """The text folded and, place by place the same but for accents that are kept, as written."""
    folded = fold(text)
    if text.isascii():
        return folded, folded
    written = unicodedata.normalize("NFC", text.lower()).translate(_WRITTEN)
    return folded, _STANDIN.sub(lambda m: folded[m.start()], written)


def _unmask(token: str) -> str:
    """Stand-ins that end a word are punctuation ("clown!"), those inside it are letters ("cl0wn")."""
    body = token.rstrip("!|")
    return body.translate(_SUBSTITUTES) + token[len(body) :]


class Matcher:
    """Lexicon and exceptions in one automaton, entries as written (``=``) in another."""

    def __init__(self, lexicon: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS):
        import ahocorasick

        self.folded, self.written = ahocorasick.Automaton(), ahocorasick.Automaton()
        entries: dict[tuple[bool, str], list] = {}
        for term, weight in lexicon.items():
            stem = term.rstrip("*")
            key = (True, forms(stem[1:])[1]) if stem.startswith("=") else (False, fold(stem))
            entries.setdefault(key, []).append((weight, term.endswith("*"), term))
        for phrase in exceptions:
            entries.setdefault((False, fold(phrase)), []).append((None, False, phrase))
        for (written, text), rules in entries.items():
            if text:
                (self.written if written else self.folded).add_word(text, (len(text), tuple(rules)))
        for automaton in (self.folded, self.written):
            automaton.make_automaton()

    def matches(self, folded: str, written: str | None = None) -> list[tuple[int, float, str]]:
        """(place, weight, term) of what counts; of several terms that begin at one place the weightiest, first folded ones."""
        found: dict[int, tuple[float, str]] = {}
        spared = []
        size = len(folded)
        for automaton, text in ((self.folded, folded), (self.written, folded if written is None else written)):
            for last, (length, rules) in automaton.iter(text) if len(automaton) else ():
                begin = last - length + 1
                if begin and text[begin - 1].isalnum():
                    continue
                whole = last + 1 == size or not text[last + 1].isalnum()
                for weight, prefix, term in rules:
                    if weight is None:
                        if whole:
                            spared.append((begin, last))
                    elif (whole or prefix) and weight > found.get(begin, (0.0, ""))[0]:
                        found[begin] = (weight, term)
        out, reach, k = [], -1, 0
        spared.sort()
        for at in sorted(found):  # both in order, so each exception is looked at once
            while k < len(spared) and spared[k][0] <= at:
                reach, k = max(reach, spared[k][1]), k + 1
            if at > reach:
                out.append((at, *found[at]))
        return out


def rate(matcher: Matcher, text: str) -> tuple[int, list[tuple[int, float, str]], float]:
    """Words, matches and score of a text."""
    n = len(text.split())
    hits = matcher.matches(*forms(text)) if n else []
    return n, hits, round(100 * sum(h[1] for h in hits) / n, 6) if n else 0.0


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """The fixed lexicon and what the labelled sample adds."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    told = told.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    hashed = told.withColumn("h", F.xxhash64("doc_id"))
    some = hashed.where("toxic = 1").orderBy("h", "doc_id").limit(sample // 2)
    drawn = some.unionByName(hashed.where("toxic = 0").orderBy("h", "doc_id").limit(sample - some.count()))
    rows = keyed(docs).join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id")

    # Copies would bring up the rare words of one document.
    @F.pandas_udf("long")
    def smallest(texts: pd.Series) -> pd.Series:
        hashed, first = shingle_hashes(pa.array(texts, pa.string()))
        some, out = np.flatnonzero(np.diff(first)), np.zeros(len(texts), np.uint64)
        if len(some):
            out[some] = np.minimum.reduceat(hashed, first[some])
        return pd.Series(out.view(np.int64))

    rows = rows.groupBy(smallest("text").alias("least"), "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else clean)[""] += 1
                for mark, form in zip(("", "="), forms(text), strict=True):
                    seen = set(re.findall(r"[^\W\d_]+", form))
                    (toxic if label else clean).update(mark + w for w in seen)
                    (toxic if label else clean).update({mark + w[:n] + "*" for w in seen for n in range(4, min(6, len(w) - 1) + 1)})
        terms = list(toxic.keys() | clean.keys())
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    counted = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return LEXICON | lexicon_of({r["term"]: (r["toxic"], r["clean"]) for r in counted.where("toxic >= 8 and 50 * clean <= toxic or term = ''").collect()})  # terms of a bounded sample


def lexicon_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Entries and their weights from the numbers of toxic and clean documents that have each term; the term "" has the totals."""
    n_toxic, n_clean = counts.get("", (0, 0))
    good = {t: n for t, n in counts.items() if t and n[0] >= 8 and 50 * n[1] <= n[0] and 100 * n[0] >= n_toxic}
    folded = chosen({t: n[0] for t, n in good.items() if not t.startswith("=")})
    written = chosen({t[1:]: n[0] for t, n in good.items() if t.startswith("=")})
    picked = [*folded, *("=" + t for t in written if not _covered(t, folded))]
    odds = lambda n, of: math.log((n + 0.5) / (of - n + 0.5))
    return {t: round(min(1.5, max(0.5, (odds(good[t][0], n_toxic) - odds(good[t][1], n_clean)) / ODDS)), 3) for t in picked}


def _covered(term: str, folded: set[str]) -> bool:
    """Whether folded entries match all that a term as written does."""
    stem = fold(term.rstrip("*"))
    return stem in folded and not term.endswith("*") or any(stem[:n] + "*" in folded for n in range(4, len(stem) + 1))


def chosen(good: dict[str, int]) -> set[str]:
    """Of terms that qualify: beginnings that gather more documents than each word under them, else the words.

    A beginning stands for the words under it only if those that qualify by themselves are not all there is to it.
    """
    heads = {t for t in good if t.endswith("*")}
    kept: set[str] = set()
    for t in sorted(good, key=lambda t: (len(t), t)):
        stem = t.rstrip("*")
        if any(stem[:n] + "*" in kept for n in range(4, len(stem) + (t not in heads))):
            continue
        if t in heads:
            under = [w for w in good if w not in heads and w.startswith(stem)]
            if len(under) < 3:
                continue
        kept.add(t)
    return kept


def scored(docs: DataFrame, lexicon: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS) -> DataFrame:
    """doc_id, n_words, n_hits, score, terms for every document with a word."""
    exceptions = tuple(exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, hits, score = rate(matcher, text)
                if n:
                    out.append((doc_id, n, len(hits), score, sorted({h[2] for h in hits})))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_words", "n_hits", "score", "terms"])

    return keyed(docs).mapInArrow(run, "doc_id long, n_words long, n_hits long, score double, terms array<string>")


def toxic_documents(docs: DataFrame, lexicon: dict[str, float], threshold: float = THRESHOLD, exceptions: Iterable[str] = EXCEPTIONS) -> DataFrame:
    """doc_id, n_words, n_hits, score, terms of the documents that reach the threshold."""
    return scored(docs, lexicon, exceptions).where(F.col("score") >= threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_documents(docs, fitted(spark, docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the threshold go, every other row stays as it is.

    Each row is decided by itself, so nothing is shuffled. Defined results: rows without a text or a word stay; rows
    without an id are decided by their text like all others; repeated rows fare alike.
    """
    lexicon = fitted(spark, docs, table(spark, sf_dir, "labels"))

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for texts in batches:
            yield texts.map(lambda t: t is not None and rate(matcher, t)[2] >= THRESHOLD).astype(bool)

    return docs.where(~toxic(F.col("text").cast("string")))
