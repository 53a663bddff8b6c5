"""Column expressions on text, which stay in the JVM, and the count of tokens for what runs in Python."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"(?<=[!?.])\s+(?=[0-9A-Z])"
PARAGRAPH_BREAK = r"\n\s*\n+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def pieces(c: Column | str, pattern: str) -> Column:
    """The text split at a pattern, stripped, without blank parts."""
    return F.filter(F.transform(F.split(strip(c), pattern), strip), lambda p: p != "")


def sentences(c: Column | str) -> Column:
    return pieces(c, SENTENCE_BREAK)


def paragraphs(c: Column | str) -> Column:
    return pieces(c, PARAGRAPH_BREAK)


def passages(c: Column | str) -> Column:
    """Parts that headings like "passage 3:" separate."""
    return pieces(c, r"(?i)passage \d+:")


def normal(c: Column | str) -> Column:
    """Lower case, one space between words, none around."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    """The distinct runs of ASCII letters and digits in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), 0))


def count_tokens(c: Column | str) -> Column:
    """A native stand-in for a tokenizer: words and single signs; 0 for an empty text."""
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("long")


_TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^ \t\n\x0b\f\r\p{L}\p{N}_]")
_ASCII_TOKEN = re.compile(r"\w+|[^\w\s]", re.A)  # the same for ASCII, faster


def counted(text: str | None) -> int:
    """What ``count_tokens`` gives, in Python."""
    return len((_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)) if text else 0


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def within(a: Column | str, b: Column | str) -> Column:
    """Either text contains the other."""
    a, b = col(a), col(b)
    return F.contains(a, b) | F.contains(b, a)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def noise_key(c: Column | str) -> Column:
    """The sorted noise types joined by "+", "clean" without any."""
    joined = F.array_join(F.array_sort(col(c)), "+")
    return F.when(F.coalesce(joined, F.lit("")) == "", "clean").otherwise(joined)


def html_text(c: Column | str) -> Column:
    """Text nodes of HTML joined by newlines, without scripts, styles and comments."""
    plain = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", "")
    parts = F.filter(F.transform(F.split(plain, r"(?s)<[^>]*>"), strip), lambda p: p != "")
    text = F.array_join(parts, "\n")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def unit(key: Column) -> Column:
    """A number in [0, 1) from a key, the same in every engine: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
