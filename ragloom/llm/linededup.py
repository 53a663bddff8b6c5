"""Repeated runs of lines, found on a suffix array over line ids, and deletion of their later copies.

Every line gets an id; suffixes of the id sequences are ranked by their first line, then by prefix doubling on the
first 2, 4, 8... lines, each step refining the ranks within the buckets of the step before. Ranks count the suffixes
that sort before, so each step is the suffix array sorted to that depth, and an interval of equal ranks is an interval
of a longest common prefix of at least that many lines. An interval of any depth w between 2^k and 2^(k+1) is the
intersection of two intervals of depth 2^k, one at the suffix and one w - 2^k lines on.

A run counts from ``min_words`` words. A maximal repeated run is exactly the union of its shortest qualifying windows,
those that begin at each line and those that end at each line, so doubling goes on to the depth of the longest such
window. Of the occurrences of a window the first, in the order of doc_id and line, stays; the others are deleted,
but for lines that they have in common with the first: of a passage that repeats itself without a break one whole
window stays. Every deleted line has a copy that stays, in the same context.

Lines that occur once end every run, and stretches of repeated lines with too few words hold none: both are left out
before ranking, which changes no result.

Defined results: a line's words are its single spaces plus one, so an empty line counts one. Null ids and null texts
are left alone. Rows that repeat id and text are one document and lose the same lines; rows that share an id but not the
text are different documents, ordered by a hash of the text. Columns beside id and text don't matter, and texts of any
length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.shared import cut, fresh, keyed, named, table

MIN_WORDS = 50
#: Ranks of second lines are numbered in so many slots, so that the lines after a common one are never one task.
SLOTS = 1024


def _lines(docs: DataFrame) -> DataFrame:
    base = keyed(docs).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n_words = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return base.select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), n_words.alias("nw"))


def _ranked(active: DataFrame) -> DataFrame:
    """h, g, rank: how many of the active lines have a smaller id."""
    ids = active.groupBy("h", "g").agg(F.count("*").alias("n")).withColumn("slot", F.shiftright("h", 52))
    # 4096 slots whatever the input, so one task adds them up.
    slots = ids.groupBy("slot").agg(F.sum("n").alias("n"))
    slots = slots.select("slot", (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("slot").orderBy("h", "g")) - F.col("n")
    return ids.select("slot", "h", "g", inside.alias("inside")).join(F.broadcast(slots), "slot").select("h", "g", (F.col("before") + F.col("inside") + 1).alias("rank"))


def _at(ranks: str, i: Column) -> Column:
    """The rank at a place, 0 past the end."""
    return F.coalesce(F.get(F.col(ranks), i), F.lit(0))


def deleted_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, begin, end: the lines (end exclusive) of windows that have an earlier occurrence, less those of the first one."""
    lines = cut(_lines(docs), "lines")
    twice = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    repeated = lines.join(twice, ["h", "g"]).dropDuplicates(["doc_id", "th", "pos"])
    doc = Window.partitionBy("doc_id", "th").orderBy("pos")
    stretches = repeated.withColumn("seg", F.col("pos") - F.row_number().over(doc))
    whole = Window.partitionBy("doc_id", "th", "seg")
    ordered = whole.orderBy("pos")
    active = stretches.withColumn("total", F.sum("nw").over(whole)).where(F.col("total") >= min_words).withColumn("stop", F.sum("nw").over(ordered)).withColumn("begin", F.col("stop") - F.col("nw"))
    ahead = F.count("*").over(whole.orderBy("begin").rangeBetween(0, min_words - 1))
    behind = F.count("*").over(whole.orderBy("stop").rangeBetween(-(min_words - 1), 0))
    active = cut(
        active.withColumn("ahead", F.when(F.col("begin") + min_words <= F.col("total"), ahead)).withColumn("behind", F.when(F.col("stop") >= min_words, behind)).select("doc_id", "th", "seg", "pos", "h", "g", "ahead", "behind"),
        "active",
    )
    known = active.agg(F.max(F.greatest("ahead", "behind")).alias("w"), F.count("*").alias("n")).first()
    longest, n_active = known["w"] or 0, known["n"]
    ranked = active.join(_ranked(active), ["h", "g"]).select("doc_id", "th", "seg", "pos", "ahead", "behind", "rank")
    # One row for each stretch: places count from the stretch's first line.
    by = F.struct("pos", "rank", "ahead", "behind")
    rows = ranked.groupBy("doc_id", "th", "seg").agg(F.array_sort(F.collect_list(by)).alias("all"))
    forth = F.filter(F.transform("all", lambda x, i: F.struct(i.cast("long").alias("i"), x["ahead"].alias("w"))), lambda x: x["w"].isNotNull())
    back = F.filter(F.transform("all", lambda x, i: F.struct((i - x["behind"] + 1).cast("long").alias("i"), x["behind"].alias("w"))), lambda x: x["w"].isNotNull())
    rows = rows.select("doc_id", "th", "seg", F.col("all")[0]["pos"].alias("first"), F.transform("all", lambda x: x["rank"]).alias("ranks"), F.array_distinct(F.concat(forth, back)).alias("windows"))
    rows = cut(rows, "stretches")
    windows = rows.select("doc_id", "th", "seg", "first", "windows")
    found = None
    depth = 1
    while depth <= max(longest, 1):
        here = rows.select("doc_id", "th", "first", "ranks", F.explode(F.filter("windows", lambda x: (x["w"] >= depth) & (x["w"] < 2 * depth))).alias("x"))
        windows_at = here.select(
            "doc_id", "th", (F.col("first") + F.col("x.i")).alias("pos"), F.col("x.w").alias("w"), _at("ranks", F.col("x.i").cast("int")).alias("a"), _at("ranks", (F.col("x.i") + F.col("x.w") - depth).cast("int")).alias("b")
        )
        interval = windows_at.groupBy("w", "a", "b").agg(F.min(F.struct("doc_id", "th", "pos")).alias("one"), F.count("*").alias("n")).where("n > 1").select("w", "a", "b", "one")
        later = windows_at.join(interval, ["w", "a", "b"]).where(F.struct("doc_id", "th", "pos") > F.col("one"))
        same = (F.col("doc_id") == F.col("one.doc_id")) & (F.col("th") == F.col("one.th"))
        begin = F.when(same, F.greatest("pos", F.col("one.pos") + F.col("w"))).otherwise(F.col("pos"))
        later = later.select("doc_id", "th", begin.alias("begin"), (F.col("pos") + F.col("w")).alias("end"))
        found = later if found is None else found.unionByName(later)
        if 2 * depth > longest:
            break
        pairs = rows.select("doc_id", "th", "seg", F.posexplode("ranks").alias("i", "a"), "ranks").select("doc_id", "th", "seg", "i", "a", _at("ranks", F.col("i") + depth).alias("b"))
        # The order of b inside a: a common line has many lines after it, so b is numbered in slots that are added up.
        counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("slot", F.floor(F.col("b") * SLOTS / (n_active + 1)))
        inside = F.sum("n").over(Window.partitionBy("a", "slot").orderBy("b")) - F.col("n")
        slots = counted.groupBy("a", "slot").agg(F.sum("n").alias("m"))
        slots = slots.select("a", "slot", (F.sum("m").over(Window.partitionBy("a").orderBy("slot")) - F.col("m")).alias("before"))
        finer = counted.withColumn("inside", inside).join(slots, ["a", "slot"]).select("a", "b", (F.col("a") + F.col("before") + F.col("inside")).alias("rank"))
        doubled = pairs.join(finer, ["a", "b"]).groupBy("doc_id", "th", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ranks"))
        rows = cut(windows.join(doubled, ["doc_id", "th", "seg"]), f"ranks{2 * depth}")
        depth *= 2
    return found


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, gone: the places of the lines that go, in order."""
    spans = deleted_windows(docs, min_words).select("doc_id", "th", F.explode(F.sequence("begin", F.col("end") - 1)).alias("p"))
    return cut(spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.col("p").cast("int"))).alias("gone")), "gone")


def without(text: str, gone: str) -> Column:
    """The text without the lines at the places in ``gone``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_deleted, deleted_lines (places from 0, joined by commas), text (what stays) of each document that loses lines."""
    gone = repeated_lines(docs, min_words)
    texts = keyed(docs).select("doc_id", "text", F.xxhash64("text").alias("th"))
    # One strategy at every size: texts are shuffled once, by key, and meet the hashed places without a sort.
    return texts.join(gone.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", F.size("gone").cast("long").alias("n_deleted"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("deleted_lines"), without("text", "gone").alias("text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


SQL = f"""
with docs as (select doc_id, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from docs),
counted as (select doc_id, pos, length(line) - length(replace(line, ' ', '')) + 1 as nw from lines),
summed as (select doc_id, pos, nw, sum(nw) over (partition by doc_id order by pos)::bigint as stop, sum(nw) over (partition by doc_id)::bigint as total from counted),
spans as (select *, stop - nw as start,
    count(*) over (partition by doc_id order by stop - nw range between current row and {MIN_WORDS - 1} following) as ahead,
    count(*) over (partition by doc_id order by stop range between {MIN_WORDS - 1} preceding and current row) as behind from summed),
windows as (select doc_id, pos, ahead as w from spans where start + {MIN_WORDS} <= total
    union select doc_id, pos - behind + 1, behind from spans where stop >= {MIN_WORDS}),
named as (select v.doc_id, v.pos, v.w, array_to_string(d.ls[v.pos : v.pos + v.w - 1], chr(10)) as content from windows v join docs d using (doc_id)),
later as (select doc_id, pos, w, row_number() over same as k, first_value(doc_id) over same as first_doc, first_value(pos) over same as first_pos from named window same as (partition by w, content order by doc_id, pos)),
gone as (select distinct doc_id, unnest(generate_series(case when doc_id = first_doc then greatest(pos, first_pos + w) else pos end, pos + w - 1)) as pos from later where k > 1),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null) as text from lines l left join gone g using (doc_id, pos) group by l.doc_id)
select doc_id, count(*) as n_deleted, string_agg((pos - 1)::varchar, ',' order by pos) as deleted_lines, any_value(coalesce(k.text, '')) as text
from gone join kept k using (doc_id) group by doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that go; a document of which nothing stays is a copy and goes. Other rows stay as they are.

    Defined results: rows without an id or a text stay as they are, as do documents that were empty before. Rows that
    repeat id and text fare alike. n_chars, where there is one, follows the text.
    """
    rows, key, th = named(docs)
    (places,) = fresh(rows, "gone")
    gone = repeated_lines(docs).select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("gone").alias(places))
    # One strategy at every size: texts are shuffled once, by key, and meet the hashed places without a sort.
    joined = rows.join(gone.hint("shuffle_hash"), [key, th], "left")
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(without("text", places))
    edited = joined.withColumn("text", text).where(F.col(places).isNull() | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return edited.select(*docs.columns)
