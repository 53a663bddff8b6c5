"""Credentials in several parts: access identifiers, secrets and endpoints that occur together.

Parts are found by pattern. A strong part tells by its form that it is a credential (a prefix of a known issuer, a private key
block). A weak part is a plain identifier (mail address, user name), a plain secret (value of a password, token or
key setting) or a plain endpoint (URL, host and port, IP address), and is reported only if a complementary part is within its scope:

* an identifier and a secret within ``SCOPE`` characters of each other in one document make a credential,
* an endpoint within the scope of both its parts is linked to it.

A URL with user information is all three: its user name is an identifier, its password a secret and the whole an endpoint.

Strong parts are reported with or without company. The interval join is an equality join on document and stripe: a
part is in all stripes that it touches and looks into those that its scope reaches, and a pair counts in the first stripe
that both have, so no document is compared with itself part by part.

Defined results: null texts and ids hold nothing; distances are from end to begin, overlapping parts are at
distance 0; of several endpoints in scope the nearest to the secret is linked, of equally near ones the first; rows
that repeat id and text are reported once, texts that share an id each; of a key block without an end the header line is
reported. Texts are scanned whole, and columns beside id and text don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.shared import cut, keyed, table

#: Characters between two parts that still belong together.
SCOPE = 200

#: What may stand before the key word of a setting (DB_PASSWORD), and what between it and the value.
_BEFORE = r"\b[0-9A-Za-z_\-]{0,40}?"
_SETS = r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: A value that is a strong part or an endpoint by its form is that part, not the secret of its setting.
_NOT_OTHER = r"(?!-----BEGIN |(?:AKIA|ASIA)[0-9A-Z]{16}\b|gh[pousr]_[0-9A-Za-z]{36}\b|xox[abprs]-[0-9A-Za-z-]{10}|sk_live_[0-9A-Za-z]{16}|(?:https?|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s?ftp)://)"
#: Signs but quotes, up to where the next setting begins; what closes a sentence or bracket is not the value's end.
_VALUE = r"(?:[^\s\"'`&;,]|[&;,](?![0-9A-Za-z_.\-]{1,40}[=:])){8,128}(?<![.,;:)\]}>])"
#: kind, strength, pattern; earlier ones win where two begin at one place.
PARTS = (
    ("secret", "strong", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[0-9A-Za-z+/=\s:,\-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    ("identifier", "strong", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", "strong", r"\b(?:gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,72}|sk_live_[0-9A-Za-z]{16,64})\b"),
    ("secret", "weak", rf"(?i:{_BEFORE}(?:password|passwd|pwd|token|secret|(?:secret|api|access)[_\-]?key)\b){_SETS}{_NOT_OTHER}{_VALUE}"),
    ("identifier", "weak", rf"(?i:{_BEFORE}(?:user|username|login|account)\b){_SETS}[0-9A-Za-z._\-]{{2,64}}"),
    ("endpoint", "weak", r"\b(?:https?|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s?ftp)://(?:[0-9A-Za-z._%\-]{1,64}:[^\s/@:\"'<>]{1,128}@)?[0-9A-Za-z._:/@?=&%\-]{3,200}"),
    ("identifier", "weak", r"\b[0-9A-Za-z._%+\-]{1,64}@[0-9A-Za-z.\-]{1,100}\.[A-Za-z]{2,10}\b"),
    ("endpoint", "weak", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b(?::[0-9]{1,5})?"),
)
#: One pass finds all parts.
PATTERN = "|".join(f"({p})" for _, _, p in PARTS)
#: User name and password in a URL.
_USER_INFO = re.compile(r"[0-9a-z]{2,10}://([0-9A-Za-z._%\-]{1,64}):([^\s/@:]{1,128})@", re.A)
#: Every part has one of these; texts without them aren't scanned.
_HINT = re.compile(r"[@=:]|[0-9]\.[0-9]|AKIA|ASIA|gh[pousr]_|xox|-----BEGIN|sk_live_", re.A)


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, th, kind, strong, begin, end, value of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(PATTERN, re.A)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                if _HINT.search(text):
                    for m in find.finditer(text):
                        kind, strength, _ = PARTS[(m.lastindex or 1) - 1]
                        out.append((doc_id, th, kind, strength == "strong", m.start(), m.end(), m[0]))
                        if kind == "endpoint" and (u := _USER_INFO.match(m[0])):
                            out += [(doc_id, th, k, False, m.start() + u.start(g), m.start() + u.end(g), u[g]) for g, k in ((1, "identifier"), (2, "secret"))]
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], ["doc_id", "th", "kind", "strong", "begin", "end", "value"])

    texts = keyed(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return texts.mapInArrow(run, "doc_id long, th long, kind string, strong boolean, begin long, end long, value string")


def _stripes(scope: int, around: int, begin: Column, end: Column) -> Column:
    size = scope + 256
    return F.sequence(F.floor((begin - around) / size), F.floor((end + around) / size))


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Pairs of a document's parts at most ``scope`` characters apart: columns x (left), y (right)."""
    part = F.struct(*(F.col(c) for c in ("begin", "end", "strong", "value")))
    a = left.select("doc_id", "th", part.alias("x"), _stripes(scope, scope, F.col("begin"), F.col("end")).alias("sx")).select("*", F.explode("sx").alias("s"))
    b = right.select("doc_id", "th", part.alias("y"), _stripes(scope, 0, F.col("begin"), F.col("end")).alias("sy")).select("*", F.explode("sy").alias("s"))
    gap = F.greatest(F.col("x.begin") - F.col("y.end"), F.col("y.begin") - F.col("x.end"), F.lit(0).cast("long"))
    met = a.join(b, ["doc_id", "th", "s"]).where(F.col("s") == F.greatest(F.col("sx")[0], F.col("sy")[0]))
    return met.where(gap <= scope).select("doc_id", "th", "x", "y")


def credentials(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, identifier, secret, endpoint (values; null where there is none), begin, end, strength.

    strength: "strong" for what has a strong part, "linked" for two weak ones.
    """
    found = cut(parts(docs).distinct(), "parts")
    ids, secrets, ends = (found.where(F.col("kind") == k) for k in ("identifier", "secret", "endpoint"))
    pairs = _near(ids, secrets, scope).select("doc_id", "th", F.col("x").alias("i"), F.col("y").alias("s"))
    alone = found.where("strong").select("doc_id", "th", "kind", F.struct("begin", "end", "strong", "value").alias("p"))
    paired = pairs.select("doc_id", "th", F.explode(F.array(F.struct(F.lit("identifier").alias("kind"), F.col("i").alias("p")), F.struct(F.lit("secret").alias("kind"), F.col("s").alias("p")))).alias("m"))
    alone = alone.join(paired.select("doc_id", "th", F.col("m.kind").alias("kind"), F.col("m.p").alias("p")).distinct(), ["doc_id", "th", "kind", "p"], "left_anti")
    nothing = F.lit(None).cast(pairs.schema["i"].dataType)
    single = alone.select("doc_id", "th", F.when(F.col("kind") == "identifier", F.col("p")).otherwise(nothing).alias("i"), F.when(F.col("kind") == "secret", F.col("p")).otherwise(nothing).alias("s"))
    whole = cut(pairs.unionByName(single), "pairs")
    # The endpoint must be in the scope of all parts that there are.
    anchor = F.coalesce("s", "i")
    anchors = whole.select("doc_id", "th", "i", "s", anchor["begin"].alias("begin"), anchor["end"].alias("end"))
    asked = anchors.withColumn("z", F.explode(_stripes(scope, scope, F.col("begin"), F.col("end"))))
    told = ends.select("doc_id", "th", F.explode(_stripes(scope, 0, F.col("begin"), F.col("end"))).alias("z"), F.struct("begin", "end", "value").alias("e"))
    away = lambda p: F.greatest(F.col(f"{p}.begin") - F.col("e.end"), F.col("e.begin") - F.col(f"{p}.end"), F.lit(0).cast("long"))
    near = asked.join(told, ["doc_id", "th", "z"]).where(F.coalesce(away("i"), F.lit(0)) <= scope).where(F.coalesce(away("s"), F.lit(0)) <= scope)
    near = near.groupBy("doc_id", "th", "i", "s").agg(F.min_by("e", F.struct(F.coalesce(away("s"), away("i")), F.col("e.begin"))).alias("e"))
    keyed_near = near.select("doc_id", "th", F.coalesce("i.begin", F.lit(-1)).alias("ib"), F.coalesce("s.begin", F.lit(-1)).alias("sb"), "e")
    whole = whole.withColumn("ib", F.coalesce("i.begin", F.lit(-1))).withColumn("sb", F.coalesce("s.begin", F.lit(-1)))
    joined = whole.join(keyed_near, ["doc_id", "th", "ib", "sb"], "left")
    return joined.select(
        "doc_id",
        F.col("i.value").alias("identifier"),
        F.col("s.value").alias("secret"),
        F.col("e.value").alias("endpoint"),
        F.least("i.begin", "s.begin", "e.begin").alias("begin"),
        F.greatest("i.end", "s.end", "e.end").alias("end"),
        F.when(F.coalesce("i.strong", F.lit(False)) | F.coalesce("s.strong", F.lit(False)), "strong").otherwise("linked").alias("strength"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(table(spark, sf_dir, "documents"))


#: The SQL keeps its narrower settings: lower-case keys without anything before them, values of letters, digits and +/_-.
_SQL_PARTS = (
    *PARTS[:3],
    ("secret", "weak", r"\b(?:password|passwd|pwd|token|secret|secret_key|api_key|apikey|access_key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z+/_\-]{8,128}"),
    ("identifier", "weak", r"\b(?:user|username|login|account)\b\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z._\-]{2,64}"),
    *PARTS[5:],
)
_SQL_PATTERN = "|".join(f"({p})" for _, _, p in _SQL_PARTS).replace("'", "''")
_CASES = " ".join(f"when regexp_full_match(value, '{p.replace(chr(39), chr(39) * 2)}') then {i}" for i, (_, _, p) in enumerate(_SQL_PARTS))
_INFO = "^" + _USER_INFO.pattern
_KINDS = ", ".join(f"({i}, '{k}', {str(s == 'strong').lower()})" for i, (k, s, _) in enumerate(_SQL_PARTS))
SQL = f"""
with pieces as (select doc_id, regexp_extract_all(text, '(?s).*?(?:{_SQL_PATTERN})') as ps from (select distinct doc_id, text from documents) where doc_id is not null and text is not null),
cut as (select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) as k from pieces),
ends as (select *, sum(length(piece)) over (partition by doc_id order by k)::bigint as stop, regexp_extract(piece, '(?s)^.*?((?:{_SQL_PATTERN}))$', 1) as value from cut),
kinds(which, kind, strong) as (values {_KINDS}),
plain as (select doc_id, kind, strong, stop - length(value) as start, stop, value from (select *, case {_CASES} end as which from ends) join kinds using (which)),
info as (select doc_id, start, regexp_extract(value, '^([0-9a-z]{{2,10}}://)', 1) as scheme, regexp_extract(value, '{_INFO}', 1) as name, regexp_extract(value, '{_INFO}', 2) as word from plain where kind = 'endpoint' and regexp_matches(value, '{_INFO}')),
parts as (select * from plain union all select doc_id, 'identifier', false, start + length(scheme), start + length(scheme) + length(name), name from info
    union all select doc_id, 'secret', false, start + length(scheme) + length(name) + 1, start + length(scheme) + length(name) + 1 + length(word), word from info),
i as (select * from parts where kind = 'identifier'), s as (select * from parts where kind = 'secret'), e as (select * from parts where kind = 'endpoint'),
pairs as (select i.doc_id, i.start as ib, i.stop as ie, i.value as identifier, i.strong as si, s.start as sb, s.stop as se, s.value as secret, s.strong as ss
    from i join s on i.doc_id = s.doc_id and greatest(i.start - s.stop, s.start - i.stop, 0) <= {SCOPE}),
alone as (select doc_id, start, stop, value, strong, null::bigint, null::bigint, null::varchar, null::boolean from i where strong and (doc_id, start) not in (select (doc_id, ib) from pairs)
    union all select doc_id, null, null, null, null, start, stop, value, strong from s where strong and (doc_id, start) not in (select (doc_id, sb) from pairs)),
whole as (select * from pairs union all select * from alone),
linked as (select w.*, e.start as eb, e.stop as ee, e.value as endpoint,
    row_number() over (partition by w.doc_id, w.ib, w.sb order by coalesce(greatest(sb - e.stop, e.start - se, 0), greatest(ib - e.stop, e.start - ie, 0)) nulls last, e.start) as k
    from whole w left join e on w.doc_id = e.doc_id and coalesce(greatest(ib - e.stop, e.start - ie, case when ib is not null then 0 end), 0) <= {SCOPE} and coalesce(greatest(sb - e.stop, e.start - se, case when sb is not null then 0 end), 0) <= {SCOPE})
select doc_id, identifier, secret, endpoint, least(ib, sb, eb) as "begin", greatest(ie, se, ee) as "end", case when coalesce(si, false) or coalesce(ss, false) then 'strong' else 'linked' end as strength
from linked where k = 1
"""
