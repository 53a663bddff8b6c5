"""Properties on random input; Spark sees each example set as one batch."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import analytics, chunking, noise, sampling
from ragloom.plans import providers

ONE = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
MANY = settings(max_examples=150, deadline=None)


@MANY
@given(st.lists(st.integers(1, 30), max_size=20), st.integers(1, 40), st.integers(0, 20))
def test_packing_loses_nothing(sizes, size, overlap):
    units = [f"u{i}" for i in range(len(sizes))]
    out = [w.split(" ") for w in chunking.pack(units, sizes, size, overlap, " ")]
    assert [u for u in dict.fromkeys(x for w in out for x in w)] == units
    assert all(w == units[units.index(w[0]) : units.index(w[0]) + len(w)] for w in out)


@MANY
@given(st.text(max_size=300), st.integers(0, 5), st.integers())
def test_typos_keep_the_words_apart(text, n, seed):
    out = noise.with_typos(text, n, seed)
    assert len(out.split(" ")) == len(text.split(" "))


@MANY
@given(st.text(max_size=200))
def test_json_never_fails_otherwise(text):
    try:
        providers.extract_json(text)
    except ValueError:
        pass


@ONE
@given(st.lists(st.text(alphabet="aB .!?\n\té1", max_size=60), min_size=1, max_size=30))
def test_sentences_keep_all_signs(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.sentences("t").alias("s"), T.normal("t").alias("n")).collect()
    for r in rows:
        assert "".join("".join(r.s).split()) == "".join(texts[r.i].split())
        assert r.n == " ".join(texts[r.i].lower().split())


@ONE
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from("ABC"), st.booleans()), min_size=1, max_size=60))
def test_phi_is_a_correlation(spark, rows):
    v = spark.createDataFrame([(f"r{a}", q, "d", b) for a, q, b in rows], "record_id string, question_id string, dimension string, verdict boolean")
    got = {(r.question_a, r.question_b): r.phi for r in analytics.phi_matrix(v).collect()}
    assert all(-1 - 1e-9 <= p <= 1 + 1e-9 and abs(p - got[(b, a)]) < 1e-9 for (a, b), p in got.items())


@ONE
@given(st.integers(0, 500), st.lists(st.integers(1, 100), min_size=1, max_size=8))
def test_apportionment(spark, size, shares):
    mix = spark.createDataFrame([(i, str(i), s / sum(shares)) for i, s in enumerate(shares)], "ord int, name string, share double")
    assert sampling.apportioned(mix, size).agg(F.sum("n")).first()[0] == size
