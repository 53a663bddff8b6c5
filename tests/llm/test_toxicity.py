import random
import time

from pyspark.sql import functions as F

from ragloom.llm import toxicity as X

FILL = "plain words that carry on for a while and say nothing at all to anybody here "


def test_folding_and_exceptions():
    m = X.Matcher(X.LEXICON | {"grub*": 1.0})
    hits = lambda t: [h[2] for h in m.matches(X.fold(t))]
    assert hits("You IDIOT, you 1d10t, you іdіоt, you ídiöt, id​iot!") == ["idiot"] * 5
    assert hits("clown! cl0wn5 $cum") == ["clown", "clowns", "scum"]
    assert hits("a clown fish by the trash can") == []
    assert hits("idiotic scumble 2024 h3x") == []
    assert hits("grubling grub xgrub") == ["grub*", "grub*"]
    assert hits("") == []


def test_length_normalises(docs_of):
    rows = [(1, "idiot " + FILL), (2, "idiot " + FILL * 60), (3, FILL), (4, "an idiot and a moron")]
    assert {r.doc_id for r in X.toxic_documents(docs_of(rows), X.LEXICON).collect()} == {1, 4}


def test_fitting_finds_words_and_beginnings(spark, docs_of):
    suffix = ["ar", "el", "is", "on", "ut", "ex"]
    rows = [(i, FILL + (f"zorg{suffix[i % 6]} vlim u{i} " if i % 4 == 0 else "") + f"n{i}x" + "abcdefghij"[i % 10] * (10 + i % 13)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(1, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    lexicon = X.fitted(spark, docs_of(rows), labels)
    assert "vlim" in lexicon and "zorg*" in lexicon and "plain" not in lexicon
    found = {r.doc_id for r in X.toxic_documents(docs_of(rows), lexicon).collect()}
    assert found == {i for i in range(400) if i % 4 == 0}


def test_words_that_differ_by_an_accent_are_told_apart(spark, docs_of):
    rows = [(i, FILL + ("gâvlor " if i % 4 == 0 else "gavlor ") + f"n{i}x" + "abcdefghij"[i % 10] * (10 + i % 13)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    lexicon = X.fitted(spark, docs_of(rows), labels)
    assert "=gâvlor" in lexicon and "gavlor" not in lexicon
    found = {r.doc_id for r in X.toxic_documents(docs_of(rows), lexicon).collect()}
    assert found == {i for i in range(400) if i % 4 == 0}


def test_the_text_as_written_keeps_its_places():
    m = X.Matcher({"=réva": 1.0, "=mot*": 1.0, "plat": 0.5, "=plat": 0.5})
    hits = lambda t: [(h[0], h[2]) for h in m.matches(*X.forms(t))]
    assert hits("RÉVA reva re\u0301va rév4 môt motif plât") == [(0, "=réva"), (10, "=réva"), (15, "=réva"), (24, "=mot*"), (30, "plat")]
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000)]))
    for text in (every, every[::-1], "é".join(every[::7])):
        folded, written = X.forms(text)
        assert len(folded) == len(written) and folded == X.fold(text)


def naive(lexicon, exceptions, text):
    """Places and terms by looking at every place of both forms."""
    folded, written = X.forms(text)
    found, spared = {}, set()
    for at in range(len(folded)):
        if at and folded[at - 1].isalnum():
            continue
        for phrase in exceptions:
            p = X.fold(phrase)
            if folded.startswith(p, at) and not folded[at + len(p) : at + len(p) + 1].isalnum():
                spared.update(range(at, at + len(p)))
        for form, mark in ((folded, False), (written, True)):
            for term, weight in lexicon.items():
                stem = term.rstrip("*")
                if stem.startswith("=") != mark:
                    continue
                stem = X.forms(stem[1:])[1] if mark else X.fold(stem)
                whole = not form[at + len(stem) : at + len(stem) + 1].isalnum()
                if form.startswith(stem, at) and (whole or term.endswith("*")) and weight > found.get(at, (0, ""))[0]:
                    found[at] = (weight, term)
    return [(at, *hit) for at, hit in sorted(found.items()) if at not in spared]


def test_matches_against_a_naive_matcher():
    rng = random.Random(5)
    lexicon = {"ab": 1.0, "abc*": 0.7, "=bé": 0.9, "=ca*": 0.8, "cab": 1.2, "b": 0.4}
    exceptions = ("ab c", "b a", "cab b")
    matcher = X.Matcher(lexicon, exceptions)
    for _ in range(3000):
        text = "".join(rng.choice("aabbcé  A8@!") for _ in range(rng.randint(0, 40)))
        assert matcher.matches(*X.forms(text)) == naive(lexicon, exceptions, text), text


def test_many_matches_and_exceptions_are_linear():
    m = X.Matcher(X.LEXICON)
    began = time.time()
    assert len(m.matches(X.fold("trash can idiot " * 60_000))) == 60_000
    assert time.time() - began < 10


def test_weights_follow_the_odds():
    got = X.lexicon_of({"": (1000, 10_000), "sure": (400, 0), "rare": (12, 0), "often": (60, 1), "both": (60, 30), "few": (7, 0)})
    assert set(got) == {"sure", "rare", "often"} and got["sure"] > got["often"] and got["sure"] > got["rare"] and all(0.5 <= w <= 1.5 for w in got.values())
    assert X.lexicon_of({}) == {}


def test_odd_rows(spark, odd, empty, tmp_path):
    assert X.toxic_documents(odd, X.LEXICON).count() == 0
    assert X.toxic_documents(empty, X.LEXICON).count() == 0
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = X.stage(spark, odd.unionByName(odd.limit(1).withColumn("text", F.lit("idiot moron"))), str(tmp_path))
    assert out.columns == odd.columns and out.count() == odd.count()
