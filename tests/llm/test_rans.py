import numpy as np
import pytest

from ragloom.llm import rans as R


def direct(text, encoding=R.Tokenizer(R.TOKENIZER).encoding):
    return encoding.encode_ordinary(text)


def test_tokens_of_words_are_tokens_of_texts():
    t = R.Tokenizer(R.TOKENIZER, remembered=3)
    texts = ["", " ", "  a b", " a", "a ", "a  b\n c \n", "x\n y z", "tab\t b c", "it's 's we've  don't", "é è  b", "plain words, and numbers 123 4", " x y　 z", "a\nb c\n\nd e"]
    for text in texts:
        assert t([text])[0].tolist() == direct(text)
    tokens, counts = t(texts)
    assert np.split(tokens, np.cumsum(counts)[:-1])[2].tolist() == direct(texts[2])


def test_codec_round_trip():
    rng = np.random.default_rng(4)
    for n, kinds, lanes in ((0, 1, 4), (1, 1, 4), (5, 2, 4), (1000, 3, 8), (4097, 900, 64), (5000, 50_000, 512)):
        tokens = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
        t, c = np.unique(tokens, return_counts=True)
        shared = R.Table.from_bytes(R.Table(t, c).to_bytes())
        assert not n or int(shared.freqs.sum()) == 1 << R.BITS and shared.freqs.min() >= 1
        payload, marks = R.encode(tokens, shared, lanes, 256)
        ends = [m[0] for m in marks[1:]] + [n]
        for k, (mark, end) in enumerate(zip(marks, ends, strict=False)):  # every checkpoint by itself
            assert R.decode(payload, mark, end, shared).tolist() == tokens[mark[0] : end].tolist(), k
        if n > 1000:
            entropy = -(c / n * np.log2(c / n)).sum() * n / 8
            assert len(payload) < 1.05 * entropy + 8 * lanes


def scalar_encode(tokens, freqs, starts, lanes):
    """One state after another, on Python's own integers."""
    states, words = [R._LOW.item()] * lanes, []
    for i in range(len(tokens) - 1, -1, -1):
        row, lane = divmod(i, lanes)
        # Words of a row lie in the order of lanes, as its decoder takes them.
        f, c, x = freqs[tokens[i]], starts[tokens[i]], states[lane]
        if x >= f << (63 - R.BITS):
            words.append((row, lane, x & 0xFFFFFFFF))
            x >>= 32
        states[lane] = (x // f << R.BITS) + x % f + c
    return states, [w for _, _, w in sorted(words)]


def scalar_decode(states, words, n, freqs, starts):
    states, words, out = list(states), iter(words), []
    for i in range(n):
        x = states[i % len(states)]
        slot = x & ((1 << R.BITS) - 1)
        token = next(t for t in freqs if starts[t] <= slot < starts[t] + freqs[t])
        x = freqs[token] * (x >> R.BITS) + slot - starts[token]
        states[i % len(states)] = x << 32 | next(words) if x < 1 << 31 else x
        out.append(token)
    return out


def test_codec_against_a_scalar_one():
    rng = np.random.default_rng(8)
    for n, kinds, lanes in ((1, 1, 3), (50, 4, 8), (333, 60, 16)):
        tokens = (rng.zipf(1.4, n) % kinds).astype(np.uint32)
        shared = R.Table(*np.unique(tokens, return_counts=True))
        freqs, starts = (dict(zip(shared.tokens.tolist(), v.tolist(), strict=True)) for v in (shared.freqs, shared.starts))
        states, words = scalar_encode(tokens.tolist(), freqs, starts, lanes)
        payload, marks = R.encode(tokens, shared, lanes, 10**6)
        assert np.frombuffer(payload, "<u4").tolist() == words and np.frombuffer(marks[0][2], "<u8").tolist() == states
        assert scalar_decode(states, words, n, freqs, starts) == tokens.tolist()


def test_blocks_round_trip(spark, odd, docs_of):
    blocks = R.encoded(odd, block=1000, lanes=32, checkpoint=128)
    got = sorted((r.doc_id, r.tokens) for r in R.decoded(blocks).collect())
    assert got == sorted((r.doc_id, direct(r.text)) for r in odd.where("doc_id is not null and text is not null").collect())
    rows = blocks.collect()
    assert R.decoded_parts(blocks).groupBy("block").count().agg({"count": "max"}).first()[0] > 1
    part = next(r for r in rows if len(r.checkpoints) > 1)
    torn = bytearray(part.payload)
    torn[2] ^= 255
    with pytest.raises(Exception, match=r"part \d+ of block"):
        R.decoded(spark.createDataFrame([r if r is not part else type(r)(**(r.asDict() | {"payload": torn})) for r in rows], blocks.schema)).collect()
    broken = spark.createDataFrame([r if r.block < 0 else type(r)(**(r.asDict() | {"crc": 1})) for r in rows], blocks.schema)
    with pytest.raises(Exception, match="damaged"):
        R.decoded(broken).collect()


def test_empty_table(empty):
    blocks = R.encoded(empty)
    assert [r.block for r in blocks.collect()] == [-1] and R.decoded(blocks).count() == 0
