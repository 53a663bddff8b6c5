import random
from collections import Counter, defaultdict

from ragloom.llm import packing as P


def brute(lengths, capacity):
    """Best fit, one piece after another; among equal rooms the bin that has had it longest."""
    bins, clock = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [(room, since, i) for i, (room, since, _) in enumerate(bins) if room >= n]
        if not fits:
            bins.append((capacity, clock, []))
            fits = [(capacity, clock, len(bins) - 1)]
        clock += 1
        i = min(fits)[2]
        bins[i] = (bins[i][0] - n, clock, [*bins[i][2], n])
    return sorted(sorted(b) for _, _, b in bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice([5, 16, 31, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        bins = defaultdict(list)
        for n, first, count, bin_, at, each in P.plan(dict(Counter(lengths)), capacity):
            for j in range(count):
                bins[bin_ + j // each].append((at + j % each * n, n))
        for b in bins.values():
            end = 0
            for at, n in sorted(b):
                assert at == end
                end += n
            assert end <= capacity
        assert sorted(sorted(n for _, n in b) for b in bins.values()) == brute(lengths, capacity)


def test_tree():
    rng = random.Random(9)
    tree, some = P.RoomTree(37), set()
    for _ in range(2000):
        room = rng.randint(0, 37)
        tree.set(room, room not in some)
        some ^= {room}
        least = rng.randint(0, 38)
        assert tree.tightest(least) == min((r for r in some if r >= least), default=None)


def test_documents(docs_of):
    rng = random.Random(10)
    rows = [(i, " ".join("w" * (1 + j % 3) for j in range(rng.randint(0, 90)))) for i in range(300)] + [(7, "again another"), (7, "again another")]
    out = P.packed(docs_of(rows), 32).collect()
    placed = defaultdict(list)
    for r in out:
        placed[r.bin].append((r.at, r.length))
    for b in placed.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 32
    want = [n for _, t in rows for n in [32] * (len(t.split()) // 32) + ([len(t.split()) % 32] if len(t.split()) % 32 else [])]
    assert sorted(sorted(n for _, n in b) for b in placed.values()) == brute(want, 32)
    by_doc = defaultdict(list)
    for r in out:
        if r.doc_id != 7:
            by_doc[r.doc_id].append((r.begin, r.length))
    for i, parts in by_doc.items():
        end = 0
        for begin, n in sorted(parts):
            assert begin == end
            end += n
        assert end == len(dict(rows[:300])[i].split())


def test_odd_rows(odd, empty):
    out = P.packed(odd).collect()
    assert len({r.text_hash for r in out if r.doc_id == 8}) == 2  # two texts of one id
    assert {r.doc_id for r in out} == {4, 5, 6, 7, 8, 9}
    assert P.packed(empty).count() == 0
