"""Groups by Jaccard similarity against all pairs."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from meterbook.llm import fragment_join as op
from meterbook.llm.common import table

VOCABULARY = [f"w{i}" for i in range(400)]
FOLDER = "/root/testdata/sf0.001"


def gram_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        low = low.replace(gap, " ")
    parts = [w for w in low.split(" ") if w]
    return {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def slow(rows):
    sets = [gram_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                top[find(x)] = find(y)
    members = {}
    for x, (i, _) in enumerate(rows):
        members.setdefault(find(x), []).append(i)
    return sorted(((i, len(sets[x]), min((v for v in members[find(x)] if v is not None), default=None)) for x, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edited(rng, base, words):
    out = list(base)
    for _ in range(words):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice(VOCABULARY)
        elif kind < 0.7 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.choice(VOCABULARY))
    return out


def corpus(seed, n=70):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "One", "one", "two words", "É É é", "a\x85b c d e f g", "A b C d", "a B c D", "a a a a a a a a a"]
    hot, passage = [rng.choice(VOCABULARY) for _ in range(120)], [rng.choice(VOCABULARY) for _ in range(60)]
    for _ in range(n):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 5, 6, 8, 12, 20, 40, 90, 200]))]
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25)))) for _ in range(rng.randint(0, 3))]
        texts.append(" ".join(passage + [rng.choice(VOCABULARY) for _ in range(rng.randint(1, 30))]))
    texts += [" ".join(edited(rng, hot, rng.randint(0, 4))) for _ in range(60)]
    rows = [(i * 7 % 9973, t) for i, t in enumerate(texts)]
    return rows + rows[:14] + [(None, texts[20]), (None, None)]


@pytest.mark.parametrize("sizes", [{}, {"listed": 2, "block": 300, "bits": 1 << 15}])
def test_groups_match_brute_force(spark, sizes):
    rows = corpus(8)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, class string, n int")
    want = slow(rows)
    assert len({w[2] for w in want}) < len(want) - 100
    assert got(op.jaccard_groups(docs, **sizes)) == want


def test_linked_sets_share_enough_digests():
    """Random sets at the limit of the similarity, of all sizes."""
    rng = np.random.default_rng(6)
    tried = 0
    for _ in range(6000):
        a, b = int(rng.integers(1, 90)), 0
        b = int(rng.integers(max(1, -(-4 * a // 5)), 5 * a // 4 + 1))
        shared = -(-4 * (a + b) // 9)
        if shared > min(a, b):
            continue
        tried += 1
        pool = rng.integers(0, 1 << 63, a + b - shared, np.uint64) * np.uint64(2)
        left, right = np.unique(pool[:a]), np.unique(np.concatenate((pool[:shared], pool[a:])))
        assert op.linked(shared, a, b)
        assert len(np.intersect1d(op.segment_digests(left), op.segment_digests(right))) >= min(a, b) // op.LEAST_PART + 1
    assert tried > 4000


def test_hashes_in_one_place_still_share_a_digest():
    """Sets that fall into one fragment of the usual cut are cut finer."""
    base = np.arange(1, 41, dtype=np.uint64)
    other = np.concatenate((base[:36], np.arange(100, 104, dtype=np.uint64)))
    assert len(np.intersect1d(op.segment_digests(base), op.segment_digests(other))) >= 3


def test_spanning_links_connect_groups():
    rng = random.Random(4)
    base = rng.sample(range(10_000), 60)
    sets = [np.array(sorted(set(rng.sample(base, rng.randint(45, 60)) + rng.sample(range(10_000), 3))), np.uint64) for _ in range(60)]
    cut = [[s[s < 3000], s[(s >= 3000) & (s < 7000)], s[s >= 7000]] for s in sets]
    found = op.spanning_links(cut[:30], cut[30:], np.arange(30), np.arange(30, 60))
    near = [(i, j) for i in range(30) for j in range(30) if 5 * len(np.intersect1d(sets[i], sets[30 + j])) >= 4 * len(np.union1d(sets[i], sets[30 + j]))]

    def tops(pairs):
        top = list(range(60))
        for i, j in pairs:
            top = [top[i] if t == top[30 + j] else t for t in top]
        return {frozenset(x for x in range(60) if top[x] == t) for t in top}

    assert near and set(found) <= set(near) and tops(found) == tops(near) and len(found) == 60 - len(tops(near))


def test_empty_tables(spark):
    assert got(op.jaccard_groups(spark.createDataFrame([], "doc_id bigint, text string"))) == []
    assert got(op.jaccard_groups(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables are not there")
def test_whole_table(spark):
    docs = table(spark, FOLDER, "documents")
    assert got(op.jaccard_groups(docs)) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_only_sets_of_pairs_travel(spark, monkeypatch):
    """Segments are filtered by the classes of a round's pairs before they are joined; none that is wanted is lost."""
    rng = random.Random(31)
    names = [f"v{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        base = [rng.choice(names) for _ in range(120)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join([*base, "a"])), (3 * i + 2, " ".join([*base[:60], "b", *base[61:]]))]
    seen, filtered = [], op.having

    def spy(df, key, wanted, *more):
        out = filtered(df, key, wanted, *more)
        want = {r[0] for r in wanted.collect()}
        before, after = ([r[0] for r in d.select(key).collect()] for d in (df, out))
        assert sorted(k for k in before if k in want) == sorted(k for k in after if k in want)
        seen.append((len(want), len(set(before)), len(set(after))))
        return out

    monkeypatch.setattr(op, "having", spy)
    groups = {r.doc_id: r.component_id for r in op.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert groups == {i: i - i % 3 for i in range(180)}
    assert len(seen) == 3 and all(after <= want + 2 for want, _, after in seen) and seen[-1][2] < seen[-1][1]


def test_sketches_part_what_is_not_linked():
    rng = np.random.default_rng(5)
    left, right, linked = [], [], []
    for n in [1, 2, 9, 63, 64, 65, 127, 200, 129, 700, 3000] * 12:
        base = rng.integers(0, 2**64, n, np.uint64)
        gone = int(rng.integers(0, max(2, n // 4)))
        other = np.concatenate([base[gone:], rng.integers(0, 2**64, int(rng.integers(0, max(2, n // 8))), np.uint64)])
        left.append(np.unique(base))
        right.append(np.unique(other) if len(other) else np.unique(base))
        linked.append(op.linked(len(np.intersect1d(left[-1], right[-1])), len(left[-1]), len(right[-1])))
    sizes = [np.array(list(map(len, side))) for side in (left, right)]
    drawn = [list(map(op.sketch, side)) for side in (left, right)]
    kept = op.may_link(*drawn, *sizes)
    linked = np.array(linked, bool)
    assert linked.sum() > 30 and kept[linked].all()
    far = op.may_link(drawn[0], drawn[0][11:] + drawn[0][:11], sizes[0], sizes[0])
    assert not far[sizes[0] > 9].any()


def test_sets_of_a_batch_are_those_of_its_texts():
    rng = random.Random(8)
    texts = ["", None, " \n", "A b c D", "a b c d e", "x " * 9, " É é  q\x1cz\x85 Z ", *(" ".join(rng.choices("abCé", k=rng.randint(0, 40))) for _ in range(50))]
    for size in (1, 3, 5):
        got = op.sets_of(pa.array(texts), size)
        assert [g.tolist() for g in got] == [op.shingles((t or "").encode(), op._WordHashes(), size).tolist() for t in texts]
    assert op.sets_of(pa.array([], pa.string()), 5) == []


def test_digests_travel_in_rounds(spark, monkeypatch):
    written, shared, held = op.written, [], []

    def spy(df, name):
        out = written(df, name)
        if name == "shared":
            shared.append({r.digest >> (64 - op.ROUNDS.bit_length() + 1) & (op.ROUNDS - 1) for r in out.select("digest").collect()})
        elif name == "segments":
            held.append(out.inputFiles())
        elif name == "fragments":  # the digests of all sets are gone before the sets are written
            assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in held[0])
        return out

    monkeypatch.setattr(op, "written", spy)
    rng = random.Random(6)
    words = [[str(rng.random()) for _ in range(200)] for _ in range(12)]
    docs = spark.createDataFrame([(2 * i + k, " ".join(w[k:])) for i, w in enumerate(words) for k in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op.jaccard_groups(docs).collect()}
    assert got == {i: i - i % 2 for i in range(24)}
    assert len(held[0]) > 0 and op.ROUNDS > 1
    assert shared == [{i} for i in range(op.ROUNDS)]
