"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from meterbook.llm import common
from meterbook.llm import simhash_dedup as op

WORDS = [f"w{i}" for i in range(300)]


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= 3:
                parent[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least.setdefault(top(x), []).append(i)
    return sorted(
        ((i, f"{p:016x}", min((v for v in least[top(x)] if v is not None), default=None)) for x, (i, p) in enumerate(prints)), key=repr
    )


def corpus(n=160):
    rng = random.Random(5)
    texts = [None, "", "  \n ", "One", "one", "two words", "É É é", "a\x85b c d e f g", "A b C d", "a B c D"]
    base = [rng.choice(WORDS) for _ in range(400)]
    for _ in range(n):
        if rng.random() < 0.6:
            parts = list(base)
            for _ in range(rng.randint(0, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(WORDS)
        else:
            parts = [rng.choice(WORDS) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(parts))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + rows[:5] + [(None, texts[20])]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_groups_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fingerprint string, bits int")
    assert got(op.near_duplicates(docs)) == slow_groups(rows)


def test_full_cells_give_the_same_groups(spark):
    rows = corpus(80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(op.near_duplicates(docs, dense=1, cell_block=2)) == slow_groups(rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def broadcast_parts(plan):
    """What each broadcast of a plan holds: the lines below it that are indented more."""
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for at, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((i for i in range(at + 1, len(plan)) if depth[i] <= depth[at]), len(plan))
            yield "\n".join(plan[at:end])


def test_exploded_cells_are_not_broadcast(spark):
    """Cells and probes, up to 34 rows for a fingerprint, are sized as one row each: they are shuffled however small they seem."""
    nodes = op.written(spark.range(600).select(F.xxhash64("id").alias("bits")), "nodes")
    plan = plan_of(op.links(nodes))
    assert not list(broadcast_parts(plan)) and any("SortMergeJoin" in line for line in plan)
    twins = op.written(nodes.unionByName(nodes.select(F.col("bits").bitwiseXOR(F.lit(3)).alias("bits"))), "twins")
    held = list(broadcast_parts(plan_of(op.links(twins, dense=1, cell_block=2))))  # the table of full cells
    assert held and not any("Generate" in part for part in held)


def test_many_full_cells_are_shuffled(spark, monkeypatch):
    rows = corpus(60)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    plans, links = [], op.links

    def spy(*args, **named):
        found = links(*args, **named)
        plans.append(plan_of(found))
        return found

    monkeypatch.setattr(op, "links", spy)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(op.near_duplicates(docs, dense=1, cell_block=2)) == slow_groups(rows)
    assert len(plans) == 1 and not list(broadcast_parts(plans[0]))


def test_empty_table(spark):
    assert got(op.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"))) == []


def test_a_long_text_crosses_chunks():
    text = " ".join(random.Random(1).choices(WORDS, k=70_000))
    old, op._CHUNK = op._CHUNK, 1000
    try:
        parts = op.fingerprint(text.encode())
    finally:
        op._CHUNK = old
    assert parts == op.fingerprint(text.encode())


def test_one_of_each_group_stays(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, bits string")
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(i for i in g if i is not None) for g in near_slow(rows))
    assert op.keep_one(docs.limit(0)).collect() == []


def test_near_copies_are_caught(spark):
    """One word in fifty changed: five-word shingles still have a similarity of about 0.8."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        base = [rng.choice(WORDS) for _ in range(300)]
        rows.append((2 * k, " ".join(base)))
        for at in rng.sample(range(300), 5):
            base[at] = rng.choice(WORDS)
        rows.append((2 * k + 1, " ".join(base)))
    kept = {r.doc_id for r in op.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(2 * k in kept for k in range(60)) and len(kept) <= 60 + 12


def near_slow(rows):
    """Groups of rows (by place) whose five-word shingles have a Jaccard similarity of 0.8 or more, linked pair by pair."""
    sets = []
    for _, t in rows:
        parts = (t or "").lower().split()
        sets.append({" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))})
    top = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if top[x] != top[y] and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]):
                top = [top[y] if t == top[x] else t for t in top]
    return [[rows[x][0] for x in range(len(rows)) if top[x] == name] for name in set(top)]


def edited(rng, base, words):
    """A text with so many words in a row cut out or replaced one by one."""
    if rng.random() < 0.5:
        at = rng.randrange(len(base) - words)
        return base[:at] + base[at + words :]
    out = list(base)
    for at in rng.sample(range(len(base)), words):
        out[at] = rng.choice(WORDS)
    return out


def test_groups_have_a_similarity_of_at_least_four_fifths(spark):
    """Pairs below 0.8 stay, pairs from 0.8 up are linked, in small cells and in full ones compared in blocks."""
    rng = random.Random(21)
    rows, hot = [], [rng.choice(WORDS) for _ in range(120)]
    for _ in range(50):
        base = [rng.choice(WORDS) for _ in range(rng.randint(40, 300))]
        rows.append(" ".join(base))
        rows += [" ".join(edited(rng, base, rng.randint(1, max(2, len(base) // 12)))) for _ in range(3)]
    rows += [" ".join(edited(rng, hot, rng.randint(1, 12))) for _ in range(80)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(min, near_slow(rows)))
    assert 0 < len(want) < len(rows) - 50
    assert sorted(r.doc_id for r in op.keep_one(docs).collect()) == want
    assert sorted(r.doc_id for r in op.keep_one(docs, dense=2, block=500).collect()) == want


def test_simhash_links_come_first(spark, monkeypatch):
    """Pairs of fingerprints within three bits are compared first; prefixes look for links between what is still apart only."""
    rng, rows = random.Random(8), []
    for _ in range(20):
        base = [rng.choice(WORDS) for _ in range(900)]
        rows += [" ".join(base), " ".join([*base[:300], "x", *base[301:]]), " ".join([*base[:300], "y", *base[301:]])]
        rows.append(" ".join(edited(rng, base, 9)))
    rows = list(enumerate(rows))
    linked, verified = [], {}
    links, check = op.links, op._verified

    def spy_links(nodes, *more, **named):
        linked.append({r.bits for r in nodes.collect()})
        return links(nodes, *more, **named)

    def spy_check(pairs, sets, name):
        asked, done = {(r.a, r.b) for r in pairs.select("a", "b").collect()}, check(pairs, sets, name)
        verified[name] = asked, {(r.a, r.b) for r in done.collect()}
        return done

    monkeypatch.setattr(op, "links", spy_links)
    monkeypatch.setattr(op, "_verified", spy_check)
    kept = sorted(r.doc_id for r in op.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == sorted(map(min, near_slow(rows)))
    prints = np.array([slow_print(t) for _, t in rows], np.uint64)
    assert linked == [set(prints.view(np.int64).tolist())]
    assert next(iter(verified)) == "fingerprint-links"
    asked, first = verified["fingerprint-links"]
    near = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (int(prints[a]) ^ int(prints[b])).bit_count() <= 3}
    assert 0 < len(asked) <= len(near) and first
    assert not verified["near"][0] & first


def test_passes_over_shingles_join_nothing(spark, monkeypatch):
    """The prefixes of the first rows are written before they are counted, so that no pass shuffles them for a join again."""
    plans, shared = [], op._shared

    def spy(tokens, *more):
        plans.append(tokens._jdf.queryExecution().optimizedPlan().toString())
        return shared(tokens, *more)

    monkeypatch.setattr(op, "_shared", spy)
    rows = [(i, " ".join(WORDS[i % 9 : i % 9 + 80])) for i in range(20)]
    kept = sorted(r.doc_id for r in op.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert kept == sorted(map(min, near_slow(rows)))
    assert "Join" not in plans[0]


def test_tables_of_shingles_are_not_broadcast(spark, monkeypatch):
    """Rows of shingles and, beyond a number of rows, of texts are shuffled, however small their files; the groups are the same."""
    rng, rows = random.Random(31), []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 200))]
        rows += [" ".join(base), " ".join(base), *(" ".join(edited(rng, base, 4)) for _ in range(3))]
    rows = list(enumerate(rows))
    plans, write = {}, op.written

    def spy(df, name):
        plans.setdefault(name, plan_of(df))
        return write(df, name)

    monkeypatch.setattr(op, "written", spy)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    kept = op.keep_one(docs)
    plans["kept"] = plan_of(kept)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, near_slow(rows)))
    joins = {name: next(line for line in plans[name] if "Join" in line) for name in ("shared", "listed", "near-asked", "first-prefixes", "fingerprint-pairs", "kept")}
    assert {name for name, line in joins.items() if "SortMergeJoin" not in line} == set()


def test_blocks_connect_what_is_near():
    rng = random.Random(4)
    base = rng.sample(range(10_000), 60)
    sets = [np.array(sorted(set(rng.sample(base, rng.randint(45, 60)) + rng.sample(range(10_000), 3)))) for _ in range(60)]
    links = op.near_links(sets[:30], sets[30:], np.arange(30), np.arange(30, 60))
    near = [(i, j) for i in range(30) for j in range(30) if 5 * len(np.intersect1d(sets[i], sets[30 + j])) >= 4 * len(np.union1d(sets[i], sets[30 + j]))]

    def tops(pairs):
        top = list(range(60))
        for i, j in pairs:
            top = [top[i] if t == top[30 + j] else t for t in top]
        return {frozenset(x for x in range(60) if top[x] == t) for t in top}

    assert near and set(links) <= set(near) and tops(links) == tops(near) and len(links) == 60 - len(tops(near))
