"""Latent retrieval against brute force over every stretch of every document."""

import random
from collections import Counter

import numpy as np

from meterbook.llm import latent_decontamination as op

COMMON = ["the", "of", "and", "to", "in"]


def text(rng, n, vocab):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n))


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(1500)]
    items = [(i, ". ".join([text(rng, rng.randint(8, 40), vocab).capitalize(), text(rng, 6, vocab).capitalize() + "."])) for i in range(25)]
    docs, planted = [], set()
    for i in range(400):
        body = text(rng, rng.randint(1, 300), vocab).split()
        kind = i % 4
        if kind < 2:
            item, own = rng.choice(items)
            words = own.split()
            if kind == 1:  # drop, change and insert words, but leave the answer
                for _ in range(len(words) // 8):
                    at = rng.randrange(len(words) - 6)
                    if rng.random() < 0.5:
                        words[at] = rng.choice(vocab)
                    else:
                        words.insert(at, rng.choice(vocab))
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "!" for w in words] if kind == 0 and i % 3 == 0 else words
            planted.add((i, item))
        docs.append((i, " ".join(body)))
    return items, docs, planted


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain(text):
    found = ["".join(c for c in w if c.isalnum()) for w in (text or "").lower().split()]
    return [w for w in found if w]


def brute(items, docs):
    """The rule of the docstring at every word of every document, with code of its own."""
    out = set()
    for item, text in items:
        own, answer = plain(text), plain(text.rsplit(". ", 1)[-1])
        length, counts = -(-3 * len(own) // 2), Counter(own)
        for i, t in docs:
            words = plain(t)
            if (Counter(words) & counts).total() < 0.6 * len(own):
                continue
            for at in range(len(words)):
                part = words[at : at + length]
                if (Counter(part) & counts).total() >= 0.6 * len(own):
                    share = longest_common(own, part) / len(own)
                    if share >= 0.8 or share >= 0.6 and longest_common(answer, part) / len(answer) >= 0.8:
                        out.add((i, item))
                        break
    return out


def test_hits_match_brute_force(spark):
    items, docs, planted = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, start_word string")
    got = op.contaminated(table, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = brute(items, docs)
    assert len(found) == len(got) and found == want
    assert len(found & planted) >= 0.97 * len(planted)
    assert {d for d, _ in found} <= {d for d, _ in planted}
    blocks = {(r.doc_id, r.item_id) for r in op.contaminated(table, bench, item_block=10).collect()}
    assert blocks == found


def test_odd_rows(spark):
    items, docs, _ = corpus()
    rows = [(1, None), (2, ""), (3, "!!! ..."), (None, items[0][1]), (4, "w1 " * 50_000 + items[1][1] + " w2" * 50_000), (5, items[2][1]), (5, items[2][1])]
    table = spark.createDataFrame(rows + [(100 + i, t) for i, t in docs if i % 4 > 1], "doc_id bigint, text string")
    bench = spark.createDataFrame(items + [(99, None), (98, ""), (97, "a b"), (96, items[3][1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in op.contaminated(table, bench).collect()}
    assert {k for k, r in got.items() if r.kind != "short"} == {(None, 0), (4, 1), (5, 2)}
    assert {item for (_, item), r in got.items() if r.kind == "short"} <= {97}
    assert got[4, 1].start_word > 49_000 and got[4, 1].kind == "copy" and got[4, 1].lcs_share == 1.0
    kept = op.clean(table, bench)
    assert kept.columns == ["doc_id", "text"] and kept.count() == table.count() - 4
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.contaminated(empty, bench).collect() == [] and op.clean(table, bench.limit(0)).count() == table.count()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(1, 5) for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert op.common(op.places_of(np.array(a, np.int32)), len(a), b) == longest_common(a, b)


def test_hits_near_the_limits():
    """Items with words dropped, replaced and inserted until little more or less than the limits is left: any first word may be the one."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.sample(vocab, rng.randint(9, 45))) + ". " + " ".join(rng.sample(vocab, 3)) + ".") for i in range(12)]
    docs = []
    for i in range(300):
        words, body = items[i % 12][1].split(), rng.choices(vocab, k=rng.randint(0, 80))
        for at in rng.sample(range(len(words) - 3), round(rng.choice([0.15, 0.2, 0.25, 0.35, 0.4]) * len(words))):
            words[at] = rng.choice(["", "new", "two new", "and now three"])
        at = rng.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + words + body[at:])))
    block = op.Items.of(items)
    codes = op.code_texts([t.encode() for _, t in docs], block.vocabulary)
    counts = np.bincount(np.concatenate(codes), minlength=len(block.vocabulary) + 1)
    nothing = op.Space(np.zeros((len(counts), 2), np.float32), np.zeros(len(counts), bool), counts)
    found = op.find(codes, nothing, np.zeros((12, 2), np.float32), op.Checker(block), op.Rare.of(block.codes, counts))
    want = brute(items, docs)
    assert 50 < len(want) < 290 and {(f[0], f[1]) for f in found} == want


def test_short_items(spark):
    """Items of one to four words are found word after word, in all documents, and taken out only on request."""
    rng = random.Random(5)
    vocab = ["a", "b", "c", "d"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 4)))) for i in range(20)] + [(50, "a long item of seven plain words")]
    docs = [(i, " ".join(rng.choices([*vocab, "x", "y", "B!"], k=rng.randint(0, 30)))) for i in range(120)] + [(200, items[-1][1])]
    docs += [(300, "x " * 40_000 + "c d a b"), (301, None), (None, "a")]
    want = {}
    for i, t in docs:
        words = plain(t)
        for item, own in items[:-1]:
            size = len(plain(own))
            at = next((k for k in range(len(words) - size + 1) if words[k : k + size] == plain(own)), None)
            if at is not None:
                want[i, item] = at
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = op.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id): r.start_word for r in got if r.kind == "short"} == want
    assert {(r.doc_id, r.item_id) for r in got if r.kind != "short"} == {(200, 50)}
    assert all(r.cosine is None and r.answer_share is None and r.lcs_share == 1.0 for r in got if r.kind == "short")
    assert op.clean(table, bench).count() == len(docs) - 1
    assert op.clean(table, bench, short=True).count() == len(docs) - len({i for i, _ in want} | {200})
    only = op.contaminated(table, bench.where("item_id < 50")).collect()
    assert {(r.doc_id, r.item_id): r.start_word for r in only} == want


def test_answers():
    assert op.answer_of("One thing. Two things? Three, four!") == [b"three", b"four"]
    assert op.answer_of("Q: what is it\nAnswer: Forty two.") == [b"forty", b"two"]
    assert op.answer_of("no end") == [b"no", b"end"] and op.answer_of("") == []


def test_words():
    for text in ("It's A_b-c, \u00c9t\u00e9! 12\u00bd \x85x\u00a0y \u2026 \u00ab a \u00bb\n\x0b9", "plain ASCII: don't (stop) __x__ --", ""):
        want = ["".join(c for c in w if c.isalnum()) for w in text.lower().encode().split() for w in [w.decode()]]
        assert op.words_of(text) == [w.encode() for w in want if w]


def test_hits_do_not_depend_on_the_latent_space(spark):
    """With the cosine of every pair below the bound the rare words alone find what brute force finds."""
    items, docs, _ = corpus()
    block = op.Items.of(items)
    codes = op.code_texts([t.encode() for _, t in docs], block.vocabulary)
    counts = np.bincount(np.concatenate(codes), minlength=len(block.vocabulary) + 1)
    nothing = op.Space(np.zeros((len(counts), 2), np.float32), np.zeros(len(counts), bool), counts)
    found = op.find(codes, nothing, np.zeros((len(block.ids), 2), np.float32), op.Checker(block), op.Rare.of(block.codes, counts))
    assert {(docs[f[0]][0], block.ids[f[1]]) for f in found} == brute(items, docs)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in op.contaminated(table, bench).collect()} == brute(items, docs)


def test_regions_with_too_few_words_are_passed_over(monkeypatch):
    monkeypatch.setattr(op, "_REGION_WORDS", 50)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = op.Items.of([(i, " ".join(rng.choices(vocab, k=rng.randint(5, 30)))) for i in range(21)])
    checker = op.Checker(items)
    codes = np.array([rng.randint(0, len(items.vocabulary)) for _ in range(500)], np.int32)
    regions = [(rng.randrange(21), at := rng.randrange(490), at + rng.randint(1, 80)) for _ in range(300)]
    item, start, stop = np.array(regions).T
    stop = np.minimum(stop, len(codes))
    want = [sum(c in set(items.codes[i].tolist()) for c in codes[a:b].tolist()) >= 0.6 * len(items.codes[i]) - 1e-9 for i, a, b in zip(item, start, stop)]
    assert checker.enough(codes, item, start, stop).tolist() == want and 0 < sum(want) < 300
    assert checker.enough(codes, item[:0], start[:0], stop[:0]).tolist() == []
