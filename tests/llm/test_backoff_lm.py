"""Stupid-backoff scores against a dictionary of counts."""

import math
import os
import random
from collections import Counter

import numpy as np
import oracle
import pytest

from meterbook.llm import backoff_lm as op
from meterbook.llm import queries


def corpus(n=120):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["É", "The", "the", "\x85"]
    texts = [None, "", " \n ", "one", "a b", "the the the the", "THE the"]
    texts += ["".join(rng.choice(vocab) + rng.choice(" \n\t") for _ in range(rng.randint(1, 80))) for _ in range(n)]
    texts.append("the end of " * 4000)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, "the end")]


def low(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def slow(rows, order, min_count=2):
    counts, total = Counter(), 0
    for _, t in rows:
        ws = low(t)
        total += len(ws)
        for n in range(1, order + 1):
            counts.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for i, t in rows:
        ws, s, back = low(t), 0.0, 0
        for at in range(len(ws)):
            factor = 1.0
            for n in range(min(order, at + 1), 0, -1):
                gram = tuple(ws[at - n + 1 : at + 1])
                if n == 1:
                    s += math.log(factor * counts[gram] / total)
                elif counts[gram] >= min_count:
                    s += math.log(factor * counts[gram] / counts[gram[:-1]])
                else:
                    factor *= op.BACKOFF
                    continue
                back += n < order
                break
        out.append((i, len(ws), s, back))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("order", "chunk", "part"), [(3, 1 << 20, 1 << 21), (2, 300, 500), (4, 100, 200)])
def test_scores_match_a_dictionary(spark, monkeypatch, order, chunk, part):
    rows = corpus()
    monkeypatch.setattr(op, "PART_GRAMS", part)
    monkeypatch.setattr(op, "CHUNK_WORDS", chunk)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.log_score, r.n_backoff) for r in op.score_documents(docs, order=order).collect()), key=repr)
    want = slow(rows, order)
    assert [(g[0], g[1], g[3]) for g in sorted(got, key=lambda g: (repr(g[0]), g[1], round(g[2], 6)))] == [
        (w[0], w[1], w[3]) for w in sorted(want, key=lambda w: (repr(w[0]), w[1], round(w[2], 6)))
    ]
    assert np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want))


def test_count_tables(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b")], "doc_id bigint, text string")
    got = {n: sorted(r["count"] for r in op.count_tables(docs).where(f"n = {n}").collect()) for n in (1, 2, 3)}
    assert got == {1: [3, 3], 2: [1, 3], 3: [1, 1]}


def test_packing():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64))
    assert (op.unpack(op.pack(values)) == values).all()
    counts = np.arange(5000) * 800_000
    assert (op.unpack_counts(op.pack_counts(counts)) == counts).all()


def test_counts_beyond_32_bits(spark):
    gram, most = np.array([7, 9], np.uint64), 0xFFFFFFFF
    sent = [(1, 0, c, op.pack(gram), op.pack_counts(np.array([most, 1]))) for c in (5, 6, 8)]
    exploded = spark.createDataFrame([(n, p, c, bytearray(g), bytearray(k)) for n, p, c, g, k in sent], "n int, part bigint, chunk bigint, grams binary, counts binary")
    got = op.answers(exploded).collect()
    assert sorted(r.chunk for r in got) == [5, 6, 8]
    assert all(op._numbers(bytes(r.counts), "<i8").tolist() == [3 * most, 3] for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.score_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, op.score_documents(blank).collect())) == [(1, 0, 0.0, None, 0), (2, 0, 0.0, None, 0)]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables are not there")
def test_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert oracle.compare(queries.QUERIES["op6_backoff_lm"](spark, folder), oracle.connect(folder), op.SQL) == []
