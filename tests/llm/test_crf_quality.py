"""The field against enumeration, and held-out accuracy."""

import itertools
import os
import zlib

import numpy as np
import pytest

from meterbook.llm import crf_quality as op
from meterbook.llm import queries


def field(seed=1):
    rng = np.random.default_rng(seed)
    d = 3 * op.FEATURES
    return op.Field(np.zeros(d), np.ones(d), rng.normal(size=d), 0.3, rng.normal(size=2), rng.normal(size=(2, 2)))


def slow_marginals(f, own):
    unary = f.potentials(op.with_neighbours(own))
    total, good = 0.0, np.zeros(len(own))
    for states in itertools.product((0, 1), repeat=len(own)):
        s = f.start[states[0]] + sum(unary[t, y] for t, y in enumerate(states)) + sum(f.step[a, b] for a, b in zip(states, states[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(states)
    return good / total


def test_marginals_match_enumeration():
    texts = [b"", b"one line", b"A b\n\nc d e f\nA b\n### x", b"\n".join(b"w%d x!" % i for i in range(9)), b"a\n" * 8]
    own = [op.line_features(t)[0] for t in texts]
    for got, o in zip(op.marginals(field(), own), own, strict=True):
        assert np.allclose(got, slow_marginals(field(), o))


def test_score_weighs_lines_by_length():
    text = b"short\na much longer line with words\n"
    own, lengths = op.line_features(text)
    want = slow_marginals(field(), own) @ lengths / lengths.sum()
    assert lengths.tolist() == [6, 30, 1] and np.allclose(op.score(field(), [text])[0], want)


def test_rows_and_odd_input(spark):
    texts = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "w " * 50_000), (5, "l\n" * 3000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    assert {r.score for r in op.quality(docs, none).collect()} == {0.5}
    got = op.score_documents(docs, field()).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert op.score_documents(docs.limit(0), field()).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="test tables are not there")
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op3_crf_quality"](spark, folder).collect()}
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(r, q) for r, q in labels if r.held_out]
    good = [r.score for r, q in held if q == 1]
    bad = [r.score for r, q in held if q == 0]
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.97
