"""Quality rules against SQL and brute force."""

import os
import random
import re
from collections import Counter

import oracle
import pytest

from meterbook.llm import quality_rules as op
from meterbook.llm import queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, row string"


def slow(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(wins)
    cover = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(ws), sum(map(len, ws)), sum(c in op.SYMBOLS for c in text), len(lines) - len(set(lines)), len(cover))


def rows():
    rng = random.Random(3)
    vocab = ["a", "b", "über", "x|", "#", "C", "𝔘x", "\x85y", "d\xa0e"]
    texts = [None, "", " ", "\n\n", "a", "a b c", "a a a a", "a b c\na b c\na b c \n", "x\x0by\x0cz\r\nx y z x y z"]
    texts += ["".join(rng.choice(vocab) + rng.choice(" \n\t") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts.append("w " * 30_000)
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s", "t", None]), "clash", "clash") for i, t in enumerate(texts)]
    return out + out[:3] + [(None, "a b", "en", "s", "", "")]


def test_counts_match_brute_force(spark):
    data = rows()
    got = sorted((tuple(r) for r in op.quality(spark.createDataFrame(data, SCHEMA)).collect()), key=repr)
    want = []
    for r in data:
        counts = slow(r[1])
        want.append((r[0], *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    assert [g[:7] for g in got] == sorted(want, key=repr)
    assert not any(g[6] and g[7] for g in got)


def test_cutoffs_follow_their_group(spark):
    noise = [(i, " ".join(["word"] * 0 + [f"w{i}x{k}" + "#" * (i % 4) for k in range(60)]), "en", "noisy") for i in range(300)]
    clean = [(1000 + i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "clean") for i in range(300)]
    odd = [(5000, " ".join(f"o{k}##" for k in range(60)), "en", "clean"), (5001, " ".join(f"p{k}##" for k in range(60)), "en", "noisy")]
    got = {r.doc_id: r.kept for r in op.quality(spark.createDataFrame(noise + clean + odd, "doc_id bigint, text string, lang string, source string"),).collect()}
    assert not got[5000] and got[5001] and all(got[r[0]] for r in clean + noise)


def test_keep_good_returns_the_input_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = op.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == op.quality(docs).where("kept").count()


def test_empty_table(spark):
    assert op.quality(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables are not there")
def test_matches_sql(spark):
    assert oracle.compare(queries.QUERIES["op5_quality_rules"](spark, FOLDER), oracle.connect(FOLDER), op.SQL) == []


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables are not there")
def test_is_native(spark):
    plan = queries.QUERIES["op5_quality_rules"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
