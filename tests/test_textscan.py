"""Text scans against the same patterns run by hand."""

import random
import re

from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.operators import textscan


def test_literal_starts():
    starts = {label: textscan.literal_start(pattern) for label, pattern in fixed.SECRET_PATTERNS}
    assert starts["AWS access key"] == "AKIA" and starts["Slack token"] == "xox" and starts["private key"] == "-----BEGIN "
    assert all(starts.values())
    assert textscan.literal_start("ab|cd") == "" and textscan.literal_start("abc*") == "ab" and textscan.literal_start("(?i)ab") == ""


def corpus():
    rng = random.Random(5)
    body = lambda n: "".join(rng.choices("abcdefGHIJ0123456789", k=n))
    made = [
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGH01234567", k=16)), lambda: "ghp_" + body(24), lambda: "github_pat_" + body(30), lambda: "sk-" + body(22),
        lambda: "AIza" + body(35), lambda: "xoxb-" + body(24), lambda: "glpat-" + body(20), lambda: "npm_" + body(22), lambda: "-----BEGIN RSA PRIVATE KEY-----",
        lambda: f"PassWord = '{body(14)}'", lambda: f'"api_key": "{body(16)}"', lambda: f"token: {body(12)}", lambda: f"Secret={body(13)};",
        lambda: "token = a long sentence of words", lambda: 'token: "words with blanks in them"', lambda: "password", lambda: "key:", lambda: "AKIA", lambda: "é\u212aey",
    ]
    texts = [None, "", "nothing here"] + ["\n".join(rng.choice(made)() for _ in range(rng.randint(1, 6))) for _ in range(150)]
    return texts + ["x " * 50_000 + "ghp_" + body(24)]


def slow(text):
    out = []
    for label, pattern in fixed.SECRET_PATTERNS:
        out += [(label, m.group(0)) for m in re.finditer(pattern, text, re.A)]
    for m in re.finditer(fixed.SECRET_ASSIGNMENT, text, re.A):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if m.group(1).lower() == "token" and (re.search(r"\s|[\u3400-\u9fff]", value) or re.fullmatch(r"[A-Z][A-Z0-9_]*", value)):
            continue
        out.append(("secret assignment", value))
    return [(label, v) for label, v in out if not any(w in v.lower() for w in fixed.PLACEHOLDER_WORDS)]


def test_secrets_match_brute_force(spark):
    rows = list(enumerate(corpus()))
    got = textscan.secret_findings(spark.createDataFrame(rows, "id int, text string"), ["id"])
    assert got.columns == ["id", "finding", "value"]
    want = sorted((i, *hit) for i, text in rows for hit in slow(text or ""))
    assert sorted(map(tuple, got.collect())) == want and len({w[1] for w in want}) == 10


def test_sensitive_keys_are_names_of_fields(spark):
    rows = [
        (1, '{"a": [{"Pass\\u0077ord": 1}]}', ["Password"]),
        (2, '{"note": "say \\"token\\": or \\"email\\": x"}', []),
        (3, '{"x": {"email" : {"cookie": null}}}', ["email", "cookie"]),
        (4, '{"email": 1, "email": ', ["email", "email"]),
        (5, None, None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "id int, body string").withColumn("names", textscan.sensitive_keys("body"))
    got = {r.id: None if r.names is None else sorted(r.names) for r in docs.select("id", F.col("names")).collect()}
    assert got == {i: None if names is None else sorted(names) for i, _, names in rows}
