"""Repairs against an enumeration of all edits."""

import hashlib
import random
import re
import zlib

import pytest

from meterbook.llm import conversation_repair as op

TEXTS = ["Yes.", "No!", "cut", "  ", "", "Why? ", "\tend.\n", "ét\xe9", "a\x85"]
ROLES = ["user", "assistant", "system", "tool", "", "u", None]


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def slow_edits(rows):
    """Cheapest (cost, audit, lines) of (role, text, fault) over all edits, by trying them."""
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, lines):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in lines)):
            best[0] = min(best[0], (cost, audit, lines))
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*lines, (role, "")])
        if i < len(rows):
            role, text, found = rows[i]
            go(i + 1, cost + 3, audit + "D", lines)
            if found not in ("blank", "duplicate"):
                more = found == "truncated"
                go(i + 1, cost + more, audit + "K", [*lines, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*lines, (other, text)])

    go(0, 0, "", [])
    return best[0]


def slow(rows, edits):
    out = {}
    damaged = slow_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in own:
            kept = re.sub("[\x20\x09-\x0d]+", "", text)
            found = "blank" if not kept else "duplicate" if (role, text) in seen else None if kept[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[found] += 1
            marked.append((role, text, found))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = edits(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def table_edits(rows):
    """The same by a table over rows and states, for long conversations."""
    flow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def inserts(states):
        for _ in range(4):
            for (state, letter), after in flow.items():
                if letter != "s" and state in states:
                    cost, audit, lines = states[state]
                    made = (cost + 2, audit + "I", (*lines, ({"u": "user", "a": "assistant"}[letter], "")))
                    if after not in states or made[:2] < states[after][:2]:
                        states[after] = made
        return states

    best = inserts(best)
    for role, text, found in rows:
        more, after = found == "truncated", {}
        for state, (cost, audit, lines) in best.items():
            made = [(state, (cost + 3, audit + "D", lines))]
            if found not in ("blank", "duplicate"):
                if (state, role[:1]) in flow:
                    made.append((flow[state, role[:1]], (cost + more, audit + "K", (*lines, (role, text)))))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (state, letter) in flow:
                        made.append((flow[state, letter], (cost + 2 + more, audit + "R", (*lines, (name, text)))))
            for to, value in made:
                if to not in after or value[:2] < after[to][:2]:
                    after[to] = value
        best = inserts(after)
    return min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            shown = rng.choice([turn, turn, turn, turn + 7, None]) if rng.random() < 0.3 else turn
            role = rng.choice(ROLES) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, shown, role, rng.choice([*TEXTS, None, f"text {turn}."])))
    return rows


def run(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, at int")
    found = op.audits(op.damage(docs), docs, **sizes)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = found.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_agenda_matches_enumeration():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 4))]
        cost, audit, lines = slow_edits(rows)
        (weight,) = op.lightest([op.row_rules(r[:1], f) for r, _, f in rows], op.START, op.GOALS, True).values()
        assert weight == (cost, audit) == table_edits(rows)[:2]
        assert [(r, t) for _, r, t in op.edit_rows(audit, [(r, t) for r, t, _ in rows])] == lines


def test_small_conversations(spark):
    rows = conversations(1, 60, 4)
    assert run(spark, rows) == slow(rows, slow_edits)


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 3, "fan_in": 2}, {"piece_rows": 1, "fan_in": 3}])
def test_pieces_give_the_same_repair(spark, sizes):
    rows = conversations(2, 30, 12) + [(1000, t % 900, ROLES[t * t % 5], TEXTS[t * 7 % 9] + (str(t) if t % 3 else "")) for t in range(600)]
    rows += [rows[5], rows[5]] + [(2000, 1, "user", "same.")] * 50
    assert run(spark, rows, **sizes) == slow(rows, table_edits)


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", " ")]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    cut = op.pieces(docs, 1)
    got = op.repaired_rows(cut, op.solve(cut, 2)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "K", "user", "Hi"), (1, 1, "K", "assistant", "Yes.")]


def test_empty_table(spark):
    assert run(spark, [], piece_rows=2) == {}
