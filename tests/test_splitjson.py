"""Documents read by ranges against a parser that reads them whole."""

import json
import random

import pytest

from meterbook.sources import splitjson as op
from meterbook.sources.portable import read_split_documents

TEXTS = ["", "a", 'q"uote', "back\\slash", "\\", "\\\"", "],[{}", "é€😀", "\u2028", "{\"records\":[", ",", ":", " " * 9]


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -12, 3.5, 1e-7, 12345678901])
    if kind < 5:
        return rng.choice(TEXTS) * rng.randint(1, 3)
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(TEXTS) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def document(rng):
    fields = {}
    for i in range(rng.randint(0, 6)):
        fields[f"f{i}{rng.choice(TEXTS)}"] = [value(rng, 1) for _ in range(rng.randint(0, 6))] if rng.random() < 0.6 else value(rng)
    return fields


def whole(doc):
    out = []
    for field, v in doc.items():
        out += [("array", field, None)] + [("element", field, x) for x in v] if isinstance(v, list) else [("value", field, v)]
    return out


def by_ranges(path, size, split):
    out, state, depth, field = [], op.OUT, 0, None
    data = path.read_bytes()
    for begin in range(0, max(size, 1), split):
        end = min(begin + split, size)
        for kind, name, place, text in op.elements(str(path), begin, end, state, depth):
            field = name if name is not None or kind != "element" else field
            out.append((kind, field, None if text is None else json.loads(text)))
            assert kind == "array" or text is None or data[place : place + len(text.encode())] == text.encode()
        state, more = op.after(data[begin:end], state)
        depth += more
    return out, (state, depth)


def test_ranges_of_any_size_give_the_whole(tmp_path, monkeypatch):
    rng = random.Random(11)
    for i in range(250):
        monkeypatch.setattr(op, "_LOOK_AHEAD", rng.choice([1, 3, 64, 1 << 16]))
        doc = document(rng)
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]), separators=rng.choice([None, (",", ":"), (" , ", " : ")]))
        path = tmp_path / f"{i}.json"
        path.write_bytes(text.encode())
        for split in (1, 2, 7, rng.randint(3, 60), 1000):
            got, end = by_ranges(path, len(text.encode()), split)
            assert got == whole(doc), (text, split)
            assert end == (op.OUT, 0)


@pytest.mark.parametrize("text", ["\n", "[1]", "{", '{"a":1', '{"a" 1}', '{"a":[1,2}', '{"a":1}x', '{"a":[1 2]}', '{"a":"x}', "nonsense"])
def test_broken_documents_are_told(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text('{"records":[{"a":1}]}')
    for split in (2, 1000):
        rows = op.read_elements(spark, str(tmp_path), split).collect()
        assert {r.document[-6:] for r in rows if r.kind == "broken"} == {"a.json"}
        assert [json.loads(r.value) for r in rows if r.document.endswith("b.json") and r.kind == "element"] == [{"a": 1}]


def test_one_document_is_read_by_several_tasks(spark, tmp_path):
    records = [{"project": f'p"{i}', "note": "x" * (i % 50)} for i in range(3000)]
    (tmp_path / "large.json").write_text(json.dumps({"schema": "s", "records": records, "synthetic": True}))
    states = op.range_states(op.ranges(spark, str(tmp_path), 4096))
    assert states.count() > 20
    found, checks = read_split_documents(spark, str(tmp_path), 4096)
    rows = found.orderBy("place").collect()
    assert [json.loads(r.record) for r in rows] == records
    assert {(r.schema, r.synthetic, r.timezone) for r in rows} == {("s", "true", None)}
    assert [r.check for r in checks.collect()] == ["document-schema"]


def test_a_document_in_parts_is_one_document(spark, tmp_path):
    """Files of a folder follow each other by name, wherever they are cut, whatever the ranges."""
    records = [{"project": f'p"{i}', "note": "\\é" * (i % 9)} for i in range(200)]
    text = json.dumps({"schema": "s", "records": records, "synthetic": True}, ensure_ascii=False).encode()
    rng = random.Random(3)
    for name, cuts in (("one", 17), ("two", 1)):
        (tmp_path / name).mkdir()
        places = [0, *sorted(rng.sample(range(1, len(text)), cuts)), len(text)]
        for i, (begin, end) in enumerate(zip(places, places[1:], strict=False)):
            (tmp_path / name / f"part-{i:05d}.txt").write_bytes(text[begin:end])
    for split in (97, 1 << 20):
        rows = op.read_elements(spark, str(tmp_path), split, parts=True).orderBy("place").collect()
        for name in ("one", "two"):
            mine = [r for r in rows if r.document.endswith(name)]
            assert [json.loads(r.value) for r in mine if r.kind == "element"] == records
            assert {r.field for r in mine if r.kind == "element"} == {"records"} and not any(r.kind == "broken" for r in mine)
            assert all(text[r.place : r.place + len(r.value.encode())] == r.value.encode() for r in mine if r.value)


def test_an_element_costs_no_copy_of_the_rest_of_its_range(tmp_path):
    """Elements of a large range: time grows with the range, not with its square."""
    import time

    def seconds(n):
        (tmp_path / f"{n}.json").write_text('{"records":[' + ",".join(['{"a":"' + "x" * 300 + '"}'] * n) + "]}")
        size, start = (tmp_path / f"{n}.json").stat().st_size, time.perf_counter()
        assert sum(kind == "element" for kind, *_ in op.elements(str(tmp_path / f"{n}.json"), 0, size, op.OUT, 0)) == n
        return time.perf_counter() - start

    assert seconds(40_000) < 4 * max(seconds(10_000), 0.3)


def test_states_behind_ranges_without_backslashes():
    """Counting quotes tells the same as walking over the texts."""
    rng = random.Random(8)
    for _ in range(400):
        data = "".join(rng.choice('"[]{},a: ') for _ in range(rng.randint(0, 12))).encode()
        for state in (op.OUT, op.IN, op.ESCAPED):
            # a backslash pair inside a text of its own changes nothing, and sends it along the other way
            slow = op.after(b'"\\\\"' + data, state) if state == op.OUT else None
            if slow:
                assert op.after(data, state) == slow
            now, deeper = state, 0
            for byte in data.decode():
                if now == op.ESCAPED:
                    now = op.IN
                elif byte == '"':
                    now = op.OUT if now == op.IN else op.IN
                elif now == op.OUT:
                    deeper += (byte in "[{") - (byte in "]}")
            assert op.after(data, state) == (now, deeper), (data, state)
