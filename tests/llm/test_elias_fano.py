"""Files of ids: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers
from pyarrow import fs
from tokenizers import Tokenizer

from meterbook.llm import elias_fano as op

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [5, 5, 9, 1000, 10**15], list(range(2000)), [0] + [3] * 700 + [2**40] * 3])
def test_sequences(values):
    found = op.EliasFano.decode(op.EliasFano.encode(np.array(values, np.uint64)))
    assert [found[i] for i in range(len(values))] == values
    for start in {0, 1, len(values) // 3, 256, len(values)}:
        assert found.run(start, len(values)) == values[start:]
    with pytest.raises(IndexError):
        found[len(values)]


def test_space_is_near_minimal():
    values = np.sort(np.random.default_rng(1).integers(0, 10**9, 20_000))
    assert len(op.EliasFano.encode(values)) * 8 / len(values) < 2 + np.log2(10**9 / 20_000) + 1


def corpus():
    rng = random.Random(6)
    vocab = ["the", "End's", "é!", "<|endoftext|>x", "\xa0", "日本", "###", "<|startoftext|>", "a\x85b"] + [f"w{i}ing" for i in range(200)]
    texts = [None, "", "  \n"] + [" ".join(rng.choices(vocab, k=rng.randint(1, 200))) for _ in range(120)] + ["the end " * 30_000]
    rows = [((i * 37) % 1009 - 300, t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "null id"), (None, None)]


def test_files_round_trip(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int")
    got = op.store_and_read(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {i: sorted(v) for i, v in want.items()} == {
        i: sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) for i in {r.doc_id for r in got}
    }
    at = 0
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_single_documents_can_be_read(spark, tmp_path):
    docs = spark.createDataFrame([(10, "first text"), (20, "second text here")], "doc_id bigint, text string")
    path = str(tmp_path / "ids")
    manifest = op.write_files(docs.coalesce(1), path, PATH).orderBy("part").collect()
    library = Tokenizer.from_file(PATH)
    seen = {}
    for row in manifest:
        found = op.IdFile(fs.LocalFileSystem(), f"{path}/{row.file}")
        seen |= {d: found.document(i).tolist() for i, d in enumerate(found.doc_ids(0, found.documents))}
    assert seen == {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}


def test_stretches_cover_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "_READ_IDS", 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "ids")
    for row in op.write_files(docs.coalesce(1), path, PATH).collect():
        found = op.IdFile(fs.LocalFileSystem(), f"{path}/{row.file}")
        at = 0
        for names, bounds, ids in found.stretches():
            assert len(names) == len(bounds) - 1 and len(ids) == bounds[-1] - bounds[0]
            for k, name in enumerate(names):
                assert found.doc_ids(at, at + 1) == [name]
                assert found.document(at).tolist() == ids[bounds[k] - bounds[0] : bounds[k + 1] - bounds[0]].tolist()
                at += 1
        assert at == found.documents == row.documents


def test_empty_table(spark):
    assert op.store_and_read(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_letters_alone_are_one_word(monkeypatch):
    encoder, library, cut = op.PieceEncoder(PATH), Tokenizer.from_file(PATH), []
    whole = encoder.vocabulary.cut
    monkeypatch.setattr(encoder.vocabulary, "cut", lambda pieces: cut.extend(pieces) or whole(pieces))
    texts = ["The THE the End ends", "don't Straße İx ﬁn ſ K", "abc1 abc, <|endoftext|> \x7f x\x00y", "", "Zebra zebra!"]
    for text, ids in zip(texts, encoder.batch([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert cut and not any(p.isalpha() for p in cut)
