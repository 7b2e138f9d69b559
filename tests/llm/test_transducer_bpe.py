"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers
from tokenizers import Tokenizer

from meterbook.llm import transducer_bpe as op

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "Hello, World's end! it'll don't 'S", "<|startoftext|>a<|endoftext|> b<|endoftext|>", "x\x85y\xa0z   \x1c q", "ΑΣΣ ΑΣ. ΟΔΟΣ",
    "İstanbul ǅ ﬁn é é ạ̇ ạ̇", "日本語 テキスト 한국어 ไทย", "𝔘nicode 😀👍🏽 ①②③ ½ ²", "a\x00b \x7f \x1b[0m", "A" * 3000 + "!?" * 50,
    "antidisestablishmentarianism 0123456789 ab12cd", "'s 't 're", "ß ẞ ÿ Ÿ × ÷ ª º µ", "́ leading ​‍ zero﻿", "the the the of", " \U000e0001",
]


def texts(n=150):
    rng = random.Random(4)
    alphabet = "abcdeéÀñ '!.,#1290<|>\n\t" + "thertion" * 3
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(n)] + ["the end " * 20_000]


def test_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    data = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(data)] + [(3, data[3], ""), (None, "null id", "")], "doc_id bigint, text string, ids string")
    got = op.digest_documents(docs, PATH).collect()
    assert len(got) == len(data) + 2
    for r in got:
        text = "null id" if r.doc_id is None else data[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids), text[:50]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text[:50]
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text[:50]


def test_real_outputs_round_trip(spark):
    docs = spark.createDataFrame([(1, "Some words, some words."), (2, None)], "doc_id bigint, text string")
    vocabulary = op.Vocabulary(PATH)
    for r in op.encode_documents(docs, PATH).collect():
        assert op.decode(np.frombuffer(bytes(r.ids), np.uint32).tolist(), vocabulary) == r.decoded


def test_lexicon_is_minimal_and_complete(tmp_path):
    vocabulary = op.Vocabulary(PATH)
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))).encode() for _ in range(300)} | {"é".encode()})
    file = tmp_path / "lexicon"
    file.write_bytes(op.compile_lexicon(words, vocabulary))
    lexicon = op.Lexicon(str(file))
    assert lexicon.numbers(words).tolist() == list(range(len(words)))
    assert lexicon.numbers([b"", b"zzz", b"abcabcabc", words[0] + b"x"]).tolist() == [-1] * 4
    for n, ids in enumerate(vocabulary.merge(words)):
        assert lexicon.ids_of(n).tolist() == ids.tolist()
    # no two states have the same right language
    follow = {}

    def tails(state):
        if state not in follow:
            own = {b""} if lexicon.finals[state] else set()
            for key, target in zip(lexicon.keys.tolist(), lexicon.targets.tolist(), strict=True):
                if key >> 8 == state:
                    own |= {bytes([key & 255]) + t for t in tails(target)}
            follow[state] = frozenset(own)
        return follow[state]

    tails(0)
    assert len(set(follow.values())) == len(follow) == len(lexicon.finals)


def test_empty_table(spark):
    assert op.digest_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_idle_workers_remember_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id bigint, text string").repartition(8)
    assert op.digest_documents(docs, PATH).count() == docs.count()
    op.digest_documents(docs, PATH).collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.ids) + len(e.words) for e in op._ENCODERS.values())])], ["held"])

    assert {r.held for r in spark.range(8).repartition(8).mapInArrow(held, "held bigint").collect()} == {0}


def test_words_are_cut_as_by_pattern():
    vocabulary = op.Vocabulary(PATH)
    rng = random.Random(9)
    alphabet = ["a", "Z", "é", "À", "Þ", "ß", "ÿ", "×", "÷", "7", "!", "<", "|", ">", "'", "'re", "ł", "日", "\x00", "<|endoftext|>"]
    pieces = ["", "×", "÷", "<|", "|>", *("".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(4000))]
    words, codes, cuts, place = vocabulary.words(pa.array(pieces))
    assert len(set(words.to_pylist())) == len(words)
    got = [words[c].as_py() for c in codes.tolist()]
    special = {i: b"\xff" + i.to_bytes(4, "little") for i in vocabulary.special.values()}
    for i, parts in enumerate(vocabulary.cut([p.encode() for p in pieces])):
        assert got[cuts[place[i]] : cuts[place[i] + 1]] == [special[w] if isinstance(w, int) else w.encode() for w in parts], pieces[i]


def test_words_of_one_lot_are_held(monkeypatch):
    monkeypatch.setattr(op, "LOT_BYTES", 1000)
    rng = random.Random(3)
    data = [" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(60)) for _ in range(50)] + ["", None]
    batches = [pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"]) for t in data]
    encoder, library, got, held = op.Encoder(op.Vocabulary(PATH)), Tokenizer.from_file(PATH), [], []
    for lot in op._lots(iter(batches)):
        ids, at = encoder.encode(lot.column(0))
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        held.append(len(encoder.words))
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in data]
    assert len(held) > 20 and max(held) <= 180
