import hashlib
import random
import time
from array import array

import pytest
import sentencepiece

from tidemark.llm import queries
from tidemark.llm.piece_codec import PieceCodec, encode_pieces
from tidemark.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


def check(codec, sp, text):
    want = sp.encode(text, add_bos=True, add_eos=True)
    ids = codec.encode(text)
    assert array("I", ids).tolist() == want, text[:100]
    assert codec.decode(ids) == sp.decode(want), text[:100]


@pytest.mark.parametrize("letters", ["abcdeth in▁ \n%$éñ日🙂0123,.\t\x00", "aeinrst", "  \t\n a", "aab", "the and ofing", "▁ ", "日本語中国的是", "\x00﻿​　 a", "====----****####    ", "<s></s>0xA<>"])
def test_random_texts(codec, sp, letters):
    rng = random.Random(letters)
    for _ in range(600):
        check(codec, sp, "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))))
    for _ in range(20):
        check(codec, sp, "".join(rng.choice(letters) for _ in range(rng.randint(300, 900))))


def test_pieces_put_together_at_random(codec, sp):
    rng = random.Random(1)
    pieces = sorted(codec.rank)
    for _ in range(4000):
        check(codec, sp, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))).replace("▁", rng.choice(["", " "])))


def test_very_long_stretches_take_time_in_proportion(codec, sp):
    for text in ("x" * 200_000, " " * 100_000 + "the", "ab" * 100_000, "\n" * 50_000, "日" * 50_000, "=-" * 50_000):
        check(codec, sp, text)
    took = []
    for n in (100_000, 800_000):
        began = time.process_time()
        codec.encode("ab" * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_tables_stay_bounded(codec, sp, monkeypatch):
    from tidemark.llm import piece_codec

    monkeypatch.setattr(piece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(piece_codec, "PAIRS", 50)
    rng = random.Random(2)
    for _ in range(200):
        check(codec, sp, " ".join("".join(rng.choice("abcdest") for _ in range(rng.randint(1, 9))) for _ in range(20)))
        assert len(codec.known) <= 51 and len(codec.fits) <= 51 + 400


def test_operator(spark, docs, corpus, no_docs, sp):
    out = encode_pieces(docs.withColumn("ids", docs["text"]).withColumn("id", docs["doc_id"]), MODEL)
    want = []
    for k, t, *_ in corpus:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        raw = array("I", ids).tobytes()
        want.append((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), raw, sp.decode(ids)))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"]), r["decoded"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert encode_pieces(no_docs, MODEL).count() == 0


def test_query(spark, sp):
    folder = "/root/testdata/sf0.001"
    df = queries.op12_pieces(spark, folder)
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()} == want
