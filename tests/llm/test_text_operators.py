import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality
from tidemark.llm.mixing import apply_mix, mix_sources
from tidemark.llm.packing import byte_bpe, pack, plan
from tidemark.llm.queries import OP5_SQL, tokenizer_path
from tidemark.llm.token_counts import PieceModel, token_counts

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Token counts


def test_token_counts_are_the_librarys(docs, corpus, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = rows_of(token_counts(docs, PIECES))
    want = [(k, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for k, t, *_ in corpus]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_counts(no_docs, PIECES).count() == 0


def test_merging_random_texts():
    import sentencepiece

    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceModel(PIECES), random.Random(2)
    texts = ["".join(rng.choice("abcdeth in▁ \n%$éñ日🙂0123,.\t\x00") for _ in range(rng.randint(0, 90))) for _ in range(800)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(257, 500))) for _ in range(20)] + ["<s></s><unk><0x0A>", "▁", " ", ""]
    assert model.totals(texts) == [len(x) for x in sp.encode(texts, num_threads=1)]


# Mixing


def test_mix_matches_sorting(docs, tmp_path, spark):
    import duckdb

    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = con.sql(f"select doc_id, source, size, source_size, target, copies, taken from ({OP5_SQL})").fetchall()
    got = rows_of(mix_sources(spark.read.parquet(path)))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_mix_comes_near_its_targets_and_keeps_columns(docs, no_docs):
    got = mix_sources(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, r["target"], 0])
        s[0], s[2] = s[0] + r["taken"], max(s[2], r["size"])
    for taken, target, largest in by.values():
        assert taken <= target + 1e-6 and target - taken <= largest * 3
    out = apply_mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)
    assert mix_sources(no_docs).count() == apply_mix(no_docs).count() == 0


def test_targets_are_reshared(spark):
    rows = [(k, "w " * 10, "a", None, None) for k in range(10)] + [(100 + k, "w " * 10, "b", None, None) for k in range(100)]
    got = {r["source"]: r["target"] for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long")).collect()}
    assert got == {"a": 300.0, "b": 800.0}


# Packing


def test_packing_round_trip(docs, corpus, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    ids = {}
    for k, t, *_ in corpus:
        ids.setdefault(k, set()).add(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,))
    got = pack(docs, BYTES).collect()
    places = {}
    for r in got:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert r["piece"] == 0 or r["length"] == 2048
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(-(-len(next(iter(ids[k]) if k is not None else iter([x for x in ids[None] if (len(x) == 1) == (not t)]))) // 2048) for k, t, *_ in corpus)
    assert len(got) == total
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert pack(no_docs, BYTES).count() == 0


def test_plan_gives_every_rank_one_slot():
    rng = random.Random(1)
    counts = {rng.randint(1, 64): rng.randint(1, 300) for _ in range(40)}
    runs = sorted(plan(counts, 64))
    used, filled = {}, {}
    for n, (length, first, seq, offset) in enumerate(runs):
        end = runs[n + 1][1] if n + 1 < len(runs) and runs[n + 1][0] == length else counts[length]
        for k in range(first, end):
            used[length, k] = 1
            filled.setdefault(seq + k - first, []).append((offset, length))
    assert len(used) == sum(counts.values())
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_ids_are_the_tokenizers_librarys(words):
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(BYTES), byte_bpe(BYTES)
    for t in ["", "  a   b\n\n c\t", "I'll don't 123 ½ é  日本🙂", "x <|endoftext|> y<|endoftext|>", " ".join(words), "a" * 3000, " " * 500]:
        assert own.encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_long_runs_of_white_space():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(BYTES), byte_bpe(BYTES)
    pad, end = "word " * 25_000, "<|endoftext|>"
    runs = [" " * 1000, "\n" * 1001, " \t\r\n" * 400, "\u3000\xa0\u2028" * 500, "\t" * 1500 + " "]
    for t in [r.join(["", pad, "x", "1", "é", "...", end, ""]) for r in runs] + [pad + r + end + r for r in runs] + [" " * 1_000_000, pad + "\n" * 1_000_000 + " a", "\t" * 1_000_000 + "\x1c."]:
        assert own.encode(t) == tok.encode(t, add_special_tokens=False).ids
    assert len(own.encode("x" + " " * 10_000_000)) == 10_000_001


def test_packing_a_million_spaces(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_001 + "b")], "doc_id long, text string")
    got = pack(df, BYTES).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 1_000_001, 2: 500_004}


# Quality


def make_labelled(words, n=240):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        good = k % 3 != 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        rows.append((k, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good)))
    return rows, labels


def test_quality_held_out(spark, words):
    rows, labels = make_labelled(words)
    docs = spark.createDataFrame([*rows, (999, None), (998, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, marks.where("doc_id % 4 != 1"), bits=14)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[999] == got[998]
    held = [k for k, _ in labels if k % 4 == 1]
    assert np.mean([(got[k] >= 0.5) == (k % 3 != 0) for k in held]) >= 0.95
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_sample_is_bounded_and_degenerate_labels(spark, words):
    rows, labels = make_labelled(words, 60)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.training_rows(docs, marks, max_docs=10).count() == 10
    assert quality.fit(docs, marks.where("false"), bits=10).scores(["x"])[0] == pytest.approx(0.5)
    assert quality.fit(docs, marks.where("quality = 1"), bits=10).scores(["x", ""])[1] > 0.5


def test_features_do_not_cross_words_and_blocks_agree(monkeypatch):
    rows = lambda t: {int(x) for _, r in quality.features(np.frombuffer(t.encode(), np.uint8), 40) for x in r}
    assert rows("abc") <= rows("abc def") and not rows("abcdef") <= rows("abc def")
    text = " ".join(f"word{k % 13}" for k in range(900))
    whole = quality.bag(text, 18)[0]
    monkeypatch.setattr(quality, "BLOCK", 100)
    assert set(quality.bag(text, 18)[0]) <= set(whole)


# Language


def test_language_by_compression(spark):
    rng = random.Random(3)
    make = lambda stems: " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 120)))
    stems = {"aa": ["the", "ing", "sh", "er", "wh"], "bb": ["eau", "oi", "qu", "é", "tre"], "cc": ["sch", "ung", "ü", "ver", "tz"]}
    rows = [(k, make(stems[x]), x) for k, x in enumerate(rng.choice(list(stems)) for _ in range(300))]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 %% !!", "bb"), (1003, make(stems["cc"]) * 40, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    learned = langid.learn_dictionaries(df.where("doc_id % 5 != 0"), dict_bytes=8192, slice_chars=256)
    assert set(learned) == set(stems) and all(len(d) <= 8192 for d in learned.values())
    got = {r["doc_id"]: r for r in langid.identify(df, learned, min_margin=0.01).collect()}
    assert np.mean([got[k]["lang_pred"] == x for k, _, x in rows if k % 5 == 0]) >= 0.95
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["rejected"]
    empty = langid.learn_dictionaries(df.where("false"))
    assert empty == {} and {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(df.where("false"), learned).count() == 0


def test_ties_go_to_the_more_frequent_language():
    assert langid.classify([10, 10, 12], ["a", "b", "c"])[0] == "a"
    assert langid.classify([10, 10, 12], ["a", "b", "c"])[2] == 0


# Other columns do not get in the way


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words here", "s", 5, 6, 7), (2, "more words there", "s", 5, 6, 7)], "doc_id long, text string, source string, size int, id int, h int")
    assert [r["size"] for r in mix_sources(df).collect()] == [3, 3]
    assert apply_mix(df).columns == df.columns
    clash = df.select("*", *[F.lit(77).alias(c) for c in ("mix", "_mix", "mix_copy", "_mix_src", "src", "target", "threshold", "source_size", "whole")])
    taken = apply_mix(clash, weights=(1,), share=2.0).collect()
    assert len(taken) == 4 and {r["mix_copy"] for r in taken} == {r["_mix_src"] for r in taken} == {r["mix"] for r in taken} == {77}
    assert token_counts(df, PIECES).count() == pack(df, BYTES).count() == 2
    assert langid.identify(df, {"aa": b"some words"}).count() == 2
    assert hashlib.md5(b"").hexdigest()  # md5 is what the mix hashes ids with


def test_mix_is_nested(docs):
    less = {r["doc_id"] for r in mix_sources(docs, share=0.4).where("copies > 0 AND source = 'hot'").collect()}
    more = {r["doc_id"] for r in mix_sources(docs, share=0.8).where("copies > 0 AND source = 'hot'").collect()}
    assert less <= more
    assert docs.where(F.col("source") == "hot").count() > len(less)
