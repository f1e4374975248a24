"""The registered queries, by their contracts, on the driver's smallest tables."""

import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_pii_warc import brute_replace
from test_simhash import plain_fingerprint

from tidemark.llm import queries
from tidemark.llm.quality import bag

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{DATA}/{n}.parquet").collect() for n in ("documents", "embeddings", "pages", "labels")}


def columns(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, tables):
    df = queries.op1_simhash(spark, DATA)
    assert {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}.items() <= columns(df).items()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in tables["documents"]}
    root = {k: k for k in prints}
    for _ in range(6):
        for a in prints:
            root[a] = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()} == {k: (f"{v:016x}", root[k]) for k, v in prints.items()}


def test_op2(spark, tables):
    df = queries.op2_nearest(spark, DATA)
    assert columns(df) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in tables["embeddings"]}
    got = {}
    for r in df.collect():
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert set(got) == {k for k in x if k % 20 == 0}
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: r[1:])
        hit += len({r[2] for r in rows} & {k for _, k in sorted((-(x[q] @ v), k) for k, v in x.items() if k != q)[:20]})
    assert hit >= 0.9 * 20 * len(got)


def test_op3(spark, tables):
    got = {r["doc_id"]: r["text"] for r in queries.op3_pii(spark, DATA).collect()}
    rows = tables["documents"]
    assert got == dict(zip([r["doc_id"] for r in rows], brute_replace([r["text"] for r in rows], queries.PII_KEY), strict=True))


def test_op4(spark, tables):
    df = queries.op4_quality(spark, DATA)
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= columns(df).items()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = queries.quality_model(spark, docs.select("doc_id", "text"), DATA)
    text = {r["doc_id"]: r["text"] or "" for r in tables["documents"]}
    for r in df.collect():
        rows, share = bag(text[r["doc_id"]], model.bits)  # the mean of the features' weights, then the softmax of two classes
        want = 1 / (1 + np.exp(-(float((model.weights[rows].astype(float) * share).sum()) + model.bias)))
        assert abs(r["score"] - want) < 1e-5 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 3) == 1)


def test_op5_to_op8(spark, tables):
    text = {r["doc_id"]: r["text"] or "" for r in tables["documents"]}
    df = queries.op5_mixing(spark, DATA)
    assert {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items() <= columns(df).items()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]])) and r["taken"] <= 3 * r["size"] for r in df.collect())
    df = queries.op6_token_counts(spark, DATA)
    assert columns(df) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    import sentencepiece
    import tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in df.collect():
        n = len(sp.encode(text[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 4096)
    df = queries.op7_packing(spark, DATA)
    assert {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"} == columns(df)
    bpe, full = tokenizers.Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), {}
    for r in df.collect():
        ids = np.array([*bpe.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    df = queries.op8_warc(spark, DATA)
    assert {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}.items() <= columns(df).items()
    assert df.count() == len(tables["pages"]) and df.where("problem IS NOT NULL").count() == 0


def test_op9_against_its_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{DATA}/embeddings.parquet')")
    want = con.sql(queries.OP9_SQL).project("vec_id, n_links, component_id, kept").fetchall()
    df = queries.op9_embedding_dedup(spark, DATA)
    assert columns(df) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_op10(spark, tables):
    import zstandard

    from tidemark.llm.langid import learn_dictionaries, plain

    df = queries.op10_language(spark, DATA)
    assert {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}.items() <= columns(df).items()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    learnt = learn_dictionaries(docs.where(queries.fold(docs["doc_id"], 5) != 0))
    packs = {k: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, v in learnt.items()}
    rows = {r["doc_id"]: r for r in df.collect()}
    right = total = 0
    for r in tables["documents"]:
        got, data = rows[r["doc_id"]], plain(r["text"] or "")
        assert got["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= got["score"] <= 1
        sizes = {k: sum(len(p.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for k, p in packs.items()}
        assert got["lang_pred"] == (min(sizes, key=sizes.get) if any(c.isalpha() for c in r["text"] or "") else "und")
        total, right = total + got["held_out"], right + (got["held_out"] and got["lang_pred"] == r["lang"])
    assert right >= 0.9 * total


def test_texts_without_letters_are_undetermined(spark):
    from tidemark.llm.langid import identify, learn_dictionaries

    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ²", "x"), (2, "Ⅷ 12", "x"), (3, "", "x"), (4, None, "x"), (5, "le chien " * 60_000, "x"), (6, "the dog", "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(odd, learn_dictionaries(docs)).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "und", 5: "fr", 6: "en"}
