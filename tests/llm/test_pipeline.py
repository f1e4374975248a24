import pytest

import corpus_pipeline
from tidemark.llm import pii
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import fit
from tidemark.llm.queries import fold, quality_model


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng, path = random.Random(8), tmp_path_factory.mktemp("sf")
    words = ["".join(rng.choice(["an", "the", "re", "ing", "ou", "st", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for k in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = k % 5 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + (f" call +1 (212) 555-{k:04d}" if k % 4 == 0 else "")
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
        labels.append((k, int(not bad), 0))
    rows += [(200 + k, rows[k][1], "en", "src0", rows[k][4]) for k in range(1, 20)] + [(300, None, None, None, None), (301, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    held = {0: docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, docs, tables)
        if k < len(corpus_pipeline.STAGES):
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[k] = docs.collect()
    ids = {k: sorted(r["doc_id"] for r in rows) for k, rows in held.items()}
    text = {r["doc_id"]: r["text"] for r in held[0]}
    # Quality: the plain model on every document.
    model = quality_model(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert ids[1] == sorted(k for k in text if model.scores([text[k] or ""])[0] >= 0.5)
    assert not [k for k in ids[1] if k < 150 and k % 5 == 0] and len([k for k in ids[1] if k < 150]) == 120
    # Near-duplicates: by five-word shingles, the smallest id of each group stays.
    shingles = {k: {tuple((text[k] or "").lower().split()[i : i + 5]) for i in range(max(1, len((text[k] or "").split()) - 4))} for k in ids[1]}
    root = {k: k for k in shingles}
    for _ in range(5):
        for a in shingles:
            root[a] = min(root[b] for b in shingles if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    assert ids[2] == sorted(set(root.values())) and not [k for k in ids[2] if 200 <= k < 300]
    # Surrogates: no entity is left, all else is as before.
    real = {x[3] for k in ids[2] for x in pii.detect(text[k] or "")}
    assert ids[3] == ids[2] and real
    for r in held[3]:
        assert not {x[3] for x in pii.detect(r["text"] or "")} & real
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        if not pii.detect(text[r["doc_id"]] or ""):
            assert r["text"] == text[r["doc_id"]]
    # Mixing: as often as the mix says.
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(spark.createDataFrame(held[3])).collect()}
    assert ids[4] == sorted(k for k, n in copies.items() for _ in range(n))
    # Packing: every copy is there, and no sequence is too long.
    assert sorted(r["doc_id"] for r in held[5] if r["piece"] == 0) == ids[4]
    size = {}
    for r in held[5]:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 2048


def test_run_agrees_with_stages(spark, tables):
    a = sorted(map(str, corpus_pipeline.run(spark, tables).drop("sequence_id", "offset").collect()))
    assert a == sorted(map(str, corpus_pipeline.run(spark, tables).drop("sequence_id", "offset").collect())) and a


def test_held_out_rows_are_not_learnt(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    flipped = labels.withColumn("quality", (1 - labels["quality"])).where(fold(labels["doc_id"], 3) == 1).unionByName(labels.where(fold(labels["doc_id"], 3) != 1))
    a, b = (fit(docs, x.where(fold(x["doc_id"], 3) != 1)) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias
