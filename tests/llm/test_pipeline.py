import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam

from . import helpers as h

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def corpus(spark, tmp_path):
    """A folder with documents, labels and benchmark."""
    items = [(k, h.prose(800 + k, 30, 9000)) for k in range(5)]
    rows = [r for r in h.edge_rows() if r[0] is not None]
    rows += [(100 + k, h.prose(900 + k, 60) + (f" zorg{k} plonk{k} zorg{k}" if k % 4 == 0 else "")) for k in range(240)]
    rows += [(400 + k, h.prose(1300 + k, 40) + " " + items[k][1]) for k in range(5)]
    labels = [(100 + k, 1, int(k % 4 == 0)) for k in range(240)]
    h.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_stages_against_plain_versions(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    texts = dict(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        got = {r["doc_id"]: r for r in out.collect()}
        if name == "toxicity":
            bad = {100 + i for i in range(0, 240, 4)}
            gone = set(texts) - set(got)
            assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 3
        elif name == "line_dedup":
            assert {i: r["text"] for i, r in got.items()} == {i: t for i, _, _, t in h.dedup_lines(list(texts.items()))}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "jaccard_join":
            order = list(texts.items())
            sets, comp = h.components(order)
            least = {c: min(order[j][0] for j in range(len(order)) if comp[j] == c) for c in set(comp)}
            assert set(got) == {i for j, (i, _) in enumerate(order) if not sets[j] or i == least[comp[j]]}
        elif name == "decontamination":
            own = [" ".join(h.words(h.low(t))).encode() for _, t in items]
            bad = {i for i, t in texts.items() for x in own if decontam.best_place(x, " ".join(h.words(h.low(t))).encode())[0] <= len(x) * 20 // 100}
            assert set(got) == set(texts) - bad and bad
        else:
            assert {i: r["decoded_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            texts = {i: r["text"] for i, r in got.items()}
            docs = out.select(*columns)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    ran = corpus_pipeline.run(spark, path)
    assert {r["doc_id"]: r["decoded_sha256"] for r in ran.select("doc_id", "decoded_sha256").collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert ran.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_null_and_repeated_ids_by_row(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    item, a, b, clean = h.prose(31, 30, 9000), h.prose(32, 80), h.prose(33, 80), h.prose(34, 80)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    get = lambda name, rows: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, h.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path)).collect()), key=str)
    # Copies without ids, a row repeated with id and text, a row with the id of a copy, a copy with and without an id.
    rows = [(None, a), (None, a), (5, b), (5, b), (7, b), (7, clean), (None, b)]
    assert get("jaccard_join", rows) == sorted([(None, a), (5, b), (7, clean)], key=str)
    held = clean + " " + item
    assert get("decontamination", [(None, held), (None, a), (5, held), (5, b), (6, clean)]) == sorted([(None, a), (5, b), (6, clean)], key=str)
    # Every row of the line stage stays, with its own text.
    assert get("line_dedup", [(None, a), (5, b), (5, b)]) == sorted([(None, a), (5, b), (5, b)], key=str)
