import sys
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

from helpers import documents, edited, odd_texts, prose
from tieweave.llm import toxicity as tox

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
BAD = ["vilezz", "grotzz", "snarkzz"]


def _labelled(n, neutral="muslim"):
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        ws = prose(i, 40, 500)
        if toxic:
            ws[7], ws[20] = BAD[i % 3], "Vile" + ws[3]
            # Group names go along with insults in the sample, but are none.
            if i % 8 == 0:
                ws[9] = neutral
        texts.append(" ".join(ws))
        labels.append((i, 1, int(toxic)))
    return texts, labels


@pytest.fixture(scope="module")
def fitted(spark):
    texts, labels = _labelled(600)
    docs = documents(spark, texts, clashing=True)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, known, tox.fit(docs, known), texts, labels


def test_held_out_rule(spark):
    got = {r.doc_id: r.h for r in documents(spark, ["x"] * 300).select("doc_id", tox.held_out(tox.F.col("doc_id")).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 4 == 2 for i in range(300)}


def test_held_out_accuracy_and_scores(spark, fitted):
    docs, known, model, texts, labels = fitted
    rows = {r.doc_id: r for r in tox.scored(docs.select("doc_id", "text"), model).collect()}
    held = [i for i in range(600) if crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i].predicted == labels[i][2] for i in held) / len(held) > 0.97
    weight = dict(zip(model.features, model.weights, strict=True))
    for i in range(40):
        feats = set()
        for w in texts[i].lower().split():
            feats |= {w + " "} | {w[:n] for n in tox.BEGINNINGS if len(w) > n}
        logit = model.intercept + sum(weight.get(f, 0) for f in feats)
        assert abs(rows[i].score - 1 / (1 + np.exp(-logit))) < 1e-9 and rows[i].predicted == (rows[i].score >= tox.THRESHOLD)


def test_swaps_change_little_and_neutral_mentions_stay_clean(spark, fitted, monkeypatch):
    docs, known, model, _, _ = fitted
    monkeypatch.setattr(tox, "SWAP_PENALTY", 0.0)
    free = tox.fit(docs, known)
    texts = [" ".join(["muslim", *prose(5000 + i, 25, 500)]) for i in range(30)]
    swapped = [t.replace("muslim", "catholic") for t in texts]

    def score(m, ts):
        return np.array([r.score for r in sorted(tox.scored(documents(spark, ts).select("doc_id", "text"), m).collect())])

    held, loose = np.abs(score(model, texts) - score(model, swapped)), np.abs(score(free, texts) - score(free, swapped))
    assert held.mean() < 0.2 * loose.mean() and (score(model, texts) < tox.THRESHOLD).mean() >= (score(free, texts) < tox.THRESHOLD).mean()


def test_odd_rows_and_missing_labels(spark, fitted):
    docs, known, model, _, _ = fitted
    odd = documents(spark, odd_texts() + ["x"], ids=[*range(len(odd_texts())), None], clashing=True)
    rows = tox.toxicity(odd, known.limit(0)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows}) == 1
    both = known.unionByName(known.withColumn("toxic", tox.F.lit(None).cast("int")))
    assert tox.fit(docs, both).features == model.features
    kept = tox.not_toxic(docs, known)
    assert kept.columns == docs.columns and {r.score for r in kept.select("score").collect()} == {"score"}
    assert tox.toxicity(documents(spark, []), known).count() == 0


def test_pipeline_catches_and_keeps(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    texts, labels = _labelled(400)
    item = " ".join(prose(31337, 30))
    base = prose(777, 120)
    extra = [" ".join(base), " ".join(edited(base, 1, 1)), "clean words " + " ".join(prose(4, 60)) + " " + item, None, "", " ".join(prose(12, 70)) + "\n" + texts[1] + "\n" + " ".join(prose(13, 70))]
    docs = documents(spark, texts + extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    toxic = {i for i in range(400) if labels[i][2]}
    clean = set(range(400)) - toxic
    assert len(kept[0] & toxic) <= 0.03 * len(toxic) and len(clean - kept[0]) <= 0.01 * len(clean)
    assert kept[1] == kept[0]
    lines = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert texts[1] not in lines[405] and lines[1] == texts[1] and lines[403] is None
    assert (kept[2] & {403, 404, 405}) == {403, 404, 405}
    assert 402 in kept[2] and 402 not in kept[3] and len(kept[2] - kept[3]) == 1
    assert kept[4] == kept[3]
    assert len(pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == len(kept[4])


def test_features_of_texts_looked_at_together_take_little_memory():
    """A task used to take features of 8 MB of text at once, which a pipeline's executor has no room for."""
    import tracemalloc

    import pyarrow as pa
    from tieweave.llm import text as tx

    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(prose(i, 400)) for i in range(2_000)])], names=["text"])
    tracemalloc.start()
    for _, texts in tx.slices(iter([batch]), "text", tox.SLICE_BYTES):
        tox.text_features(texts)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
