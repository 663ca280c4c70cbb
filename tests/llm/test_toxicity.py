"""The training sample of toxicity."""

import zlib

from opinara.llm import toxicity


def test_a_repeated_id_gives_one_training_text(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    docs = [(i, f"text {i}") for i in ids] + [(ids[0], f"text {ids[0]} again {k}") for k in range(400)]
    labels = [(i, k % 2) for k, i in enumerate(ids)]
    got = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: got.extend(zip(texts, y, strict=True)))
    # The hot id alone would fill a sample cut by rows.
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 10)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 10)
    toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(got) == sorted((f"text {i}", k % 2) for k, i in enumerate(ids))
