"""The embedding job: what is done is not done again."""

import pytest
from pyspark.sql import functions as F

from folio.operators import vectors
from folio.sources import embeddings


def counted(folder, bad="none"):
    """A model that leaves a line for each text it is called with, and fails on some."""

    def make():
        def model(texts):
            if any(bad in x for x in texts):
                raise RuntimeError("no memory")
            with open(f"{folder}/calls", "a") as out:
                out.writelines(x + "\n" for x in texts)
            return [[float(len(x)), 1.0] for x in texts]

        return model

    return make


def calls(folder):
    try:
        with open(f"{folder}/calls") as f:
            return sorted(f.read().split())
    finally:
        open(f"{folder}/calls", "w").close()


def test_only_missing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    texts = lambda **x: spark.createDataFrame([*x.items(), ("null", None)], "text_id string, content string")
    assert embeddings.read(spark, path).collect() == []
    assert embeddings.embed_missing(texts(a="one", b="three"), path, "m", counted(tmp_path)) == 1
    assert calls(tmp_path) == ["one", "three"]
    embeddings.embed_missing(texts(a="one", b="three"), path, "m", counted(tmp_path))
    assert calls(tmp_path) == []  # a second run calls nothing
    embeddings.embed_missing(texts(a="one", b="changed", c="new"), path, "m", counted(tmp_path))
    assert calls(tmp_path) == ["changed", "new"]
    held = lambda: {r.text_id: r.embedding[0] for r in embeddings.read(spark, path).where("model_name = 'm'").collect()}
    assert held() == {"a": 3.0, "b": 7.0, "c": 3.0}
    embeddings.embed_missing(texts(a="one"), path, "other", counted(tmp_path))
    assert calls(tmp_path) == ["one"]
    before = held()
    embeddings.compact(spark, path)
    assert held() == before and len(embeddings.runs(spark, path)) == 1
    embeddings.embed_missing(texts(a="one", b="changed", c="new"), path, "m", counted(tmp_path))
    assert calls(tmp_path) == []


def test_failures(spark, tmp_path):
    """A batch that fails again and again stays missing, with its error; the others are kept."""
    path = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(f"t{i}", "bad" if i == 3 else f"text{i}") for i in range(6)], "text_id string, content string").coalesce(1)
    run = embeddings.embed_missing(df, path, "m", counted(tmp_path, "bad"), batch=1, tries=2, wait=0.0)
    assert {r.text_id: r.error for r in embeddings.errors(spark, path, run).collect()} == {"t3": "RuntimeError: no memory"}
    assert calls(tmp_path) == [f"text{i}" for i in (0, 1, 2, 4, 5)] and embeddings.missing(df, path, "m").count() == 1
    embeddings.embed_missing(df, path, "m", counted(tmp_path), batch=4)
    assert calls(tmp_path) == ["bad"] and embeddings.missing(df, path, "m").count() == 0


def test_added_ids(spark):
    """Ids are unique and go on without gaps, even where the new vectors come out differently each time they are made."""
    store = spark.createDataFrame([(7, [3.0, 4.0])], "vec_id long, embedding array<float>")
    new = spark.range(0, 1000, 1, 7).where(F.rand() < 0.5).select(F.array(F.rand(), F.lit(1.0)).alias("embedding"))
    got = vectors.add(store, new).cache()
    ids = [r.vec_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and sorted(ids) == list(range(7, 7 + len(ids)))
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="a vector without 2 values"):
            vectors.add(store, spark.createDataFrame([(bad,)], "embedding array<double>")).collect()
    assert vectors.add(store, store.select("embedding").limit(0)).count() == 1
