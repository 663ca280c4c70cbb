import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import types as T

from opinara.config import RunConfig, TfidfConfig
from opinara.functions.constants import CLASSES
from opinara.operators import models as M
from opinara.plans.classify import classify_path
from opinara.plans.train import run
from opinara.sources.files import read_csv
from opinara.sources.lexicon import built_in_lexicon
from opinara.streaming.score import score_stream

CONFIG = RunConfig(
    n_per_class=20,
    nb_alphas=(0.1, 1.0),
    mlp_hidden=((4,),),
    mlp_max_iter=(20,),
    n_folds=2,
    tfidf=TfidfConfig(max_features=60),
)
PHRASES = {5.0: "great perfect love cards", 3.0: "okay average plain card", 1.0: "terrible awful waste card"}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rows = [
        (f"r{i}-{int(stars)}", stars, f"{phrase} number{i % 3} shop{i % 5}!")
        for stars, phrase in PHRASES.items()
        for i in range(25)
    ]
    reviews = spark.createDataFrame(rows, "review_id string, overall double, reviewText string")
    out = str(tmp_path_factory.mktemp("run"))
    comparison = {r["model"]: r for r in run(reviews, built_in_lexicon(spark), out, CONFIG).collect()}
    return out, comparison


def test_run_outputs(spark, trained):
    out, comparison = trained
    assert set(comparison) == {"VADER", "TextBlob", "Naive Bayes", "MLP"}
    assert all(r["n"] == 18 for r in comparison.values())
    assert comparison["Naive Bayes"]["f1"] > 0.9
    meta = spark.read.json(f"{out}/metadata.json").first()
    assert (meta["dataset_rows"], meta["subset_rows"], meta["train_rows"], meta["test_rows"]) == (75, 60, 42, 18)
    assert meta["test_class_distribution"].asDict() == {c: 6 for c in CLASSES}
    assert len(meta["results"]) == 4
    assert spark.read.option("header", True).csv(f"{out}/enhanced_ratings.csv").count() == 60
    assert spark.read.option("header", True).csv(f"{out}/metrics.csv").columns == ["Model", "Accuracy", "Precision", "Recall", "F1"]


def test_saved_model_classifies_frames(spark, trained):
    model = PipelineModel.load(f"{trained[0]}/model")
    df = spark.createDataFrame([(1, "love this great card"), (2, None), (3, "awful waste")], "id int, text string")
    assert model.stages[0].getOrDefault("lemmas") == {"cards": "card"}
    out = M.classify_frame(df, model)
    assert out.columns == ["id", "text", *M.OUTPUTS]
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 3 and rows[2]["text"] is None
    assert rows[1]["nb_sentiment"] == "Positive" and rows[3]["nb_sentiment"] == "Negative"
    for r in rows.values():
        assert r["models_agree"] == (r["nb_sentiment"] == r["mlp_sentiment"])
        assert r["final_sentiment"] == r["mlp_sentiment"]


def test_stream_equals_batch(spark, trained, tmp_path):
    texts = [{"text": t} for t in PHRASES.values()] + [{"text": "okay love"}]
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        lines = "\n".join(json.dumps(t) for t in texts[2 * i : 2 * i + 2])
        (source / f"{i}.json").write_text(lines, encoding="utf-8")
    column = classify_path(spark, f"{trained[0]}/model", str(source / "0.json"), str(tmp_path / "one.csv"), requested_format="csv")
    assert column == "text"
    assert spark.read.option("header", True).csv(str(tmp_path / "one.csv")).count() == 2
    model = PipelineModel.load(f"{trained[0]}/model")
    schema = T.StructType([T.StructField("text", T.StringType())])
    query = score_stream(spark, model, str(source), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    streamed = spark.read.json(str(tmp_path / "out"))
    batch = M.classify_frame(spark.read.schema(schema).json(str(source)), model)
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_uploads_with_working_column_names(spark, trained):
    model = PipelineModel.load(f"{trained[0]}/model")
    names = ["features", "review_length", "_counts", "nb_index", "exclamation_count", "_input_text", "nb.raw"]
    df = spark.createDataFrame([("love this great card", *range(len(names)))], ["text", *names])
    row = M.classify_frame(df, model).first()
    assert [row[n] for n in names] == list(range(len(names))) and row["nb_sentiment"] == "Positive"


def test_csv_stream_with_quotes_and_nulls(spark, trained, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text('id,text,note\n1,"he said ""love, it"" twice",\n2," two\nlines ",x\n3,,y\n', encoding="utf-8")
    model = PipelineModel.load(f"{trained[0]}/model")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])
    batch = M.classify_frame(read_csv(spark, str(source), schema), model)
    for fmt in ("csv", "json"):
        out = str(tmp_path / f"out-{fmt}")
        score_stream(spark, model, str(source), schema, out, str(tmp_path / f"state-{fmt}"), "csv", requested_format=fmt).awaitTermination()
        back = read_csv(spark, out, batch.schema) if fmt == "csv" else spark.read.schema(batch.schema).json(out)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_stream_of_json_arrays(spark, trained, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps([{"text": "love"}, {"text": "awful"}], indent=2), encoding="utf-8")
    (source / "b.json").write_text('{"text": "okay"}\n\n{"text": "card"}\n', encoding="utf-8")
    (source / "c.json").write_text(json.dumps({"text": "one"}, indent=1), encoding="utf-8")
    schema = T.StructType([T.StructField("text", T.StringType())])
    out = str(tmp_path / "out")
    score_stream(spark, PipelineModel.load(f"{trained[0]}/model"), str(source), schema, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.json(out).collect()) == ["awful", "card", "love", "okay", "one"]
