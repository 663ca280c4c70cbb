import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions import constants as C
from opinara.operators import generate as G
from opinara.operators.models import resolve_text_column
from opinara.plans.tasks import run_tasks
from opinara.sources import files, results
from opinara.sources.lexicon import read_lexicon
from opinara.sources.reviews import scan_reviews, with_review_id

TEXTS = ["This was amazing", "It was okay", "I hated it"]


def _write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "content",
    [
        json.dumps([{"text": t} for t in TEXTS]),
        json.dumps([{"text": t} for t in TEXTS], indent=2),
        "\n".join(json.dumps({"text": t}) for t in TEXTS) + "\n",
    ],
)
def test_json_forms_agree(spark, tmp_path, content):
    df, fmt = files.read_upload(spark, _write(tmp_path / "reviews.JSON", content))
    assert fmt == "json" and sorted(r["text"] for r in df.collect()) == sorted(TEXTS)


def test_json_folder_of_mixed_forms(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    _write(folder / "a.json", json.dumps([{"text": "p"}, {"text": "q"}], indent=1))
    _write(folder / "b.json", "\n".join(json.dumps({"text": t}) for t in TEXTS))
    _write(folder / "c.json", '[{"text": "x", "tags": ["p", "q"]}\n, {"text": "y", "tags": []}]')
    schema = T.StructType([T.StructField("text", T.StringType())])
    for given in (None, schema):
        rows = files.read_json(spark, str(folder), given).collect()
        assert sorted(r["text"] for r in rows) == sorted([*TEXTS, "p", "q", "x", "y"])


@pytest.mark.parametrize("content", ['{"text": "a"}\n{"text": ', '[{"text": "a"}, {"text": ]', "not json"])
def test_malformed_json_is_an_error(spark, tmp_path, content):
    schema = T.StructType([T.StructField("text", T.StringType())])
    path = _write(tmp_path / "bad.json", content)
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        files.read_json(spark, path, schema).collect()


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'id,text\n1,"two\nlines"\n2,"say ""hi"""\n3,\n')
    rows = {r["id"]: r["text"] for r in files.read_csv(spark, path).collect()}
    assert rows == {1: "two\nlines", 2: 'say "hi"', 3: None}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("hello", "Positive"), ('a "b",\nc', "Neutral")], "text string, final_sentiment string")
    path = str(tmp_path / f"out.{fmt}")
    files.write_frame(df, path, fmt)
    back, _ = files.read_upload(spark, path)
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_format_rules():
    assert files.format_by_extension("X.CSV") == "csv"
    assert files.output_format("csv") == "csv" and files.output_format("csv", " JSON ") == "json"
    for bad in (lambda: files.format_by_extension("a.txt"), lambda: files.output_format("csv", "xml")):
        with pytest.raises(ValueError):
            bad()


def test_text_column_resolution():
    assert resolve_text_column(["message"]) == "message"
    assert resolve_text_column(["review", "text"]) == "text"
    assert resolve_text_column(["a", "b"], "b") == "b"
    for columns, name in ((["a"], None), (["a"], "b")):
        with pytest.raises(ValueError):
            resolve_text_column(columns, name)


def test_review_scan_and_key(spark, tmp_path):
    line = json.dumps({"overall": 5, "reviewText": "x", "reviewerID": "r", "asin": "a", "unixReviewTime": 1, "extra": 0})
    df = with_review_id(scan_reviews(spark, _write(tmp_path / "r.json", line + "\n" + line + "\n")))
    assert df.select("review_id").distinct().count() == 2


def test_class_report_sections(spark, tmp_path):
    path = _write(tmp_path / "report.txt", "VADER\n  precision\n  Negative 0.6\n\nTextBlob\n  accuracy 0.5\n")
    rows = [(r["model"], r["line"].strip()) for r in results.read_class_report(spark, path).collect()]
    assert sorted(rows) == [("TextBlob", "accuracy 0.5"), ("VADER", "Negative 0.6"), ("VADER", "precision")]


def test_metadata_defaults(spark):
    meta = spark.createDataFrame([(5, None)], "dataset_rows int, train_rows int")
    row = meta.select(*[results.field_or_default(meta, n) for n in ("dataset_rows", "train_rows", "gone")]).first()
    assert tuple(row) == ("5", results.MISSING, results.MISSING)
    assert results.read_optional(spark, "/nonexistent/payload") is None


def test_tasks_payload(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(i, 4.0, words) for i in range(12)] + [(99, 2.0, "why? " + words)], "review_id int, overall double, reviewText string")
    path = str(tmp_path / "payload")
    run_tasks(df, G.first_words_generator(), path)
    row = spark.read.json(path).first()
    assert row["summary_task"]["selected_reviews_count"] == 10
    assert len(row["summary_task"]["first_two_for_report"]) == 2
    assert row["service_response_task"]["selected_review"]["overall"] == 2.0
    assert row["service_response_task"]["response"].startswith("why?")
    assert C.SERVICE_TOKENS == 150 and F


def test_lexicon_with_repeated_tokens(spark, tmp_path):
    path = _write(tmp_path / "lexicon.tsv", "good\t1.5\t0.5\nbad\t-1.0\t-0.2\ngood\t1.2\t0.9\n")
    rows = {r["token"]: (r["valence"], r["polarity"]) for r in read_lexicon(spark, path).collect()}
    assert rows == {"good": (1.2, 0.9), "bad": (-1.0, -0.2)}
