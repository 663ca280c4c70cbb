import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T

# raw, marked, cleaned, clean_chars, exclamations, uppercase, words
ROWS = [
    ("I didn't like this card at ALL!!", "I did not NOT_like NOT_this NOT_card at ALL!!", "not notlike notthis notcard all!!", 33, 2, 2, 8),
    ("can't WON'T won't", "ca not NOT_WON'T NOT_wo not", "ca not notwont notwo not", 24, 0, 1, 5),
    ("not, good", "not, good", "not good", 8, 0, 0, 2),
    ("no not a b c d", "no not NOT_a NOT_b NOT_c d", "no not nota notb notc d", 23, 0, 0, 6),
    ("NOT 123 GREAT stuff", "NOT NOT_123 NOT_GREAT NOT_stuff", "not not notgreat notstuff", 25, 0, 3, 4),
    ("gift-card is 5 stars!", "gift-card is 5 stars!", "giftcard stars!", 15, 1, 0, 4),
    ("", "", "", 0, 0, 0, 0),
    ("   ", "", "", 0, 0, 0, 0),
    ("never\tever again my friend", "never NOT_ever NOT_again NOT_my friend", "never notever notagain notmy friend", 35, 0, 0, 5),
    ("Good GOOD good", "Good GOOD good", "good good good", 14, 0, 1, 3),
    ("The! the a b", "The! the a b", "the! b", 6, 1, 0, 4),
    ("It's café não BAD", "It's café não BAD", "caf no bad", 10, 0, 1, 4),
    (None, "", "", 0, 0, 0, 0),
]


def test_edge_rows(spark):
    stops = StopWordsRemover.loadDefaultStopWords("english")
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "i int, t string")
    out = (
        df.withColumn("marked", T.prepare_training(F.col("t")))
        .withColumn("cleaned", T.clean_text(F.col("marked"), stop_words=stops, collapsed=True))
        .select(
            "i",
            "marked",
            "cleaned",
            T.char_length(F.col("cleaned")),
            T.exclamation_count(F.col("marked")),
            T.uppercase_count(F.col("marked"), collapsed=True),
            T.word_count(F.col("marked"), collapsed=True),
        )
    )
    for row in out.collect():
        assert tuple(row)[1:] == ROWS[row["i"]][1:], row["i"]


def test_default_stop_list_also_drops_single_letters(spark):
    df = spark.createDataFrame([("no not a b c d",)], "t string")
    marked = T.prepare_training(F.col("t"))
    assert df.select(T.clean_text(marked)).first()[0] == "no not nota notb notc"
    assert len(C.STOP_WORDS) == 179


def sequential_marks(text, negators, window):
    out, left = [], 0
    for word in text.split():
        if word.lower() in negators:
            left = window
            out.append(word)
        elif left:
            out.append("NOT_" + word)
            left -= 1
        else:
            out.append(word)
    return " ".join(out)


WORDS = st.lists(
    st.sampled_from(["not", "No", "never", "good", "bad", "x", "n't", "not,", " ", "\t", " ", "\n", "　", "nor", "ok!"]),
    max_size=20,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(WORDS.map(" ".join), min_size=30, max_size=60))
@pytest.mark.parametrize("negators,window", [(C.NEGATORS, 3), (C.SERVING_NEGATORS, 2)])
def test_marks_equal_a_sequential_pass(spark, texts, negators, window):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.mark_negation(F.col("t"), negators, window).alias("m")).collect()
    for row in got:
        assert row["m"] == sequential_marks(row["t"], negators, window)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(max_size=40), min_size=40, max_size=80))
def test_tokens_and_capitals_equal_python(spark, texts):
    kept = [t for t in texts if "\x00" not in t and t.isascii()]
    df = spark.createDataFrame([(t,) for t in kept] or [("A",)], "t string")
    rows = df.select("t", T.tokens(F.col("t")).alias("w"), T.uppercase_count(F.col("t")).alias("u")).collect()
    for row in rows:
        assert list(row["w"]) == row["t"].split()
        assert row["u"] == sum(w.isupper() for w in row["t"].split())


def test_terms_and_counts(spark):
    df = spark.createDataFrame([("good card!good a card",), ("",), ("one",)], "t string")
    rows = df.select(T.terms(F.col("t")).alias("x"), T.term_counts(T.terms(F.col("t"))).alias("c")).collect()
    assert rows[0]["x"] == ["good", "card", "good", "card", "good card", "card good", "good card"]
    assert {(c["term"], c["tf"]) for c in rows[0]["c"]} == {
        ("good", 2), ("card", 2), ("good card", 2), ("card good", 1),
    }
    assert rows[1]["x"] == [] and rows[1]["c"] == []
    assert rows[2]["x"] == ["one"]


def test_rating_labels(spark):
    df = spark.createDataFrame([(5.0,), (4.0,), (3.0,), (2.0,), (1.0,), (None,), (float("nan"),)], "r double")
    labels = [r[0] for r in df.select(S.label_sentiment(F.col("r"))).collect()]
    assert labels == ["Positive", "Positive", "Neutral"] + ["Negative"] * 4


def test_strip_or_null(spark):
    df = spark.createDataFrame([("  a b ",), (" \t",), (None,)], "t string")
    assert [r[0] for r in df.select(T.strip_or_null(F.col("t"))).collect()] == ["a b", None, None]


def test_long_symbol_runs_cost_linear_time(spark):
    import time

    from opinara.operators.lexicon import lookup_text

    run = "=" * 200_000
    df = spark.createDataFrame([(f"a{run}b {run} --good-- {' ' * 50_000}x",)], "t string")
    start = time.time()
    row = df.select(lookup_text(T.collapse_blanks(F.col("t"))), T.strip_or_null(F.col("t"))).first()
    assert row[0] == f"a{run}b  good x"
    assert time.time() - start < 20
