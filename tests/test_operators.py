import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import text as T
from opinara.functions.constants import CLASSES
from opinara.operators import bayes, dictionary, enhance, evaluate, features, generate, lemma, lexicon, profile, quantiles, sampling, terms
from opinara.session import lookup_join
from opinara.sources.lexicon import built_in_lexicon

# stars, compound, polarity, words -> score, text rating, confidence, text w, rating w, enhanced, alpha
BLENDS = [
    (5.0, 0.8, 0.5, 50, 0.68, 4.36, 0.695, 0.2085, 0.7915, 4.8666, 4.84),
    (1.0, 0.8, 0.5, 50, 0.68, 4.36, 0.695, 0.2085, 0.7915, 1.7006, 2.44),
    (3.0, 0.0, 0.0, 0, 0.0, 3.0, 0.3, 0.09, 0.91, 3.0, 3.0),
    (1.0, 1.0, 1.0, 100, 1.0, 5.0, 1.0, 0.3, 0.7, 2.2, 2.6),
    (5.0, -1.0, 1.0, 250, -0.2, 2.6, 0.3, 0.09, 0.91, 4.784, 3.4),
]


def test_blends(spark):
    df = spark.createDataFrame(
        [(i, *b[:4]) for i, b in enumerate(BLENDS)],
        "review_id int, overall double, compound double, polarity double, n_words int",
    )
    for row in enhance.enhance_confidence(df).collect():
        want = BLENDS[row["review_id"]]
        got = [row[c] for c in enhance.ENHANCED_COLUMNS[2:]]
        assert got == pytest.approx(list(want[4:10]), abs=1e-9)
        assert 1 <= row["enhanced_rating"] <= 5
        assert row["rating_diff"] <= 4 * row["effective_text_weight"] + 1e-3
    for row in enhance.enhance_alpha(df).collect():
        assert row["enhanced_rating"] == pytest.approx(BLENDS[row["review_id"]][10])


def test_published_split_sizes(spark):
    strata = {1.0: 2450, 2.0: 546, 3.0: 2996, 4.0: 186, 5.0: 2810}
    counts = spark.createDataFrame(list(strata.items()), "stratum double, n bigint")
    quotas = {r["stratum"]: r["quota"] for r in sampling.train_quotas(counts, 0.30).collect()}
    assert quotas == {1.0: 1715, 2.0: 382, 3.0: 2097, 4.0: 130, 5.0: 1967}


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds two thirds of the rows; one stratum is null."""
    rnd = random.Random(1)
    rows = [(i, rnd.choice([5.0] * 8 + [3.0, 3.0, 1.0, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "review_id bigint, overall double")
    return df.withColumn("sentiment", F.when(F.col("overall") == 5, "Positive").when(F.col("overall") == 3, "Neutral").otherwise("Negative")).cache()


def _order(i):
    import hashlib

    return hashlib.md5(f"{i}|42".encode()).hexdigest(), str(i)


def test_sampling_equals_full_sort(skewed):
    rows = [(r["review_id"], r["sentiment"]) for r in skewed.collect()]
    got = {r["review_id"] for r in sampling.sample_simple(skewed, 100).collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: _order(r[0]))[:100]}
    balanced = sampling.sample_balanced(skewed, 50).collect()
    for label in ("Positive", "Neutral", "Negative"):
        best = sorted((i for i, s in rows if s == label), key=_order)[:50]
        assert {r["review_id"] for r in balanced if r["sentiment"] == label} == set(best)
    assert sampling.sample_simple(skewed, 10_000).count() == 3000


def test_balanced_sizes(skewed):
    smallest = profile.smallest_class(skewed).first()[0]
    sizes = sampling.sample_balanced(skewed).groupBy("sentiment").count().collect()
    assert [r["count"] for r in sizes] == [smallest] * 3
    with pytest.raises(ValueError):
        sampling.sample_balanced(skewed, smallest + 1, strict=True)
    taken = sampling.sample_balanced(skewed, smallest + 1).count()
    assert taken == 3 * smallest + 2


def test_split_is_complete_and_disjoint(skewed):
    rows = sampling.split_stratified(skewed).collect()
    assert len({r["review_id"] for r in rows}) == len(rows) == 3000
    assert sum(r["split"] == "test" for r in rows) == 900
    nulls = [r for r in rows if r["overall"] is None]
    assert abs(sum(r["split"] == "test" for r in nulls) - 0.3 * len(nulls)) <= 1
    assert sampling.sample_stratified(skewed, 200).count() == 200


def test_ranks_and_folds(skewed):
    ranks = sampling.rank_in_group(skewed, ["sentiment"]).collect()
    for label in ("Positive", "Neutral", "Negative"):
        mine = sorted((r for r in ranks if r["sentiment"] == label), key=lambda r: r["rn"])
        assert [r["rn"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["review_id"] for r in mine] == sorted((r["review_id"] for r in mine), key=_order)
    folds = sampling.assign_folds(skewed).groupBy("sentiment", "fold").count().collect()
    per_class = {}
    for r in folds:
        per_class.setdefault(r["sentiment"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per_class.values())


def test_quantiles_equal_built_in(spark):
    rnd = random.Random(2)
    values = [(g, float(v)) for g in ("a", "b") for v in [7] * 400 + [rnd.randint(0, 10**6) for _ in range(777)]]
    df = spark.createDataFrame(values, "g string, value double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = quantiles.exact_quantiles(quantiles.value_counts_by(df, ["g"], "value"), ["g"], probs).collect()
    want = df.groupBy("g").agg(F.percentile("value", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    expected = {(r["g"], p): q for r in want for p, q in zip(probs, r["q"])}
    assert {(r["g"], r["prob"]): pytest.approx(r["q"]) for r in got} == expected


def test_describe_small(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    row = quantiles.describe(df, ["x"]).first()
    assert (row["count"], row["q25"], row["q50"], row["q75"], row["max"]) == (3, 1.5, 2.0, 3.0, 4.0)


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,)], "x double")
    assert [r["n"] for r in profile.histogram(df, "x", 5).collect()] == [2, 0, 0, 0, 2]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = profile.histogram(same, "x", 2).collect()
    assert (rows[0]["left_edge"], rows[1]["right_edge"]) == (2.5, 3.5)
    fixed = profile.histogram(df, "x", 2, (0.0, 2.0)).collect()
    assert [r["n"] for r in fixed] == [1, 1]


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("a", 1)], "t string, n int")
    row = profile.duplicate_counts(df, ["t", "n"]).first()
    assert (row["duplicates"], row["rows_involved"]) == (1, 2)


def test_lookup_join_of_any_table(spark):
    rows = spark.createDataFrame([(i, "the" if i % 3 else f"t{i}") for i in range(300)], "review_id int, token string")
    table = spark.createDataFrame([("the", 1.0), ("t3", 2.0)], "token string, valence double")
    small = lookup_join(rows, table, "token", bounded=True)
    free = lookup_join(rows, table, "token")
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, free.select(small.columns).collect()), key=str)


def test_rules(spark):
    texts = [
        (0, "good"), (1, "very good"), (2, "not good"), (3, "the food is GOOD"),
        (4, "good!!!"), (5, "bad but good"), (6, "nothing here"), (7, None), (8, "hardly good"),
    ]
    df = spark.createDataFrame(texts, "review_id int, t string")
    got = {r["review_id"]: r["compound"] for r in lexicon.rule_scores(df, built_in_lexicon(spark), "t").collect()}
    norm = lambda s: s / (s * s + 15) ** 0.5
    want = {
        0: 1.9, 1: 1.9 + 0.293, 2: 1.9 * -0.74, 3: 1.9 + 0.733, 4: 1.9 + 3 * 0.292,
        5: -2.5 * 0.5 + 1.9 * 1.5, 6: 0.0, 7: 0.0, 8: 1.9 - 0.293,
    }
    assert {k: pytest.approx(norm(v)) for k, v in want.items()} == got


def test_metric_identities(spark):
    rows = [(i, t, p) for i, (t, p) in enumerate([("Positive", "Positive"), ("Negative", "Positive"), ("Neutral", "Neutral"), ("Positive", "Neutral")])]
    df = spark.createDataFrame(rows, "review_id int, sentiment string, m string")
    long = evaluate.long_predictions(df, "sentiment", {"M": "m"})
    cells = evaluate.confusion_matrix(evaluate.confusion_cells(long)).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == 4
    row = evaluate.compare_models(long).first()
    assert row["accuracy"] == pytest.approx(row["recall"]) == 0.5
    report = {r["row"]: r for r in evaluate.classification_report(long).collect()}
    assert report["Negative"]["precision"] == 0.0 and report["weighted avg"]["support"] == 4


def test_weights_have_unit_length(spark):
    df = spark.createDataFrame([(1, "good card good"), (2, "bad card"), (3, "good bad card"), (4, ""), (5, None)], "review_id int, cleaned_text string")
    vocabulary = features.fit_vocabulary(features.vocab_stats(df), df, features.TfidfConfig(min_df=1, max_df=1.0))
    norms = features.tfidf_weights(df, vocabulary).groupBy("review_id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert {r["review_id"]: r["s"] for r in norms.collect()} == {i: pytest.approx(1.0) for i in (1, 2, 3)}


def _odd_texts(spark):
    rng = random.Random(4)
    words = ["good", "card", "bad", "a", "very", "not", "zz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))).replace("not", rng.choice(["not", "not!", "!"]))) for i in range(200)]
    return spark.createDataFrame([*rows, (200, ""), (201, None), (202, "!!"), (203, "a a a"), (204, "good! good")], "review_id int, cleaned_text string").repartition(3)


def test_term_arrays_equal_the_relational_forms(spark, monkeypatch):
    df = _odd_texts(spark)
    filled = df.fillna("", ["cleaned_text"])
    relational = features.document_terms(filled).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    want = sorted(map(tuple, relational.collect()))
    assert sorted(map(tuple, features.vocab_stats(df).collect())) == want
    monkeypatch.setattr(terms, "_HELD", 20)  # counts shipped in many parts
    assert sorted(map(tuple, features.vocab_stats(df.coalesce(1)).collect())) == want
    vocabulary = features.fit_vocabulary(features.vocab_stats(df), df, features.TfidfConfig(max_features=25, min_df=2, max_df=0.6))
    got = {}
    for limit in (terms.SHIPPED, 0):
        monkeypatch.setattr(terms, "SHIPPED", limit)
        rows, size = features.sparse_features(filled.withColumn("n", F.length("cleaned_text")), filled.withColumn("n", F.length("cleaned_text")), vocabulary, columns=["n"])
        got[limit] = (
            {(r["review_id"], r["term"]): r["weight"] for r in features.tfidf_weights(filled, vocabulary).collect()},
            {r["review_id"]: (r["n_known"], r["idf_mass"]) for r in features.known_terms(filled, vocabulary).collect()},
            {r["term"]: r["mean_weight"] for r in features.mean_weights(filled, vocabulary).collect()},
            {(r["review_id"], t): w for r in rows.collect() for t, w in zip(r["features"]["terms"], r["features"]["weights"], strict=True)},
            features.matrix_shape(filled, vocabulary).first()["nnz"],
            size,
        )
    first, second = got.values()
    for a, b in zip(first, second, strict=True):
        assert a == (pytest.approx(b) if not isinstance(a, dict) else {k: pytest.approx(v) for k, v in b.items()})
    assert len(first[0]) == first[4] > 0


def test_weights_stay_in_their_row(spark):
    df = _odd_texts(spark)
    vocabulary = features.fit_vocabulary(features.vocab_stats(df), df)
    plan = features.tfidf_weights(df, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def _classified(spark, n=150):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        label = rng.choice(["Positive", "Negative", "Negative", "Neutral"])
        known = sorted(rng.sample(range(12), rng.randint(0, 6)))
        rows.append((i, label, i % 3, (known, [rng.random() * (3 if (t + len(label)) % 4 == 0 else 1) for t in known])))
    return rows, spark.createDataFrame(rows, "review_id int, sentiment string, fold int, features struct<terms: array<int>, weights: array<double>>").repartition(4)


def _plain_bayes(train, alpha, size=12):
    theta = {}
    for c in CLASSES:
        mass = [sum(w for _, s, _, (ts, ws) in train if s == c for t, w in zip(ts, ws, strict=True) if t == k) for k in range(size)]
        theta[c] = [math.log((m + alpha) / (sum(mass) + alpha * size)) for m in mass]
    prior = {c: math.log(sum(r[1] == c for r in train) / len(train)) for c in CLASSES}
    return lambda f: max(CLASSES, key=lambda c: prior[c] + sum(w * theta[c][t] for t, w in zip(*f, strict=True)))


def test_bayes_and_its_grid_equal_plain_python(spark):
    rows, df = _classified(spark)
    model = bayes.fit_bayes(df, 12, 0.5)
    label = _plain_bayes(rows, 0.5)
    assert {r["review_id"]: r["nb_sentiment"] for r in bayes.score_bayes(df, model).collect()} == {r[0]: label(r[3]) for r in rows}
    for r in bayes.search_grid(df, 12, (0.01, 0.5, 5.0), 3).collect():
        f1 = []
        for fold in range(3):
            label = _plain_bayes([x for x in rows if x[2] != fold], (0.01, 0.5, 5.0)[r["candidate"]])
            pairs = [(x[1], label(x[3])) for x in rows if x[2] == fold]
            score = 0.0
            for c in CLASSES:
                hit, truth, pred = (sum(k) for k in zip(*[(t == p == c, t == c, p == c) for t, p in pairs], strict=True))
                score += truth / len(pairs) * (2 * hit / (truth + pred) if truth + pred else 0.0)
            f1.append(score)
        assert r["mean_f1"] == pytest.approx(sum(f1) / 3) and r["std_f1"] == pytest.approx(statistics.pstdev(f1))


@pytest.mark.parametrize("limit", [lemma.SHIPPED, 0])
def test_lemmas_with_null_and_repeated_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(lemma, "SHIPPED", limit)
    rows = [(1, ["cards", "card", "berries", "bus"]), (1, ["berry", "cards"]), (None, ["cards"]), (None, []), (3, ["box", "boxes", "glasses"]), (4, None)]
    df = spark.createDataFrame(rows, "review_id int, ws array<string>").repartition(2)
    table = lemma.fit_lemmas(df, "ws")
    assert {r["token"]: r["lemma"] for r in table.collect()} == {"cards": "card", "berries": "berry", "boxes": "box"}
    out = lemma.lemmatize(df, "ws", table).collect()
    want = [(1, ["card", "card", "berry", "bus"]), (1, ["berry", "card"]), (None, ["card"]), (None, []), (3, ["box", "box", "glasses"]), (4, None)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    texts = df.where("ws is not null").withColumn("ws", F.array_join("ws", " "))
    assert {r["token"] for r in lemma.fit_lemmas(texts, "ws").collect()} == {"cards", "berries", "boxes"}
    assert sorted(r["ws"] for r in lemma.lemma_text(texts, "ws", table).collect()) == sorted(" ".join(ws) for _, ws in want if ws is not None)


def test_dictionary_cleaning_equals_the_column_functions(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "_TOKENS", 30)
    rng = random.Random(6)
    parts = ["not", "NO", "never", "didn't", "CAN'T", "Good", "cards", "THE", "a", "!", "so!!", "12", "é", "Über", "ǅ", "Ω", "ab-cd", "NOT_x", "_", "İ", "\u212a"]
    blanks = [" ", "  ", "\t", "\n", "\u00a0", "\x1c", "\u3000"]
    texts = ["".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", " \n", "x " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    marked = T.prepare_training(F.col("t"))
    plain = df.select("i", T.clean_text(marked, collapsed=True).alias("cleaned"), T.exclamation_count(marked).alias("e"), T.uppercase_count(marked).alias("u"))
    got = df.select("i", dictionary.clean(F.col("t")).alias("c")).select("i", "c.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    serving = dictionary.Cleaner(("not", "no"), "letters", C.SERVING_NEGATORS, 2, expand=False)
    plain = df.select("i", T.clean_text(T.prepare_serving(F.col("t")), ("not", "no"), "letters", collapsed=True))
    assert sorted(map(tuple, df.select("i", dictionary.clean(F.col("t"), serving)["cleaned"]).collect())) == sorted(map(tuple, plain.collect()))


def test_generation(spark):
    words = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(i, 4.0, words) for i in range(12)] + [(99, 2.0, "why? " + words)], "review_id int, overall double, reviewText string")
    picked = generate.summary_reviews(df, 10, require=True)
    assert sorted(r["review_index"] for r in picked.collect()) == list(range(10))
    out = generate.generate_text(generate.with_summary_prompt(picked), generate.first_words_generator(), 80, "summary", 2)
    checked = generate.summary_length_check(out).collect()
    assert all(r["summary_words"] == 50 and not r["too_long"] for r in checked)
    with pytest.raises(ValueError):
        generate.summary_reviews(df, 100, require=True)
    with pytest.raises(ValueError):
        generate.first_row(generate.question_reviews(df.where("review_id < 5")), require=True)
    assert generate.last_message([{"generated_text": "  plain "}]) == "plain"


def test_many_strata_and_groups(spark):
    df = spark.range(6000).select("id", (F.col("id") % 1500).alias("g"), (F.col("id") * 1.0).alias("v")).withColumnRenamed("id", "review_id")
    split = sampling.split_stratified(df, 0.25, "g")
    assert {r["n"] for r in split.where("split = 'train'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {3}
    assert profile.box_statistics(df, "g", "v").count() == 1500


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, None, 4.0), (4, "a", None)], "review_id int, g string, v double")
    ranks = sampling.rank_in_group(df, ["g"]).collect()
    assert sorted((r["g"] or "", r["rn"]) for r in ranks) == [("", 1), ("", 2), ("a", 1), ("a", 2)]
    assert sampling.assign_folds(df, 2, "g").count() == 4
    rows = {r["g"]: r for r in quantiles.describe_by(df, ["g"], "v").collect()}
    assert rows[None]["mean"] == 3.0 and rows["a"]["count"] == 1 and rows["a"]["std"] is None
    empty = quantiles.describe(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"])
    assert {r["column"]: r["count"] for r in empty.collect()} == {"v": 3, "w": 0}
