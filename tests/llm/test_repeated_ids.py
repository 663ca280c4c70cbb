"""Repeated strings where very many rows share one id."""

import random

from pyspark.sql import functions as F

from opinara.llm import suffixes
from opinara.llm.common import numbered

from . import brute


def test_lists_are_bounded_by_a_single_text(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    texts = [rng.choice(base)[rng.randint(0, 200) :] + rng.choice(base) for _ in range(150)] + base * 3 + [None, "", "short"] * 4
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    rows = numbered(df)
    # Each mark stands at one row of its own text, whatever the number of texts of the id.
    marks = suffixes.marked(rows.where("_n = 1"))
    joined = rows.where("_n = 1").join(marks, ["_key", "_copy"])
    spread = joined.select(F.sum(F.size("marks"))).first()[0]
    assert spread == marks.select(F.sum(F.size("marks"))).first()[0]
    assert joined.where(F.size("marks") > F.length("text")).count() == 0
    got = suffixes.dedup(df).select("_copy", "n_bytes", "n_removed", "kept").collect()
    order = sorted(((r.c, r.t) for r in df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("c"), F.coalesce("text", F.lit("")).alias("t")).collect()))
    want = brute.repeated_bytes(list(enumerate(t for _, t in order)), 100)
    assert sorted((r["_copy"], r.n_bytes, r.n_removed, r.kept) for r in got) == sorted((c, want[k][0], want[k][1], want[k][3].decode()) for k, (c, _) in enumerate(order))
