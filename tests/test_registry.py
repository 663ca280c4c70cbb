import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from compare import compare, connect

# One query per module at the smallest scale; tools/compare.py runs all of them.
SAMPLE = [
    "clean_text", "mark_negation", "box_by_rating", "duplicate_keys", "split_stratified", "fold_assignment",
    "lexicon_compound_rules", "enhance_confidence", "tfidf_weights", "classification_report", "summary_prompts",
    "write_frame_csv", "lemmatize",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, sf_dir, name):
    verdict = compare(name, entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
    assert "types" not in verdict, verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 3
