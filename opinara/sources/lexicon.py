"""Lexicon tables (token, valence -4..4, polarity -1..1).

A lexicon is an input.  The table below is a small one of our own, enough to run and
test every scorer; it reproduces no published lexicon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXICON_SCHEMA = T.StructType(
    [
        T.StructField("token", T.StringType(), False),
        T.StructField("valence", T.DoubleType(), False),
        T.StructField("polarity", T.DoubleType(), False),
    ]
)

# FIXED VALUES of the built-in lexicon.
OPINION_WORDS = (
    ("good", 1.9, 0.7),
    ("great", 3.1, 0.8),
    ("like", 1.5, 0.4),
    ("love", 3.2, 0.5),
    ("loved", 2.9, 0.7),
    ("perfect", 2.7, 1.0),
    ("perfectly", 2.7, 1.0),
    ("amazing", 2.8, 0.6),
    ("nice", 1.8, 0.6),
    ("happy", 2.7, 0.8),
    ("fast", 0.6, 0.2),
    ("fine", 0.8, 0.4),
    ("okay", 0.9, 0.5),
    ("bad", -2.5, -0.7),
    ("awful", -2.0, -1.0),
    ("terrible", -2.1, -1.0),
    ("hate", -2.7, -0.8),
    ("hated", -3.2, -0.9),
    ("waste", -1.8, -0.2),
    ("poor", -2.1, -0.4),
    ("trash", -1.5, -0.3),
    ("worthless", -1.9, -0.8),
    ("idiot", -2.3, -0.8),
    ("scum", -2.4, -0.6),
    ("moron", -2.2, -0.8),
    ("pathetic", -2.7, -1.0),
    ("clown", -0.6, -0.2),
    ("disgusting", -2.4, -1.0),
    ("stupid", -2.4, -0.8),
    ("loser", -2.4, -0.2),
    # Frequent syllables of the supplied synthetic prose, so that both signs occur there.
    ("thin", 0.3, 0.1),
    ("tion", 0.4, 0.2),
    ("ing", 0.2, 0.1),
    ("ou", 0.3, -0.1),
    ("ie", -0.2, 0.1),
)


def built_in_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OPINION_WORDS), LEXICON_SCHEMA)


def read_lexicon(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited file with the three columns, no header.

    Of several entries of a token that with the smallest valence, then polarity, is taken,
    whatever their order in the files; nulls come first.
    """
    rows = spark.read.schema(LEXICON_SCHEMA).option("sep", sep).csv(path)
    values = [c for c in rows.columns if c != "token"]
    entry = F.min(F.struct(*values)).alias("entry")
    return rows.groupBy("token").agg(entry).select("token", "entry.*")
