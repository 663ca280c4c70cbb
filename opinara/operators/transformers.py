"""`pyspark.ml` stages for review text, saved and loaded inside a `PipelineModel`."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import text as T
from opinara.operators.features import with_numeric_features
from opinara.operators.lemma import lemma_map, may_change, vocabulary

MARKED, CLEANED, TERMS = "_marked", "_cleaned", "_terms"


class ReviewText(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Raw text to negation-marked text, cleaned text, terms and the three counts.

    ``profile`` is "training" (the default, used on both sides so that training and
    serving agree) or "serving" for the narrower negation window without contractions.
    """

    profile = Param(Params._dummy(), "profile", "training or serving", TypeConverters.toString)

    lemmas = Param(Params._dummy(), "lemmas", "token to lemma, of the training rows", TypeConverters.identity)

    @keyword_only
    def __init__(self, inputCol: str = "reviewText", profile: str = "training", lemmas: dict[str, str] | None = None):
        super().__init__()
        self._setDefault(inputCol="reviewText", profile="training", lemmas={})
        self._set(**self._input_kwargs)

    def lemma_table(self, train: DataFrame) -> dict[str, str]:
        """Lemmas of the training rows' tokens, as large as their vocabulary allows."""
        tokens = self._cleaned(train).select(F.split(CLEANED, " ").alias("ws"))
        return dict(map(tuple, lemma_map(vocabulary(tokens, "ws")).collect()))

    def _cleaned(self, dataset: DataFrame) -> DataFrame:
        text = F.col(self.getInputCol())
        serving = self.getOrDefault(self.profile) == "serving"
        marked = T.prepare_serving(text) if serving else T.prepare_training(text)
        keep = ("not", "no") if serving else C.NEGATORS
        cleaned = T.clean_text(F.col(MARKED), keep_words=keep, collapsed=True)
        return dataset.withColumn(MARKED, marked).withColumn(CLEANED, cleaned)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prepared = self._cleaned(dataset)
        lemmas = self.getOrDefault(self.lemmas)
        if lemmas:
            prepared = prepared.withColumn(CLEANED, _lemmatized(F.col(CLEANED), lemmas))
        counted = with_numeric_features(prepared, MARKED, CLEANED)
        # One generated row per input row: the text steps stay in their own operator and
        # the vector stages below read a plain column.
        return counted.select("*", F.inline(F.array(F.struct(T.terms(F.col(CLEANED)).alias(TERMS)))))


def _lemmatized(text: Column, lemmas: dict[str, str]) -> Column:
    """Cleaned text with each token replaced by its lemma.

    The table is one constant of the plan, a map of small maps by a token's first letters.
    """
    table: dict[str, dict[str, str]] = {}
    for token, lemma in lemmas.items():
        table.setdefault(token[:2], {})[token] = lemma
    constant = F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")

    def one(w: Column) -> Column:
        found = F.try_element_at(F.try_element_at(constant, F.substring(w, 1, 2)), w)
        return F.when(may_change(w), F.coalesce(found, w)).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


@F.pandas_udf(VectorUDT())
def _damp(counts: pd.DataFrame) -> pd.DataFrame:
    """1 + ln(count) on the stored entries of a batch of sparse vectors."""
    values = counts["values"]
    lengths = [len(v) for v in values]
    flat = 1.0 + np.log(np.concatenate(values.to_list())) if sum(lengths) else np.empty(0)
    pieces = np.split(flat, np.cumsum(lengths)[:-1]) if lengths else []
    return counts.assign(values=pd.Series(pieces, index=counts.index, dtype=object))


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Logarithmic term frequency, in Arrow batches."""

    @keyword_only
    def __init__(self, inputCol: str = "_counts", outputCol: str = "_damped"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), _damp(F.col(self.getInputCol())))


class DropColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Remove intermediate columns at the end of a model."""

    names = Param(Params._dummy(), "names", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, names: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getOrDefault(self.names))
