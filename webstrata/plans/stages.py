"""ML stages over DataFrame expressions, so that a saved model holds the whole feature build."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import markup, text, urls


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage without parameters."""


class PageFeatures(_Stage):
    """``url, structured_text, html_content`` → ``text_content`` and the 15 dense features."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        staged = dataset.withColumn("text_content", text.block_text(F.col("structured_text")))
        staged = staged.withColumns(text.content_features(F.col("text_content")))
        staged = urls.with_url_features(staged, "url")
        return markup.with_structural_features(
            staged.fillna("", subset=["html_content"]), "html_content"
        )


class WordNgrams(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Text column → array of word n-grams without stop words."""

    inputCol = Param(Params._dummy(), "inputCol", "text column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "term column", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "dropped words", TypeConverters.toListString)

    def __init__(
        self,
        inputCol: str = "text_content",
        outputCol: str = "terms",
        low: int = settings.WORD_NGRAMS[0],
        high: int = settings.WORD_NGRAMS[1],
        stopWords: Iterable[str] = (),
    ):
        super().__init__()
        self._set(
            inputCol=inputCol, outputCol=outputCol, low=low, high=high, stopWords=list(stopWords)
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        words = text.tokens(F.col(get("inputCol")), get("stopWords"))
        return (
            dataset.withColumn("_words", words)
            .withColumn(get("outputCol"), text.word_ngrams("_words", get("low"), get("high")))
            .drop("_words")
        )


class CharNgrams(_Stage):
    """``url`` → array of its character n-grams, in ``terms``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return text.with_char_ngrams(dataset, "url", "terms", *settings.CHAR_NGRAMS)

