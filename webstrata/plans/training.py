"""Step 3: features, models, evaluation and artifacts.

Every model sees all columns: hashed text, URL, structural and content features. Boosted trees (see
``operators/boosting.py``) and logistic regression both take the sparse vector.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    HashingTF,
    Normalizer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata import settings
from webstrata.functions import keys, labels
from webstrata.operators import boosting, metrics, split, vocabulary
from webstrata.plans.stages import CharNgrams, PageFeatures, WordNgrams
from webstrata.sources import sinks

DENSE = [*settings.URL_FEATURES, *settings.STRUCTURAL_FEATURES, *settings.CONTENT_FEATURES]


@dataclass(frozen=True)
class Training:
    """Parameters of a run."""

    buckets: int = settings.HASH_BUCKETS
    ngrams: tuple[int, int] = settings.WORD_NGRAMS
    stop_words: tuple[str, ...] | None = None  # None: Spark's English list
    vocabulary: int = settings.WORD_VOCABULARY  # of the content-only model
    rounds: int = settings.BOOSTING["rounds"]
    step_size: float = settings.BOOSTING["step_size"]
    depth: int = 5  # trees grow level by level, the best cuts of a level first
    leaves: int = settings.BOOSTING["leaves"]
    max_bins: int = settings.BOOSTING["max_bins"]
    row_share: float = settings.BOOSTING["row_share"]
    column_share: float = settings.BOOSTING["column_share"]
    min_leaf_rows: int = settings.BOOSTING["min_leaf_rows"]
    patience: int = settings.BOOSTING["patience"]
    linear_rounds: int = 1000
    linear_tolerance: float = 1e-4  # of the objective, relative
    test_share: float = settings.TEST_SHARE
    validation_share: float = 0.1
    seed: int = settings.SEED

    def words(self) -> list[str]:
        if self.stop_words is None:
            return StopWordsRemover.loadDefaultStopWords("english")
        return list(self.stop_words)


def hashed_text(config: Training) -> list[Transformer]:
    """Text → L2-normalized counts of hashed n-grams in ``text_vec``."""
    low, high = config.ngrams
    return [
        WordNgrams(low=low, high=high, stopWords=config.words()),
        HashingTF(inputCol="terms", outputCol="_hashed", numFeatures=config.buckets),
        Normalizer(inputCol="_hashed", outputCol="text_vec", p=2.0),
    ]


def feature_stages(config: Training) -> list[Transformer]:
    """The wide vector ``features``: text, URL, structural, content, in this order."""
    return [
        PageFeatures(),
        *hashed_text(config),
        VectorAssembler(inputCols=["text_vec", *DENSE], outputCol="features"),
    ]


def feature_rows(enriched: DataFrame, config: Training) -> DataFrame:
    """``url, label, text_vec, dense features, features``; rows without URL or label go."""
    rows = enriched.dropna(subset=["url", "label"])
    built = PipelineModel(stages=feature_stages(config)).transform(rows)
    return built.select("url", "label", *DENSE, "text_vec", "features")


def widths(features: DataFrame) -> dict[str, int]:
    """Columns per feature group, from the schema alone."""
    text_width = features.schema["text_vec"].metadata["ml_attr"]["num_attrs"]
    return {
        "text": text_width,
        "url": len(settings.URL_FEATURES),
        "structural": len(settings.STRUCTURAL_FEATURES),
        "content": len(settings.CONTENT_FEATURES),
    }


def growth(config: Training) -> boosting.Growth:
    names = boosting.Growth.__dataclass_fields__
    return boosting.Growth(**{name: getattr(config, name) for name in names})


def fit_trees(
    rows: DataFrame, config: Training, classes: int, column: str = "features"
) -> boosting.BoostedTrees:
    """Boosted trees over ``column``, stopped early by the rows with ``is_validation``.

    More than two classes share their rounds: one tree for each class, soft-max over their scores.
    """
    return boosting.fit(rows, column, classes, growth(config))


def split_parts(rows: DataFrame, key: str, config: Training) -> tuple[DataFrame, DataFrame]:
    """(train with ``is_validation``, test): exact shares of every label, by the hash of the key."""
    parted = split.stratified_parts(rows, key, "label", config.test_share, config.validation_share)
    train = parted.filter(F.col("part") != "test").withColumn(
        "is_validation", F.col("part") == "validation"
    )
    return train.drop("part"), parted.filter(F.col("part") == "test").drop("part")


def fit_boosted(features: DataFrame, config: Training, classes: int) -> PipelineModel:
    """Fit on all columns of stored feature rows (with ``is_validation``)."""
    vectors = features.select("label", "is_validation", "features")
    return PipelineModel(stages=[fit_trees(vectors, config, classes, "features")])


def fit_linear(
    features: DataFrame, config: Training, column: str = "features", standardize: bool = True
) -> PipelineModel:
    """Logistic regression over the whole sparse vector; C = 1 means regParam = 1 / rows.

    The wide vector mixes counts and unit-length text, so its columns are standardized.
    """
    rows = features.count()
    linear = LogisticRegression(
        featuresCol=column,
        labelCol="label",
        regParam=1.0 / max(rows, 1),
        elasticNetParam=0.0,
        standardization=standardize,
        maxIter=config.linear_rounds,
        tol=config.linear_tolerance,
    )
    # A step adds up one array of all columns a task, so there are no more tasks than rows fill.
    few = features.coalesce(max(1, -(-rows // boosting.BLOCK_ROWS))).persist()
    try:
        return Pipeline(stages=[linear]).fit(few)
    finally:
        few.unpersist()


def whole_model(config: Training, fitted: PipelineModel) -> PipelineModel:
    """Feature stages and fitted stages as one model, from main table rows to predictions."""
    return PipelineModel(stages=[*feature_stages(config), *fitted.stages])


def fit_tfidf(
    rows: DataFrame, ngrams: Transformer, size: int
) -> tuple[PipelineModel, list[str]]:
    """TF-IDF stages (``terms`` → ``tfidf``) and the vocabulary.

    The vocabulary, at most ``size`` terms, is all that reaches the driver. Applying the
    stages needs no shuffle.
    """
    terms = ngrams.transform(rows).select("terms")
    total = rows.agg(F.count(F.lit(1)))
    top = vocabulary.vocabulary(vocabulary.term_stats(terms, "terms"), size).select(
        "term", vocabulary.smooth_idf(total.scalar(), F.col("df")).alias("idf")
    )
    found = sorted((r["term"], r["idf"]) for r in top.collect())
    stages = [ngrams, *vocabulary.tfidf_stages(found, "terms", "tfidf")]
    return PipelineModel(stages=stages), [term for term, _ in found]


def fit_content_only(train: DataFrame, config: Training) -> tuple[PipelineModel, list[str]]:
    """Word TF-IDF (``text_content``) and boosted trees over all its columns."""
    low, high = config.ngrams
    ngrams = WordNgrams(low=low, high=high, stopWords=config.words())
    tfidf, names = fit_tfidf(train, ngrams, config.vocabulary)
    vectors = tfidf.transform(train).select("label", "is_validation", "tfidf")
    trees = fit_trees(vectors, config, 2, "tfidf")
    return PipelineModel(stages=[*tfidf.stages, trees]), names


def fit_url_only(train: DataFrame, config: Training) -> tuple[PipelineModel, list[str]]:
    """Character TF-IDF of ``url`` and logistic regression."""
    tfidf, names = fit_tfidf(train, CharNgrams(), settings.CHAR_VOCABULARY)
    vectors = tfidf.transform(train).select("label", "tfidf").persist()
    fitted = fit_linear(vectors, config, "tfidf", standardize=False)
    vectors.unpersist()
    return PipelineModel(stages=[*tfidf.stages, *fitted.stages]), names


def feature_importance(
    spark: SparkSession, model: PipelineModel, names: list[str], top: int = 25
) -> DataFrame:
    """``feature, importance, gain`` of the ``top`` columns that most cuts of a boosted model use:
    the number of cuts and the sum of their gains, over the table of its nodes."""
    cuts = model.stages[-1].nodes(spark).filter("column >= 0")
    counted = cuts.groupBy("column").agg(
        F.count(F.lit(1)).alias("importance"), F.sum("gain").alias("gain")
    )
    named = spark.createDataFrame(list(enumerate(names)), "column int, feature string")
    return (
        counted.join(named, "column")
        .select("feature", "importance", "gain")
        .orderBy(F.desc("importance"), F.desc("gain"), "feature")
        .limit(top)
    )


def informative_terms(
    spark: SparkSession, model: PipelineModel, names: list[str], top: int = 20
) -> DataFrame:
    """``class, term, coef``: the terms that speak most for either label."""
    values = model.stages[-1].coefficients.toArray()
    pairs = [(n, float(v)) for n, v in zip(names, values)]
    terms = spark.createDataFrame(pairs, "term string, coef double")
    best = terms.orderBy(F.desc("coef"), F.desc("term")).limit(top)
    worst = terms.orderBy("coef", "term").limit(top)
    return best.select(F.lit(1).alias("class"), "*").unionByName(
        worst.select(F.lit(0).alias("class"), "*")
    )


def predictions(scored: DataFrame, *columns: str) -> DataFrame:
    """``columns, probability, prediction, label_name, confidence`` of a scored binary table."""
    p = F.col("probability")
    return (
        scored.select(*columns, vector_to_array("probability")[1].alias("probability"))
        .withColumns({"prediction": labels.decide(p), "confidence": labels.confidence(p)})
        .withColumn("label_name", labels.label_name(F.col("prediction")))
    )


def report(scored: DataFrame, multiclass: bool = False) -> DataFrame:
    """Classification report of scored rows with their true ``label``."""
    pairs = (
        scored.select("label", F.col("prediction").cast("int").alias("prediction"))
        if multiclass
        else predictions(scored, "label")
    )
    return metrics.classification_report(pairs, "label", "prediction")


def manifest(report: DataFrame, config: Training) -> DataFrame:
    """One row: run id, time, parameters and metrics."""
    shown = asdict(config)
    parameters = F.create_map(*[F.lit(str(x)) for item in shown.items() for x in item])
    measured = report.agg(F.collect_list(F.struct("*")).alias("evaluation_metrics"))
    return measured.select(
        keys.run_id(keys.config_key(shown)).alias("run_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp_utc"),
        parameters.alias("params"),
        "evaluation_metrics",
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A stored model; it must hold feature stages and a classifier."""
    model = PipelineModel.load(path)
    kinds = [type(stage) for stage in model.stages]
    if not any(k in (PageFeatures, WordNgrams, CharNgrams) for k in kinds) or not hasattr(
        model.stages[-1], "predictionCol"
    ):
        raise ValueError(f"{path} holds no model with feature stages and a classifier; train again")
    return model


def run(
    spark: SparkSession,
    source: str,
    features: str,
    out: str,
    config: Training = Training(),
    rebuild: bool = False,
) -> DataFrame:
    """Train the main model on the main table at ``source``; returns its report.

    Writes the feature table below ``features``, and below ``out`` the model, the label
    distribution, the report, the confusion matrix and the manifest.
    """
    shape = {"buckets": config.buckets, "ngrams": config.ngrams, "stop_words": config.words()}
    rows, _ = sinks.feature_table(
        source, features, shape, lambda table: feature_rows(table, config), spark, rebuild
    )
    classes = split.require_classes(rows)
    sinks.write_report(metrics.label_distribution(rows, "label"), f"{out}/labels")
    train, test = split_parts(rows, "url", config)
    fitted = fit_boosted(train, config, classes)
    save(whole_model(config, fitted), f"{out}/model")
    # The hold-out is scored once; counts of (label, prediction) are all that the reports need.
    scored = fitted.transform(test).select("label", F.col("prediction").cast("int"))
    pairs = f"{out}/predictions"
    metrics.counted_pairs(scored, "label", "prediction").write.mode("overwrite").parquet(pairs)
    counts = spark.read.parquet(pairs)
    matrix = metrics.confusion_matrix(counts, "label", "prediction", weight="n")
    sinks.write_report(matrix, f"{out}/confusion")
    found = metrics.classification_report(counts, "label", "prediction", weight="n")
    sinks.write_report(found, f"{out}/report")
    sinks.write_report(manifest(spark.read.json(f"{out}/report"), config), f"{out}/manifest")
    return spark.read.json(f"{out}/report")
