"""ML pipeline stages for cleaning, TF-IDF and Gaussian naive Bayes; all can be saved with a model."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasInputCol,
    HasLabelCol,
    HasMaxIter,
    HasOutputCol,
    HasPredictionCol,
    HasRegParam,
    HasSeed,
    HasTol,
    HasWeightCol,
)
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import constants as C
from postloom.functions import text as X
from postloom.operators.bayes import BayesFit, fit_bayes, predict_bayes
from postloom.operators.forest import ForestFit, fit_forest, predict_forest
from postloom.operators.lemmas import apply_lemmas, lemma_table, vocabulary
from postloom.operators.machine import MachineFit, fit_machine, predict_machine
from postloom.operators.vectors import numbered
from postloom.session import written

MAX_VOCABULARY = 2**31 - 1  # what Spark can index


class TextCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """All cleaning stages before lemmas, as one column expression."""

    minLength = Param(Params._dummy(), "minLength", "shortest word that is kept", TypeConverters.toInt)
    stopwords = Param(Params._dummy(), "stopwords", "words to remove", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="text_clean", minLength=3, stopwords=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="text_clean", minLength=3, stopwords=C.ENGLISH_STOPWORDS)
        given = {key: value for key, value in self._input_kwargs.items() if value is not None}
        self._set(**given)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        tokens = X.clean_tokens(
            F.coalesce(F.col(self.getInputCol()), F.lit("")),
            self.getOrDefault(self.stopwords),
            self.getOrDefault(self.minLength),
        )
        return dataset.withColumn(self.getOutputCol(), X.join_tokens(tokens))


class TextStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One cleaning stage by name, from text to text, to be chained as needed."""

    NAMES = ("urls", "punctuation", "non_ascii", "stopwords", "short_words")

    stage = Param(Params._dummy(), "stage", "what the stage removes", TypeConverters.toString)
    minLength = Param(Params._dummy(), "minLength", "shortest word that is kept", TypeConverters.toInt)
    stopwords = Param(Params._dummy(), "stopwords", "words to remove", TypeConverters.toListString)

    @keyword_only
    def __init__(self, stage="urls", inputCol="text", outputCol="text", minLength=3, stopwords=None):
        super().__init__()
        self._setDefault(stage="urls", inputCol="text", outputCol="text", minLength=3, stopwords=C.ENGLISH_STOPWORDS)
        if stage not in self.NAMES:
            raise ValueError(f"unknown stage: {stage}")
        self._set(**{key: value for key, value in self._input_kwargs.items() if value is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, stage = F.coalesce(F.col(self.getInputCol()), F.lit("")), self.getOrDefault(self.stage)
        if stage == "urls":
            text = X.remove_urls(text)
        elif stage == "punctuation":
            text = X.remove_punctuation(text)
        elif stage == "non_ascii":
            text = X.remove_non_ascii(text)
        elif stage == "stopwords":
            text = X.join_tokens(X.remove_stopwords(X.tokenize(F.lower(text)), self.getOrDefault(self.stopwords)))
        else:
            text = X.join_tokens(X.remove_short(X.tokenize(text), self.getOrDefault(self.minLength)))
        return dataset.withColumn(self.getOutputCol(), text)


def cleaning_stages(
    min_length: int = 3, stopwords: list[str] | None = None, column: str = "text", dictionary: DataFrame | None = None
) -> Pipeline:
    """The six cleaning stages in their fixed order, each on its own; `TextCleaner` is the first five in one."""
    words = C.ENGLISH_STOPWORDS if stopwords is None else stopwords
    stages = [
        TextStage(stage=name, inputCol=column, outputCol=column, minLength=min_length, stopwords=words)
        for name in TextStage.NAMES
    ]
    lemmas = NounLemmas(dictionary)
    return Pipeline(stages=[*stages, lemmas._set(inputCol=column, outputCol=column)])


class _TableWriter(MLWriter):
    """Saves the parameters of a model plus named tables and a small JSON document."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"state": self.instance._state()})
        for name, table in self.instance._tables().items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


class _TableReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in self.kind.TABLES}
        model = self.kind._restore(tables, metadata.get("state"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _TableModel(Model, MLReadable, MLWritable):
    TABLES: tuple[str, ...] = ()

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def _state(self):
        return None


class _LemmaParams(HasInputCol, HasOutputCol):
    idCol = Param(Params._dummy(), "idCol", "column that identifies a row", TypeConverters.toString)

    def _init_lemmas(self) -> None:
        self._setDefault(inputCol="text_clean", outputCol="text_clean", idCol="id")


class NounLemmas(Estimator, _LemmaParams):
    """Builds the lemma table from the words of the fitted texts, or from a given dictionary table."""

    def __init__(self, dictionary: DataFrame | None = None, exceptions: DataFrame | None = None):
        super().__init__()
        self._init_lemmas()
        self.dictionary, self.exceptions = dictionary, exceptions

    def _fit(self, dataset: DataFrame) -> NounLemmasModel:
        tokens = dataset.select(F.split(self.getInputCol(), " ").alias("tokens"))
        words = written(vocabulary(tokens).where("word <> ''"), "words")
        table = written(lemma_table(words, self.dictionary, self.exceptions), "lemmas")
        return self._copyValues(NounLemmasModel(table))


class NounLemmasModel(_TableModel, _LemmaParams):
    TABLES = ("lemmas",)

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self._init_lemmas()
        self.table = table

    def _tables(self) -> dict[str, DataFrame]:
        return {"lemmas": self.table}

    @classmethod
    def _restore(cls, tables, state):
        return cls(tables["lemmas"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, source, target = self.getOrDefault(self.idCol), self.getInputCol(), self.getOutputCol()
        if key not in dataset.columns:
            raise ValueError(f"rows need the id column {key!r}")
        tokens = dataset.select(key, F.split(source, " ").alias("tokens"))
        spelled = apply_lemmas(tokens, self.table, key).select(key, X.join_tokens(F.col("tokens")).alias(target))
        return dataset.drop(target).join(spelled, key)


class SmoothTfidf(Estimator, HasInputCol, HasOutputCol):
    """Sparse TF-IDF vectors: raw counts times ln((1 + n) / (1 + df)) + 1, scaled to length one.

    Fitting gives a PipelineModel of Spark's own stages. The vocabulary lives on the driver, as in
    every vector model of Spark, and is never cut: with a `maxVocabulary` (none by default) a larger
    one raises an error. The long form in `operators.tfidf` keeps it in a table.
    """

    maxVocabulary = Param(Params._dummy(), "maxVocabulary", "largest vocabulary accepted", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="text_clean", outputCol="features", maxVocabulary=MAX_VOCABULARY):
        super().__init__()
        self._setDefault(inputCol="text_clean", outputCol="features", maxVocabulary=MAX_VOCABULARY)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        limit = self.getOrDefault(self.maxVocabulary)
        names = {part: f"{self.getOutputCol()}_{part}" for part in ("terms", "counts", "raw")}
        words = RegexTokenizer(
            inputCol=self.getInputCol(), outputCol=names["terms"], pattern=C.TERM_PATTERN, gaps=False
        )
        terms = words.transform(dataset.select(self.getInputCol()))
        vectorizer = CountVectorizer(
            inputCol=names["terms"], outputCol=names["counts"], minDF=1, vocabSize=min(limit + 1, MAX_VOCABULARY)
        ).fit(terms)
        if len(vectorizer.vocabulary) > limit:
            raise ValueError(f"the vocabulary has more than {limit} terms")
        idf = IDF(inputCol=names["counts"], outputCol=names["raw"]).fit(vectorizer.transform(terms))
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol=names["counts"], outputCol=names["raw"]
        )
        norm = Normalizer(p=2.0, inputCol=names["raw"], outputCol=self.getOutputCol())
        return PipelineModel([words, vectorizer, scale, norm])


class _BayesParams(HasInputCol, HasLabelCol, HasPredictionCol):
    idCol = Param(Params._dummy(), "idCol", "column that identifies a row", TypeConverters.toString)
    varSmoothing = Param(
        Params._dummy(), "varSmoothing", "share of the largest variance added to all", TypeConverters.toFloat
    )

    def _init_bayes(self) -> None:
        self._setDefault(
            inputCol="text_clean", labelCol="label", predictionCol="prediction", idCol="id", varSmoothing=1e-9
        )


class GaussianTextBayes(Estimator, _BayesParams):
    """Gaussian naive Bayes on the TF-IDF weights of cleaned texts, in long form (numeric labels)."""

    @keyword_only
    def __init__(self, inputCol="text_clean", labelCol="label", predictionCol="prediction", idCol="id", varSmoothing=1e-9):
        super().__init__()
        self._init_bayes()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GaussianTextBayesModel:
        fit = fit_bayes(dataset, self.getLabelCol(), self.getOrDefault(self.idCol), self.getInputCol())
        return self._copyValues(GaussianTextBayesModel(fit))

    def fitMultiple(self, dataset, paramMaps):
        """The statistics do not depend on the smoothing, so a grid over it needs a single fit."""
        only_smoothing = all(set(params) <= {self.varSmoothing} for params in paramMaps)
        if not only_smoothing:
            return super().fitMultiple(dataset, paramMaps)
        model = self.fit(dataset)
        return iter([(index, model.copy(params)) for index, params in enumerate(paramMaps)])


class GaussianTextBayesModel(_TableModel, _BayesParams):
    TABLES = ("terms", "classes")

    def __init__(self, fit: BayesFit | None = None):
        super().__init__()
        self._init_bayes()
        self.fit = fit

    def _tables(self) -> dict[str, DataFrame]:
        return {"terms": self.fit.terms, "classes": self.fit.classes}

    def _state(self):
        return json.dumps([self.fit.rows, self.fit.n_terms, self.fit.max_variance])

    @classmethod
    def _restore(cls, tables, state):
        rows, n_terms, variance = json.loads(state)
        return cls(BayesFit(tables["classes"], tables["terms"], rows, n_terms, variance))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.idCol)
        found = predict_bayes(
            self.fit, dataset.select(key, self.getInputCol()), [self.getOrDefault(self.varSmoothing)], key,
            self.getInputCol(),
        )
        return dataset.join(found.withColumnRenamed("prediction_0", self.getPredictionCol()), key)


def _with_predictions(dataset: DataFrame, column: str, predict) -> DataFrame:
    """All rows of `dataset` with what `predict` gives for their numbers; ids may be null or repeat."""
    rows = numbered(dataset)
    found = predict(rows).withColumnRenamed("prediction", column)
    return rows.drop(column).join(found, "_row").drop("_row")


class _ForestParams(HasInputCol, HasLabelCol, HasPredictionCol, HasWeightCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(
        Params._dummy(), "minInstancesPerNode", "rows on both sides of a split", TypeConverters.toInt
    )

    def _init_forest(self) -> None:
        self._setDefault(
            inputCol="text_clean", labelCol="label", predictionCol="prediction", weightCol="weight", seed=42,
            numTrees=100, maxDepth=20, minInstancesPerNode=1,
        )


class TextForest(Estimator, _ForestParams):
    """A random forest on the sparse TF-IDF weights of cleaned texts (numeric labels)."""

    @keyword_only
    def __init__(self, inputCol="text_clean", labelCol="label", predictionCol="prediction", weightCol="weight", seed=42):
        super().__init__()
        self._init_forest()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextForestModel:
        fit = fit_forest(
            dataset, self.getLabelCol(), self.getWeightCol(), self.getInputCol(), self.getOrDefault(self.numTrees),
            self.getOrDefault(self.maxDepth), self.getOrDefault(self.minInstancesPerNode), self.getSeed(),
        )
        return self._copyValues(TextForestModel(fit))


class TextForestModel(_TableModel, _ForestParams):
    TABLES = ("terms", "nodes")

    def __init__(self, fit: ForestFit | None = None):
        super().__init__()
        self._init_forest()
        self.fit = fit

    def _tables(self) -> dict[str, DataFrame]:
        return {"terms": self.fit.terms, "nodes": self.fit.nodes}

    def _state(self):
        return json.dumps(self.fit.trees)

    @classmethod
    def _restore(cls, tables, state):
        return cls(ForestFit(tables["terms"], tables["nodes"], json.loads(state)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _with_predictions(
            dataset, self.getPredictionCol(), lambda rows: predict_forest(self.fit, rows, self.getInputCol())
        )


class _MachineParams(HasInputCol, HasLabelCol, HasPredictionCol, HasWeightCol, HasRegParam, HasTol, HasMaxIter):
    def _init_machine(self) -> None:
        self._setDefault(
            inputCol="text_clean", labelCol="label", predictionCol="prediction", weightCol="weight", regParam=0.0,
            tol=1e-6, maxIter=100,
        )


class TextMachine(Estimator, _MachineParams):
    """Linear support vector machines, one class against the rest, on sparse TF-IDF weights (numeric labels)."""

    @keyword_only
    def __init__(self, inputCol="text_clean", labelCol="label", predictionCol="prediction", weightCol="weight"):
        super().__init__()
        self._init_machine()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextMachineModel:
        fit = fit_machine(
            dataset, self.getLabelCol(), self.getWeightCol(), self.getInputCol(), self.getRegParam(), self.getTol(),
            self.getMaxIter(),
        )
        return self._copyValues(TextMachineModel(fit))


class TextMachineModel(_TableModel, _MachineParams):
    TABLES = ("terms",)

    def __init__(self, fit: MachineFit | None = None):
        super().__init__()
        self._init_machine()
        self.fit = fit

    def _tables(self) -> dict[str, DataFrame]:
        return {"terms": self.fit.terms}

    def _state(self):
        return json.dumps(self.fit.intercepts)

    @classmethod
    def _restore(cls, tables, state):
        return cls(MachineFit(tables["terms"], json.loads(state)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _with_predictions(
            dataset, self.getPredictionCol(), lambda rows: predict_machine(self.fit, rows, self.getInputCol())
        )
