"""One saved pipeline from raw rows to predictions.

A finished run is a ``PipelineModel``: own transformers for what Spark ML has no
stage for (typed fills and scaling by name, dictionary codes from a table, label
decoding), stock stages for the rest (one-hot, assembler, learner). Each writes
its parameters, and its table as Parquet, into the pipeline's folder, so another
session loads the folder and scores raw rows. Columns made on the way begin with
``__q_`` and are dropped by the last stage.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import qcol
from quarry.operators import dictionary

MADE = "__q_"


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        if self.instance.table is not None:
            self.instance.table.write.parquet(f"{path}/table")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        stage = super().load(path)
        schema = stage.getOrDefault(stage.spec).get("table")
        if schema:
            stage.table = self.sparkSession.read.schema(schema).parquet(f"{path}/table")
        return stage


class _Stage(Transformer, MLReadable, MLWritable):
    """A transformer with one JSON parameter and, if its spec names a schema, a table."""

    spec = Param(Params._dummy(), "spec", "what the stage does, as JSON")

    def __init__(self, spec: dict | None = None, table: DataFrame | None = None):
        super().__init__()
        self.table = table
        if spec is not None:
            self._set(spec=spec | ({"table": table.schema.simpleString()[7:-1].replace(":", " ")} if table is not None else {}))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def _get(self, name: str):
        return self.getOrDefault(self.spec)[name]


class PrepareColumns(_Stage):
    """Adds the filled and scaled numeric inputs and the filled categorical inputs, as text.

    spec: ``numerical`` [name, fill or null, shift, divisor, out], ``categorical`` [name, fill as text or null, out].
    A missing input column raises."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = []
        for name, fill, shift, divisor, made in self._get("numerical"):
            x = qcol(name).cast("double")
            x = F.when(~F.isnan(x), x)
            x = F.coalesce(x, F.lit(fill)) if fill is not None else x
            out.append(((x - F.lit(shift)) / F.lit(divisor)).alias(made))
        for name, fill, made in self._get("categorical"):
            v = qcol(name).cast("string")
            out.append((F.coalesce(v, F.lit(fill)) if fill is not None else v).alias(made))
        return df.select("*", *out)


class CategoryCodes(_Stage):
    """Adds the dictionary code of each categorical input; unseen values get the number of categories.

    spec: ``columns`` [name, source, out, number of categories]; table: ``dictionary.category_table``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self._get("columns")
        return dictionary.encode(df, self.table, {c: (source, made) for c, source, made, _ in columns},
                                 {c: n for c, _, _, n in columns})


class FinishPrediction(_Stage):
    """Adds ``confidence_score`` and, with labels, ``predicted_label``; drops the columns made on the way.

    spec: ``task``; table: (index, label) or none."""

    def _transform(self, df: DataFrame) -> DataFrame:
        best = F.array_max(vector_to_array(F.col("probability"))) if (
            self._get("task") == "classification" and "probability" in df.columns) else F.lit(1.0)
        out = df.withColumn("confidence_score", best.cast("double"))
        if self.table is not None:
            labels = self.table.select(F.col("index").cast("double").alias("__q_index"), F.col("label").alias("__q_label"))
            out = out.join(labels, F.col("prediction") == F.col("__q_index"), "left").withColumn(
                "predicted_label", F.coalesce("__q_label", F.col("prediction").cast("string")))
        made = [c for c in out.columns if c.startswith(MADE)]
        return out.drop(*made, "features", "rawPrediction", "probability")


def preparation(spark, numerical: list[str], categorical: list[str], fills: dict, scale: dict, table: DataFrame | None) -> list:
    """The fitted stages from raw columns to the ``features`` vector: numeric inputs, then one-hot ones."""
    n = dictionary.sizes(table) if table is not None and categorical else {}
    categorical = [c for c in categorical if n.get(c)]  # a column without any value in train gives no feature
    num = [[c, None if fills.get(c) is None else float(fills[c]), *map(float, scale.get(c, (0.0, 1.0))), f"{MADE}x{i}"]
           for i, c in enumerate(numerical)]
    cat = [[c, _text(spark, fills.get(c)), f"{MADE}v{i}"] for i, c in enumerate(categorical)]
    stages: list = [PrepareColumns({"numerical": num, "categorical": cat})]
    inputs = [x[-1] for x in num]
    if categorical:
        codes = [[c, f"{MADE}v{i}", f"{MADE}k{i}", n[c]] for i, c in enumerate(categorical)]
        hot = [f"{MADE}h{i}" for i in range(len(codes))]
        # one row of the codes of unseen values tells the encoder all sizes; the last code has no place in the vector
        last = spark.createDataFrame([tuple(float(x[3]) for x in codes)], ", ".join(f"{x[2]} double" for x in codes))
        encoder = OneHotEncoder(inputCols=[x[2] for x in codes], outputCols=hot, dropLast=True).fit(last)
        stages += [CategoryCodes({"columns": codes}, table), encoder]
        inputs += hot
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def _text(spark, value) -> str | None:
    """A value as Spark writes it as text."""
    if value is None or isinstance(value, str):
        return value
    return spark.range(1).select(F.lit(value).cast("string")).first()[0]


def scoring_pipeline(stages: list, learner, task: str, labels: DataFrame | None = None) -> PipelineModel:
    """Raw rows to ``prediction, confidence_score`` (and ``predicted_label``): one model to save."""
    return PipelineModel(stages=[*stages, learner, FinishPrediction({"task": task}, labels)])


def inputs_of(model: PipelineModel) -> list[str]:
    """The raw columns that a scoring pipeline reads."""
    first = model.stages[0]
    return [x[0] for x in (*first._get("numerical"), *first._get("categorical"))]
