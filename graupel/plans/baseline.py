"""A tabular susceptibility baseline, evaluated by spatial folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from graupel.functions.lineage import require_no_event_signal

def fold_auc(samples: DataFrame, features: list[str], label: str = "label", fold: str = "fold", folds: int = 5, trees: int = 100, seed: int = 7) -> DataFrame:
    """model, fold, auc: each fold is scored by models of the others; features tagged with the event's window are refused."""
    require_no_event_signal(samples, features)
    spark = samples.sparkSession
    known = samples.na.drop(subset=features).withColumn("_label", F.col(label).cast("double"))
    first = VectorAssembler(inputCols=features, outputCol="_raw")
    models = {
        "random_forest": [first, RandomForestClassifier(featuresCol="_raw", labelCol="_label", numTrees=trees, seed=seed)],
        "logistic": [first, StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol="_label")],
    }
    measure = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction")
    out = []
    for k in range(folds):
        train, test = known.where(F.col(fold) != k), known.where(F.col(fold) == k)
        if test.select("_label").distinct().count() < 2 or train.select("_label").distinct().count() < 2:
            continue
        for name, stages in models.items():
            out.append((name, k, float(measure.evaluate(Pipeline(stages=stages).fit(train).transform(test)))))
    return spark.createDataFrame(out, "model string, fold int, auc double")
