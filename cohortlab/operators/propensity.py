"""Propensity score (PS1): logistic regression of treatment on covariates,
fitted with Spark ML and applied to every row.

The study used scikit-learn with C = 1e6 (an L2 penalty so weak the fit is
effectively unpenalised). scikit-learn minimises C * sum(loss) + ||w||^2 / 2
while Spark minimises mean(loss) + regParam * ||w||^2 / 2, so the same
objective is regParam = 1 / (C * n). The intercept is unpenalised in both.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import LOGISTIC_C, LOGISTIC_MAX_ITER


def propensity_score(df: DataFrame, treatment: str, covariates: list[str],
                     C: float = LOGISTIC_C, max_iter: int = LOGISTIC_MAX_ITER,
                     tol: float = 1e-6, out_col: str = "propensity_score") -> DataFrame:
    """Fit P(treatment = 1 | covariates) and append it as ``out_col``."""
    n = df.count()
    va = VectorAssembler(inputCols=covariates, outputCol="_features", handleInvalid="keep")
    data = va.transform(df.withColumn("_label", F.col(treatment).cast("double")))
    lr = LogisticRegression(featuresCol="_features", labelCol="_label",
                            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                            # standardised internally for a well-conditioned L-BFGS; with
                            # C = 1e6 the penalty is negligible either way
                            standardization=True, maxIter=max_iter, tol=tol,
                            probabilityCol="_prob", rawPredictionCol="_raw",
                            predictionCol="_pred")
    model = lr.fit(data)
    scored = model.transform(data)
    return scored.withColumn(out_col, vector_to_array(F.col("_prob")).getItem(1)) \
                 .drop("_features", "_label", "_prob", "_raw", "_pred")
