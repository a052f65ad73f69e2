"""Batch scoring with any model: predictions per record, as a tagger would store them."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .select import SCORE_FLOOR


def predictions(df: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str, width: int, labels: list[tuple[str, str]],
                floor: float = SCORE_FLOOR, batch: int = 256) -> DataFrame:
    """All rows and columns with ``rating`` (every rating label), ``general`` and ``character`` (what reaches the floor, best first, equal
    scores in label order), each an array of (name, score), scores rounded to four places.

    ``load`` gives the model and runs once in each Python worker; the model maps a matrix of ``batch`` rows of ``width`` numbers to one score for each
    of ``labels`` (name, category). A null input has null scores and so null arrays.
    """
    score = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    zero = F.array_repeat(F.lit(0.0), width)
    scored = df.withColumn("_scores", F.when(F.col(column).isNotNull(), score(F.coalesce(F.col(column).cast("array<double>"), zero))))

    def of(category: str, least: float | None):
        each = [F.struct((-F.element_at("_scores", i + 1)).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("name"), F.bround(F.element_at("_scores", i + 1), 4).alias("score"))
                for i, (name, kind) in enumerate(labels) if kind == category]
        rows = F.filter(F.array(*each), lambda x: F.lit(True) if least is None else -x["o"] >= least)
        order = rows if least is None else F.sort_array(rows)
        return F.when(F.col("_scores").isNotNull(), F.transform(order, lambda x: F.struct(x["name"], x["score"]))).alias(category)

    return scored.withColumns({"rating": of("rating", None), "general": of("general", floor), "character": of("character", floor)}).drop("_scores")
