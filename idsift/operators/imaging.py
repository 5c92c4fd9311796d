"""Capture quality: pixel features per image, gate and type hint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from idsift.policy import QUALITY_THRESHOLDS

FEATURES = "doc_id string, width int, height int, laplacian_variance double, brightness double, saturated_fraction double"
SATURATED = 253


def _measure(data: bytes, height: int, width: int) -> tuple[float, float, float]:
    """Sharpness, brightness and saturation of one BGR image."""
    bgr = np.frombuffer(data, np.uint8).reshape(height, width, 3)
    # Standard luma weights, rounded to whole grey levels.
    grey = np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.float64)
    # Reflected borders, as the second derivative needs a neighbour on each side.
    p = np.pad(grey, 1, mode="reflect")
    second = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    saturated = (bgr >= SATURATED).all(axis=2).mean()
    return round(float(second.var()), 3), round(float(grey.mean()), 3), round(float(saturated), 5)


def features(images: DataFrame) -> DataFrame:
    """Quality features of rows ``doc_id, height, width, data`` (BGR bytes).

    Images are independent, so this is one narrow pass without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (r.doc_id, r.width, r.height, *_measure(r.data, r.height, r.width))
                for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame(
                rows,
                columns=["doc_id", "width", "height", "laplacian_variance", "brightness", "saturated_fraction"],
            )

    return images.select("doc_id", "height", "width", "data").mapInPandas(run, FEATURES)


def gate(measured: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """``capture_codes`` and ``capture_status``; plain predicates."""
    t = thresholds or QUALITY_THRESHOLDS
    codes = F.array_compact(
        F.array(
            F.when((F.col("width") < t["min_width"]) | (F.col("height") < t["min_height"]), "LOW_RESOLUTION"),
            F.when(F.col("laplacian_variance") < t["min_laplacian_variance"], "BLUR"),
            F.when(F.col("brightness") < t["min_brightness"], "DARK"),
            F.when(F.col("brightness") > t["max_brightness"], "OVEREXPOSED"),
            F.when(F.col("saturated_fraction") > t["max_saturated_fraction"], "POSSIBLE_GLARE"),
        )
    )
    return measured.withColumn("capture_codes", codes).withColumn(
        "capture_status", F.when(F.size("capture_codes") > 0, "needs_rescan").otherwise("ok")
    )


def type_hint(measured: DataFrame) -> DataFrame:
    """A card-like aspect ratio suggests an ID, with low confidence."""
    card = (F.col("width") / F.col("height")).between(1.48, 1.68)
    return measured.withColumn("hint", F.when(card, "id").otherwise("unknown")).withColumn(
        "hint_confidence", F.when(card, 0.35)
    )
