"""Image quality and mask checks over Spark's image struct, and hooks for models.

Models are callables that tasks load once; none is part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuscope.functions.vectors import unit_rows

SIDE = 256


def pixels(row) -> np.ndarray | None:
    """Red, green, blue as floats out of an image struct (which holds blue first); None if unreadable."""
    if row is None or not row["data"] or row["height"] <= 0:
        return None
    raw = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"]).astype(np.float64)
    return raw[..., :3][..., ::-1] if raw.shape[2] >= 3 else np.repeat(raw[..., :1], 3, axis=2)


def shrunk(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Scaled down to at most `side` by means over areas."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n > side:
            image = np.add.reduceat(image, np.arange(side) * n // side, axis=axis) / np.diff(np.append(np.arange(side) * n // side, n)).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
    return image


def measures(image: np.ndarray | None) -> tuple[float | None, float | None]:
    """Variance of the 4-neighbour Laplacian, and mean luma."""
    if image is None:
        return None, None
    luma = shrunk(image) @ np.array([0.299, 0.587, 0.114])
    if min(luma.shape) < 3:
        return 0.0, float(luma.mean())
    lap = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1]
    return float(lap.var()), float(luma.mean())


def image_quality(images: DataFrame, column: str = "image") -> DataFrame:
    """Adds sharpness, luma and grade (poor under 40, fair under 120 or too dark or bright, else good; unreadable images are good)."""

    @F.pandas_udf("sharpness double, luma double")
    def measured(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([measures(pixels(r)) for r in frame.to_dict("records")], columns=["sharpness", "luma"])

    found = images.withColumn("m", measured(F.col(column)))
    sharp, luma = F.col("m.sharpness"), F.col("m.luma")
    grade = F.when(sharp.isNull(), "good").when(sharp < 40, "poor").when((sharp < 120) | (luma < 40) | (luma > 215), "fair").otherwise("good")
    return found.withColumn("grade", grade).withColumn("sharpness", sharp).withColumn("luma", luma).drop("m")


def mask_ok(alpha: np.ndarray, least: float = 0.02) -> bool:
    """Whether enough of a mask is foreground (alpha of 10 or more) to be used."""
    return bool((alpha >= 10).mean() >= least) if alpha.size else False


def masks_ok(df: DataFrame, column: str = "alpha", least: float = 0.02) -> DataFrame:
    """Adds `usable`: whether enough of a mask (an array of alphas) is foreground; a null mask isn't."""

    @F.pandas_udf("boolean")
    def usable(masks: pd.Series) -> pd.Series:
        return masks.map(lambda m: m is not None and mask_ok(np.asarray(m), least))

    return df.withColumn("usable", usable(F.col(column)))


def embed(images: DataFrame, load: Callable[[], Callable], backend: str, *, id_column: str = "image_id", column: str = "data", tta: bool = True) -> DataFrame:
    """Vectors by a pluggable encoder: load() gives, once a task, a function of a list of inputs and a flag
    (mirrored) to a matrix. Unit length; with tta the mean with the mirror's. Rows it fails on have a reason instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()

        def vectors(inputs: list) -> list[list[float]]:
            sides = [np.asarray(encode(inputs, mirrored), np.float64) for mirrored in ((False, True) if tta else (False,))]
            mean = np.mean([unit_rows(x) for x in sides], axis=0)
            return unit_rows(mean).astype("float32").tolist()

        def one(x):
            try:
                return vectors([x])[0], None
            except Exception as e:  # noqa: BLE001  an encoder may fail in any way; the row says how
                return None, f"{type(e).__name__}: {e}"

        for frame in frames:
            inputs = list(frame[column])
            try:
                found = [(v, None) for v in vectors(inputs)]
            except Exception:  # noqa: BLE001  some input fails: row by row, to tell which
                found = [one(x) for x in inputs]
            yield pd.DataFrame({id_column: frame[id_column], "embedding": [v for v, _ in found], "backend": backend, "reason": [r for _, r in found]})

    kind = images.schema[id_column].dataType.simpleString()
    return images.select(id_column, column).mapInPandas(run, f"{id_column} {kind}, embedding array<float>, backend string, reason string")


def classify(rows: DataFrame, load: Callable[[], Callable], *, id_column: str = "query_id", column: str = "data") -> DataFrame:
    """Probabilities by a pluggable model: load() gives a function of a list of inputs to a matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield pd.DataFrame({id_column: frame[id_column], "probabilities": [list(map(float, p)) for p in model(list(frame[column]))]})

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, column).mapInPandas(run, f"{id_column} {kind}, probabilities array<double>")


def rerank(shortlists: DataFrame, load: Callable[[], Callable], n: int | Column = 3) -> DataFrame:
    """shortlists(query_id, skus, ...) with reply (of a pluggable chooser: load() gives a function of a list of shortlists to their replies) and choice (the SKU it names, null if none)."""
    from skuscope.functions.text import parse_choice

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choose = load()
        for frame in frames:
            frame["reply"] = choose([list(s) for s in frame["skus"]])
            yield frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shortlists.schema.fields) + ", reply string"
    replied = shortlists.mapInPandas(run, schema)
    return replied.withColumn("choice", F.get("skus", parse_choice(F.col("reply"), F.size("skus"))))
