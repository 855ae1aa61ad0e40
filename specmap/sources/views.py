"""Spectra views over ordinary tables: embeddings, event series and documents read as profiles."""
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import lists, map_batches
from .spectra import coerce

EMB_PIXELS = 64
EMB_SEGMENTS = [0] * 32 + [1] * 32
DOC_SEGMENTS = [0] * 26
TEXT_BYTES = 1 << 20       # bytes of text whose letters are counted at once; one longer text is cut into such pieces


def _indexed(n: int, cell) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Each vector as a 64-pixel profile in two segments, with a periodic bad-pixel mask."""
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    return coerce(df.select(
        F.col("vec_id").alias("star_id"),
        F.transform("embedding", lambda e: F.lit(0.75) - F.lit(0.5) * e.cast("double")).alias("flux"),
        _indexed(EMB_PIXELS, lambda p: (F.col("vec_id") * 7 + p * 13) % 29 != 0).alias("good"),
        _indexed(EMB_PIXELS, lambda p: F.lit(0.01) * (1 + p % 4)).alias("err")))


def coordinates(spark: SparkSession, path: str, d: int) -> DataFrame:
    """(star_id, c): d coordinates of each vector, each the sum of every d-th of all its elements."""
    df = spark.read.parquet(f"{path}/embeddings.parquet")

    def fold(j: int) -> Column:
        return F.aggregate(F.filter("embedding", lambda e, i: i % d == j), F.lit(0.0), lambda s, e: s + e.cast("double"))

    return df.select(F.col("vec_id").alias("star_id"), F.array(*map(fold, range(d))).alias("c"))


def event_days(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """Each user's mean event value per day as a profile over the days of the table, in one segment; days without events
    are bad pixels. Depths are shares of the largest daily mean.

    Values have two decimals, so they are summed as integers and the mean does not depend on their order.
    """
    df = spark.read.parquet(f"{path}/events.parquet").select("user_id", F.to_date("ts").alias("date"), "value")
    begin, end = df.agg(F.min("date"), F.max("date")).first()
    days = (end - begin).days + 1 if begin else 0
    cents = F.floor(F.col("value") * 100 + 0.5)
    daily = (df.select("user_id", F.date_diff("date", F.lit(begin)).alias("day"), cents.alias("cents"))
             .groupBy("user_id", "day").agg((F.sum("cents") / F.count("cents") / 100).alias("mean")))
    top = daily.agg(F.max("mean")).first()[0] or 1.0
    flux = 1 - F.lit(0.9) * F.col("mean") / F.lit(float(top))
    series = daily.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", flux.alias("f")))).alias("m"))
    return coerce(series.select(
        F.col("user_id").alias("star_id"),
        _indexed(days, lambda p: F.col("m")[p]).alias("flux"),
        _indexed(days, lambda p: F.col("m")[p].isNotNull()).alias("good"))), [0] * days


def letter_counts(texts: pa.Array) -> np.ndarray:
    """(rows, 26): how often each ASCII letter, in either case, occurs in every text; one pass over the bytes."""
    slot = np.full(256, 26, np.int64)
    for at, letter in enumerate(string.ascii_lowercase):
        slot[[ord(letter), ord(letter.upper())]] = at
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    out = np.zeros((len(texts), 27), np.int64)
    for at in range(int(offsets[0]) if len(texts) else 0, int(offsets[-1]) if len(texts) else 0, TEXT_BYTES):
        end = min(at + TEXT_BYTES, int(offsets[-1]))
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")     # the texts of these bytes
        held = np.diff(np.clip(offsets[first:last + 1], at, end))
        row = np.repeat(np.arange(len(held)), held)
        out[first:last] += np.bincount(row * 27 + slot[data[at:end]], minlength=27 * len(held)).reshape(-1, 27)
    return out[:, :26]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document as a 26-pixel profile: one less the share of every letter, counted over the whole text."""
    df = spark.read.parquet(f"{path}/documents.parquet").select(F.col("doc_id").alias("star_id"), "text")

    def stage(batch):
        counts = letter_counts(batch["text"])
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return {"star_id": batch["star_id"], "flux": lists((1 - share).astype(np.float32))}

    return coerce(map_batches(df, stage, "star_id bigint, flux array<float>"))


def document_labels(spark: SparkSession, path: str) -> DataFrame:
    """(star_id, y): quality and toxicity of the labelled documents."""
    df = spark.read.parquet(f"{path}/labels.parquet")
    y = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return df.select(F.col("doc_id").alias("star_id"), y.alias("y"))


def as_features(spectra: DataFrame) -> DataFrame:
    """The flux itself as the feature vector."""
    return spectra.select("star_id", F.col("flux").alias("phi"))
