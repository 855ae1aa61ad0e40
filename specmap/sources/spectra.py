"""The spectra table and its sources.

A spectra table has one row per star: star_id BIGINT, flux ARRAY<FLOAT>, good ARRAY<BOOLEAN>, err ARRAY<FLOAT>.
The pixel axis is described once, by the detector segment of every pixel.
"""
import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPECTRA = "star_id bigint, flux array<float>, good array<boolean>, err array<float>"


def coerce(df: DataFrame) -> DataFrame:
    """Cast to the spectra schema; a missing error becomes one, a missing mask means every pixel is good."""
    flux = F.col("flux").cast("array<float>")
    ones = F.array_repeat(F.lit(1.0).cast("float"), F.size("flux"))
    good = F.col("good").cast("array<boolean>") if "good" in df.columns else F.lit(None).cast("array<boolean>")
    err = F.col("err").cast("array<float>") if "err" in df.columns else F.lit(None).cast("array<float>")
    return df.select(
        F.col("star_id").cast("bigint").alias("star_id"), flux.alias("flux"),
        F.coalesce(good, F.array_repeat(F.lit(True), F.size("flux"))).alias("good"),
        F.coalesce(err, ones).alias("err"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return coerce(spark.read.parquet(path))


def from_arrays(spark: SparkSession, flux, good=None, err=None, star_ids: Sequence[int] | None = None) -> DataFrame:
    """Arrays the caller already holds in memory, as a spectra table."""
    flux = np.asarray(flux, np.float32)
    columns = {"star_id": np.arange(len(flux)) if star_ids is None else np.asarray(star_ids, np.int64),
               "flux": list(flux)}
    fields = [("star_id", pa.int64()), ("flux", pa.list_(pa.float32()))]
    if good is not None:
        columns["good"], fields = list(np.asarray(good, bool)), fields + [("good", pa.list_(pa.bool_()))]
    if err is not None:
        columns["err"], fields = list(np.asarray(err, np.float32)), fields + [("err", pa.list_(pa.float32()))]
    return coerce(spark.createDataFrame(pa.table(columns, schema=pa.schema(fields))))


def segments_table(spark: SparkSession, segments: Sequence[int]) -> DataFrame:
    """The pixel axis as a dimension table (pix, segment)."""
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(segments)], "pix int, segment int")


def to_long(df: DataFrame) -> DataFrame:
    """One row per star and pixel: (star_id, pix, flux, good, err)."""
    cell = F.posexplode(F.arrays_zip("flux", "good", "err")).alias("pix", "cell")
    return df.select("star_id", cell).select("star_id", "pix", "cell.flux", "cell.good", "cell.err")


def to_wide(long: DataFrame) -> DataFrame:
    """The inverse of to_long; the cells of a star (one per pixel) are ordered by pixel."""
    cells = F.array_sort(F.collect_list(F.struct("pix", "flux", "good", "err")))
    return long.groupBy("star_id").agg(cells.alias("_c")).select(
        "star_id", F.col("_c.flux").alias("flux"), F.col("_c.good").alias("good"), F.col("_c.err").alias("err"))


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def _member_header(handle) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(handle)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(handle)
    if fortran:
        raise ValueError("column-major arrays cannot be read by row ranges")
    return shape, dtype


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, rows_per_task: int):
        self.path, self.step = path, rows_per_task

    def partitions(self):
        with zipfile.ZipFile(self.path) as archive, archive.open("flux.npy") as member:
            rows = _member_header(member)[0][0]
        return [_Rows(i, min(i + self.step, rows)) for i in range(0, rows, self.step)]

    def _slice(self, archive: zipfile.ZipFile, name: str, part: _Rows) -> np.ndarray:
        with archive.open(name + ".npy") as member:
            shape, dtype = _member_header(member)
            width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
            member.seek(part.start * width, io.SEEK_CUR)
            raw = member.read((part.stop - part.start) * width)
        return np.frombuffer(raw, dtype).reshape((part.stop - part.start,) + tuple(shape[1:]))

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(self.path) as archive:
            names = set(archive.namelist())
            flux = self._slice(archive, "flux", partition).astype(np.float32)
            cols = {"star_id": pa.array(np.arange(partition.start, partition.stop)),
                    "flux": pa.array(list(flux), pa.list_(pa.float32()))}
            for name, kind, dtype in (("good", pa.bool_(), bool), ("err", pa.float32(), np.float32),
                                      ("labels", pa.float64(), np.float64)):
                if name + ".npy" in names:
                    cols[name] = pa.array(list(self._slice(archive, name, partition).astype(dtype)), pa.list_(kind))
                else:
                    cols[name] = pa.nulls(len(flux), pa.list_(kind))
        yield pa.RecordBatch.from_pydict(cols)


class NpzSpectra(DataSource):
    """spark.read.format("npz_spectra").load(path): the arrays flux, good, err, labels of an .npz archive.

    Every task opens the archive itself and reads its own range of rows; nothing passes through the driver.
    Option rows_per_task (default 4096) sets the size of a range.
    """

    @classmethod
    def name(cls) -> str:
        return "npz_spectra"

    def schema(self) -> str:
        return SPECTRA + ", labels array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options["path"], int(self.options.get("rows_per_task", 4096)))


def read_npz(spark: SparkSession, path: str, rows_per_task: int = 4096) -> DataFrame:
    """Spectra and, where the archive has them, labels; pass the result to coerce() to fill the defaults."""
    spark.dataSource.register(NpzSpectra)
    return spark.read.format("npz_spectra").option("rows_per_task", rows_per_task).load(path)
