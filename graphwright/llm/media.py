"""Media columns: AVI motion-JPEG in binary columns, as timed clip rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mjpeg
from .settle import small_batches

CLIPS = "clip int, start_s double, end_s double, frames int, histogram array<double>"


def clips(df: DataFrame, key: str = "id", media: str = "media") -> DataFrame:
    """(key, clip, start_s, end_s, frames, histogram, error): a row for each shot of each AVI of column ``media``.

    A null or empty value, or one that isn't an AVI of baseline frames, gives one row with null clip
    columns and the reason in ``error``; an AVI without frames gives no row, one without index those of its list. Repeated rows give
    repeated clips. Columns other than ``key`` and ``media`` aren't carried.
    """
    kind = df.schema[key].dataType.simpleString()
    arrow = pa.list_(pa.float64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                found, error = [], None
                try:
                    found = mjpeg.clip_rows(data) if data else []
                    error = None if data else "no data"
                except (ValueError, KeyError, IndexError, ArithmeticError, mjpeg.struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                cells = found or ([(None,) * 5] if error else [])
                if cells:
                    cols = [pa.array([c[j] for c in cells], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.int32(), arrow))]
                    at = pa.array([i] * len(cells), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *cols, pa.array([error] * len(cells), pa.string())], names=["key", "clip", "start_s", "end_s", "frames", "histogram", "error"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{media}`").cast("binary").alias("media")).mapInArrow(rows, f"key {kind}, {CLIPS}, error string").withColumnRenamed("key", key)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a binary column ``media``: the text's padded UTF-8 as an AVI. A null text counts as empty."""
    make = F.udf(lambda t: mjpeg.write_avi(mjpeg.payload_of(t)[1]), "binary", useArrow=True)
    return docs.withColumn("media", make(F.col(f"`{text}`")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    for batch in batches:
        rows = [mjpeg.digest(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)]], names=["doc_id", *[n for n, _ in kinds]])


def op5_media(spark, sf_dir: str) -> DataFrame:
    """Each text of ``documents`` stored as an AVI and read back: sizes, digests and the features of the decoded frames.

    A null text counts as empty and gives one block of padding; a repeated row gives its row again, equal texts equal values; an empty table gives
    none. Texts of any length are whole: frames are written and read one after the other. Only doc_id and text are read, whatever other columns are there."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
