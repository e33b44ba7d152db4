"""Sources and sinks: keyed array containers, Matrix Market files, and images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.operators.dense import _TYPE, ARRAY, decode, encode, ship
from skeinframe.operators.tensor import Tensor

# keyed arrays -----------------------------------------------------------------------------


def save_array(t: Tensor, key: str, path: str, append: bool = False) -> None:
    """A Parquet data set partitioned by key: elements with the tensor's shape and type."""
    rows = t.df.select("*", F.array(*map(F.lit, t.dims)).alias("dims"), F.lit(t.dtype).alias("dtype"), F.lit(t.sparse).alias("sparse"), F.lit(key).alias("key"))
    rows.write.mode("append" if append else "overwrite").partitionBy("key").parquet(path)


def read_array(spark: SparkSession, path: str, key: str) -> Tensor:
    """Only the key's partition is read."""
    rows = spark.read.parquet(path).where(F.col("key") == key)
    head = rows.select("dims", "dtype", "sparse").first()
    if head is None:
        raise KeyError(key)
    return Tensor(rows.select("d0", "d1", "d2", "d3", "v"), tuple(head["dims"]), head["dtype"], head["sparse"])


def keys(spark: SparkSession, path: str) -> list[str]:
    return sorted(r["key"] for r in spark.read.parquet(path).select("key").distinct().collect())


# Matrix Market ------------------------------------------------------------------------------


def read_matrix_market(spark: SparkSession, path: str) -> Tensor:
    """Coordinate files (real, integer or pattern; general or symmetric) as a sparse tensor. Lines are parsed in parallel."""
    lines = spark.read.text(path)
    kind = lines.where(F.col("value").startswith("%%MatrixMarket")).first()["value"].lower().split()
    parts = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    size = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select("value").first()["value"].split()
    value = F.lit(1.0) if "pattern" in kind else F.get("p", F.lit(2)).cast("double")
    # the size line names the shape; as it has the count of entries third, it is told from an entry by its text
    entries = parts.where(F.array_join("p", " ") != " ".join(size)).select((F.get("p", F.lit(0)).cast("long") - 1).alias("d0"), (F.get("p", F.lit(1)).cast("long") - 1).alias("d1"), value.alias("v"))
    if "symmetric" in kind:
        entries = entries.unionByName(entries.where("d0 <> d1").select(F.col("d1").alias("d0"), F.col("d0").alias("d1"), "v"))
    return Tensor.of(entries, [int(size[0]), int(size[1])], sparse=True)


# images -------------------------------------------------------------------------------------


def decode_image(data: bytes) -> np.ndarray | None:
    """Rows x columns (x channels) of 8-bit values as floats: binary PPM/PGM, BMP of 24 bits, and PNG of 8 bits without interlacing. None for others."""
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at) + 1
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        columns, rows, _ = fields
        channels = 3 if data[:2] == b"P6" else 1
        out = np.frombuffer(data, np.uint8, rows * columns * channels, at + 1).reshape(rows, columns, channels)
    elif data[:2] == b"BM":
        at, (columns, rows), bits = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
        if bits != 24:
            return None
        line = (columns * 3 + 3) // 4 * 4
        out = np.frombuffer(data, np.uint8, line * abs(rows), at).reshape(abs(rows), line)[:, : columns * 3].reshape(abs(rows), columns, 3)[:, :, ::-1]
        out = out[::-1] if rows > 0 else out
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        out = _png(data)
        if out is None:
            return None
    else:
        return None
    return (out[..., 0] if out.shape[2] == 1 else out).astype(float)


def _png(data: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    columns, rows, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        return None
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, columns * channels + 1)
    out = np.zeros((rows, columns * channels), np.uint8)
    above = np.zeros(columns * channels, int)
    for i in range(rows):
        kind, line = raw[i, 0], raw[i, 1:].astype(int)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = line.reshape(columns, channels).cumsum(axis=0).ravel()
        elif kind in (3, 4):
            for j in range(len(line)):
                left = line[j - channels] if j >= channels else 0
                corner = above[j - channels] if j >= channels else 0
                if kind == 3:
                    guess = (left + above[j]) // 2
                else:
                    p = left + above[j] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[j]), 1, above[j]), (abs(p - corner), 2, corner))[2]
                line[j] = (line[j] + guess) & 255
        above = line & 255
        out[i] = above
    return out.reshape(rows, columns, channels)


def encode_image(a: np.ndarray, kind: str = "png") -> bytes:
    """PNG, PPM/PGM or BMP; values are rounded into 0 to 255."""
    a = np.rint(np.asarray(a).real).clip(0, 255).astype(np.uint8)
    a = a[..., None] if a.ndim == 2 else a
    rows, columns, channels = a.shape
    if kind in ("ppm", "pgm"):
        return f"P{6 if channels == 3 else 5}\n{columns} {rows}\n255\n".encode() + a.tobytes()
    if kind == "bmp":
        a = np.repeat(a, 3, axis=2) if channels == 1 else a
        line = (columns * 3 + 3) // 4 * 4
        body = b"".join(a[i, :, ::-1].tobytes().ljust(line, b"\0") for i in range(rows - 1, -1, -1))
        return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", columns, rows, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    body = b"".join(b"\0" + a[i].tobytes() for i in range(rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def load_images(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, image) of every file; image is NULL for formats that can't be read."""
    ship(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(decode_image(x.as_py())) for x in batch.column(1)], _TYPE)], ["path", "image"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, f"path string, image {ARRAY}")


def encode_images(df: DataFrame, image: str = "image", kind: str = "png", name: str = "content") -> DataFrame:
    """df with the encoded bytes of each image in place of the image."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != image]
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else encode_image(decode(x), kind) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(data, pa.binary())], [*keep, name])

    return df.select(*keep, image).mapInArrow(work, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{name} binary"]))


def is_image_io_available() -> bool:
    return True
