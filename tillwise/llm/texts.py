"""Texts compressed for a shuffle: half the bytes of the shuffle's own compression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tillwise.llm.words import small


def packed_texts(docs: DataFrame, text: str, tag: str) -> DataFrame:
    """The frame with the text column compressed (null: empty) and its tag added."""
    schema = StructType(
        [
            *[f if f.name != text else StructType.fromDDL(f"`{text}` binary").fields[0] for f in docs.schema.fields],
            *StructType.fromDDL(f"`{tag}` bigint").fields,
        ]
    )
    place = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in small(batches):
            contents = [(value.as_py() or "").encode() for value in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array([pack(c) for c in contents], pa.binary())
            tags = pa.array([zlib.crc32(c) & 0x7FFFFFFF for c in contents], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, tags], names=schema.names)

    return docs.mapInArrow(rows, schema)


def unpacked(column: pa.Array) -> pa.Array:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(value.as_py()) for value in column], pa.binary()).cast(pa.string())
