"""Packing: bounded-space online best fit.

Every partition keeps a fixed number of open windows. A document's ids fill whole windows first;
the rest goes to the open window it fits best. When it fits in none, the fullest is emitted, topped
up with a cut piece where more than ``SLACK`` places would stay empty. What is open at the end of
the partitions is merged the same way by ever fewer tasks, and the last task cuts the rest into
full windows and a tail of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwise.functions.lineage import written
from tillwise.llm.tokens import encoder
from tillwise.llm.words import small

LENGTH = 2048
END = 1
#: Parameters: open windows per partition, places that may stay empty, partitions merged by one task.
OPEN = 64
SLACK = 16
FAN_IN = 64

PIECES = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, "
    "part bigint, open boolean, ids binary"
)


class Packer:
    """The open windows of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, number: int):
        self.length, self.number, self.made = length, number, 0
        self.free: list[tuple[int, int]] = []  # (places left, window), the fullest first
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple[int, list[tuple]]] = []

    def opened(self, pieces: list[tuple]) -> int:
        self.made += 1
        self.held[self.made] = pieces
        return self.made

    def emit(self, window: int) -> None:
        self.done.append((window, self.held.pop(window)))

    def put(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.emit(self.opened([(doc_id, start, ids[: self.length], total)]))
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect_left(self.free, (len(ids), 0))
            if at < len(self.free):
                left, window = self.free.pop(at)
                self.held[window].append((doc_id, start, ids, total))
                if left > len(ids):
                    insort(self.free, (left - len(ids), window))
                else:
                    self.emit(window)
                return
            if len(self.free) < self.number:
                window = self.opened([(doc_id, start, ids, total)])
                insort(self.free, (self.length - len(ids), window))
                return
            left, window = self.free.pop(0)
            if left > SLACK:
                self.held[window].append((doc_id, start, ids[:left], total))
                start, ids = start + left, ids[left:]
            self.emit(window)

    def drain(self) -> None:
        """Emit all that is open as full windows and a tail of powers of two."""
        pieces = [piece for _, window in self.free for piece in self.held.pop(window)]
        self.free, tail = [], sum(len(piece[2]) for piece in pieces)
        room, now = 0, []
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = self.length if tail >= self.length else 1 << (tail.bit_length() - 1)
                    tail, now = tail - room, []
                cut = ids[:room]
                now.append((doc_id, start, cut, total))
                room, start, ids = room - len(cut), start + len(cut), ids[len(cut) :]
                if not room:
                    self.emit(self.opened(now))

    def rows(self, base: int, part: int, keep_ids: bool) -> Iterator[tuple]:
        for window, pieces in self.done:
            yield from window_rows(pieces, base + window, part, False, keep_ids)
        self.done = []

    def left(self, base: int, part: int) -> Iterator[tuple]:
        for _, window in self.free:
            yield from window_rows(self.held[window], base + window, part, True, True)


def window_rows(pieces: list[tuple], sequence: int, part: int, is_open: bool, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in pieces:
        content = np.ascontiguousarray(ids, "<u4").tobytes()
        kept = content if keep_ids else None
        yield doc_id, start, len(ids), zlib.crc32(content), total, sequence, offset, part, is_open, kept
        offset += len(ids)


def packed_batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 7, pa.bool_(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
    end: int = END, open_windows: int = OPEN, keep_ids: bool = True,
) -> DataFrame:
    """Pack all rows into sequences of at most ``length`` ids; one row per piece of a document.

    A document's ids are those of its text (null: none) and the ``end`` id. Columns: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` (little-endian unsigned 32-bit)
    unless ``keep_ids`` is off. Each id lies in one piece; offsets in a sequence are gapless from
    0. A sequence whose length is no power of two is to be padded to ``length``. Rows with the same
    or a null id are packed as documents of their own; an empty table gives no pieces. A long text
    is encoded whole, one at a time in a task, and cut into as many pieces as it needs.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = StructType([source.schema["doc_id"], *StructType.fromDDL(PIECES).fields])
    names = schema.names

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, base, id_type = Packer(length, open_windows), part << 32, None
        tail = np.array([end], np.uint32)
        for batch in small(batches):
            id_type = batch.column(0).type
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                ids = np.concatenate([ids, tail])
                packer.put(doc_id, 0, ids, len(ids))
                held += len(ids)
                if held > 1 << 20:
                    rows += packer.rows(base, part, keep_ids)
                    if rows:
                        yield packed_batch(rows, names, id_type)
                    rows, held = [], 0
            rows += packer.rows(base, part, keep_ids)
            if rows:
                yield packed_batch(rows, names, id_type)
        if rows := list(packer.left(base, part)):
            yield packed_batch(rows, names, id_type)

    pieces = written(source.mapInArrow(first_pass, schema))
    finished = [pieces.where("not open")]
    parts, level = pieces.agg(F.max("part")).first()[0], 0
    while parts is not None:
        level += 1
        pieces = written(merge(pieces.where("open"), schema, length, open_windows, keep_ids, level, parts < FAN_IN))
        finished.append(pieces.where("not open"))
        parts = pieces.where("open").agg(F.max("part")).first()[0]
    out = finished[0]
    for more in finished[1:]:
        out = out.union(more)
    return out.drop("part", "open", *([] if keep_ids else ["ids"]))


def merge(
    pieces: DataFrame, schema: StructType, length: int, number: int, keep_ids: bool, level: int, last: bool
) -> DataFrame:
    """Pack the open windows of ``FAN_IN`` parts in one task; the last round leaves none open."""
    names = schema.names

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, id_type = Packer(length, number), None, None

        def closed() -> list[tuple]:
            if last:
                packer.drain()
            base = (level << 56) + (group << 32)
            return [*packer.rows(base, group, keep_ids), *packer.left(base, group)]

        for batch in small(batches):
            id_type = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[-1] != group:
                    if group is not None and (rows := closed()):
                        yield packed_batch(rows, names, id_type)
                    packer, group = Packer(length, number), row[-1]
                packer.put(row[0], row[1], np.frombuffer(row[9], "<u4"), row[4])
                if len(packer.done) > 1000:
                    yield packed_batch(list(packer.rows((level << 56) + (group << 32), group, keep_ids)), names, id_type)
        if group is not None and (rows := closed()):
            yield packed_batch(rows, names, id_type)

    grouped = pieces.withColumn("group", F.floor(F.col("part") / FAN_IN))
    placed = grouped.repartition("group").sortWithinPartitions("group", "part", "sequence_id", "offset")
    return placed.mapInArrow(merged, schema)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their ids, so the sequences can be rebuilt."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
