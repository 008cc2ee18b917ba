"""Training-order materialisation: every sequence has a global slot, shards hold slots in order.

A keyed Feistel network permutes the smallest domain of an even number of bits that holds all
sequences; walking its cycle until the value is below their number makes it a permutation of
exactly those, so neither a sort nor a table is needed for the shuffle. Sequences go to the task
of their shard by slot, which writes records of one fixed size: a reader finds slot ``s`` in shard
``s // per_shard`` at byte ``(s % per_shard) * stride`` and can go on from any slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.lineage import ensure_checkpoint_dir
from tillwise.llm.tokens import encoder
from tillwise.llm.words import mixed, small

# Parameters.
LENGTH = 256
PER_SHARD = 16384
KEY = 20260101
ROUNDS = 6
END = 1
#: A record: number of ids, part (its highest bit set where doc_id is null), doc_id, then the ids.
HEAD = np.dtype([("count", "<u4"), ("part", "<u4"), ("doc_id", "<i8")])
NULL_ID = 1 << 31


class Layout(NamedTuple):
    """Where the shards are and how they are laid out; all a reader needs."""

    folder: str
    total: int
    length: int
    per_shard: int

    @property
    def record(self) -> np.dtype:
        return np.dtype([("head", HEAD), ("ids", "<u2", (self.length,))])

    @property
    def shards(self) -> int:
        return -(-self.total // self.per_shard)

    def shard_path(self, shard: int) -> str:
        return f"{self.folder}/shard-{shard:08d}.bin"


def slots(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slot of each index in [0, total): a keyed permutation of these numbers."""
    half = np.uint64(max(1, ((total - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64))

    def network(values: np.ndarray) -> np.ndarray:
        left, right = values >> half, values & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << half) | right

    out = network(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(total))).size:
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def file_system(folder: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def sequence_counts(docs: DataFrame, tokenizer: str, length: int) -> dict[int, int]:
    """How many sequences each partition of (doc_id, text) makes: one number per partition."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = 0
        for batch in small(batches):
            made += sum(-(-(count + 1) // length) for count in encoder(tokenizer).counts(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), pa.array([made])], names=["part", "made"]
        )

    return {row["part"]: row["made"] for row in docs.mapInArrow(counted, "part bigint, made bigint").collect()}


def placed_sequences(docs: DataFrame, tokenizer: str, length: int, counts: dict[int, int], key: int) -> DataFrame:
    """(slot, doc_id, part, ids) per sequence; the slots of a partition follow from the counts before it."""
    firsts, total = {}, 0
    for part, made in sorted(counts.items()):
        firsts[part], total = total, total + made

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        at, tail = firsts.get(task, 0), np.array([END], "<u2")
        last = at + counts.get(task, 0)
        for batch in small(batches):
            owners: list = []
            parts: list[int] = []
            cut: list[bytes] = []

            def rows() -> pa.RecordBatch:
                nonlocal at
                if at + len(cut) > last:
                    raise RuntimeError("the table changed between counting and writing")
                slot = slots(np.arange(at, at + len(cut)), total, key)
                at += len(cut)
                columns = [pa.array(slot), pa.array(owners, pa.int64()), pa.array(parts, pa.int32()), pa.array(cut, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["slot", "doc_id", "part", "ids"])

            for owner, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id of the tokenizer does not fit into 16 bits")
                content = np.concatenate([ids.astype("<u2"), tail]).tobytes()
                for part, first in enumerate(range(0, len(content), 2 * length)):
                    owners.append(owner)
                    parts.append(part)
                    cut.append(content[first : first + 2 * length])
                if len(cut) > 20_000:
                    yield rows()
                    owners, parts, cut = [], [], []
            if cut:
                yield rows()
        if at != last:
            raise RuntimeError("the table changed between counting and writing")

    return docs.mapInArrow(placed, "slot bigint, doc_id bigint, part int, ids binary")


def write_shards(sequences: DataFrame, layout: Layout) -> DataFrame:
    """Write (slot, doc_id, part, ids) as shards; one row per shard (shard, records).

    A shard is written under a name of its own attempt and then renamed, so a task that runs
    again, or twice, leaves the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = file_system(layout.folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, records = None, None

        def close() -> pa.RecordBatch:
            target = layout.shard_path(shard).replace(layout.folder, folder, 1)
            with store.open_output_stream(f"{target}.{attempt}") as out:
                out.write(records.tobytes())
            store.move(f"{target}.{attempt}", target)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(records)])], names=["shard", "records"])

        for batch in small(batches):
            for slot, owner, part, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot // layout.per_shard != shard:
                    if shard is not None:
                        yield close()
                    shard = slot // layout.per_shard
                    size = min(layout.per_shard, layout.total - shard * layout.per_shard)
                    records = np.zeros(size, layout.record)
                record = records[slot - shard * layout.per_shard]
                record["head"] = (len(ids) // 2, part | (NULL_ID if owner is None else 0), owner or 0)
                record["ids"][: len(ids) // 2] = np.frombuffer(ids, "<u2")
        if shard is not None:
            yield close()

    store, folder = file_system(layout.folder)
    store.create_dir(folder, recursive=True)
    shard = F.floor(F.col("slot") / layout.per_shard).cast("int")
    placed = sequences.repartitionById(max(1, layout.shards), shard).sortWithinPartitions("slot")
    return placed.mapInArrow(write, "shard bigint, records bigint")


def read_slots(spark: SparkSession, layout: Layout, first: int = 0, last: int | None = None) -> DataFrame:
    """(slot, doc_id, part, ids) of the slots [first, last), each shard read in sequence by one task."""
    last = layout.total if last is None else min(last, layout.total)
    begin, end = first // layout.per_shard, -(-last // layout.per_shard)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(layout.folder)
        for batch in small(batches):
            for shard in batch.column(0).to_pylist():
                base = shard * layout.per_shard
                low, high = max(first, base), min(last, base + layout.per_shard)
                if low >= high:
                    continue
                with store.open_input_file(layout.shard_path(shard).replace(layout.folder, folder, 1)) as source:
                    source.seek((low - base) * layout.record.itemsize)
                    records = np.frombuffer(source.read((high - low) * layout.record.itemsize), layout.record)
                head = records["head"]
                null = (head["part"] & NULL_ID) > 0
                ids = [row[:n].tobytes() for row, n in zip(records["ids"], head["count"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(low, high)),
                        pa.array(head["doc_id"], mask=null),
                        pa.array((head["part"] & (NULL_ID - 1)).astype(np.int32)),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["slot", "doc_id", "part", "ids"],
                )

    wanted = spark.range(begin, max(begin, end), 1, max(1, end - begin))
    return wanted.mapInArrow(read, "slot bigint, doc_id bigint, part int, ids binary")


def materialise(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
    per_shard: int = PER_SHARD, key: int = KEY, folder: str | None = None,
) -> Layout:
    """Write the ids of all texts in training order; returns what ``read_slots`` needs.

    A text (null: empty) is its ids and the end id, cut into sequences of ``length``; the last of a
    text is padded with zeros. Each gets the slot of its number in the table's own order, so the
    table must give the same rows in the same partitions twice, as files do (checked); ids are
    below 65,536. Rows that repeat or lack an id are sequences of their own. An empty table has no
    shards.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = sequence_counts(source, tokenizer, length)
    folder = folder or f"{ensure_checkpoint_dir(spark)}/slots-{uuid.uuid4().hex}"
    layout = Layout(folder, sum(counts.values()), length, per_shard)
    if layout.total:
        sequences = placed_sequences(source, tokenizer, length, counts, key)
        done = write_shards(sequences, layout).agg(F.sum("records").alias("records")).first()["records"]
        if done != layout.total:
            raise RuntimeError(f"{done} of {layout.total} sequences were written")
    return layout


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, n_ids, ids_crc32, slot, shard) of every sequence, read back from the shards."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    layout = materialise(docs, public_tokenizers.path("word_bpe_49k.json"))
    found = read_slots(spark, layout)
    return found.select(
        "doc_id",
        "part",
        (F.octet_length("ids") / 2).cast("bigint").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        "slot",
        F.floor(F.col("slot") / layout.per_shard).alias("shard"),
    )


QUERIES = {"op2_training_order": op2_training_order}
ORACLES: dict[str, str] = {}
