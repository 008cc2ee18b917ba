"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition takes the fingerprints of its texts, as many bits as the number of rows asks
   for, sorts them and sends each owner of a range of fingerprints one list of Golomb-coded gaps.
2. Owners decode the lists and answer each with a bitmap: which of its fingerprints occur in
   another list too.
3. A partition looks its rows up in the bitmaps. Rows whose fingerprint nobody else has are done.
   The texts of the others (suspects) are read from the table again and grouped by their bytes.

Only suspects' texts are shuffled, after copies within a task were counted, so a text that a third
of all rows hold is a row per task. A fingerprint that two texts share costs a comparison and
changes no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillwise.functions.lineage import ensure_checkpoint_dir, written
from tillwise.llm.ordering import file_system
from tillwise.llm.words import small

# Parameters.
SPARE_BITS = 16  # bits beyond the number of rows: one foreign fingerprint in 2**16 looks like a copy
OWNER_ROWS = 1 << 22  # fingerprints that one owner decodes at most, on average
HOT_SHARE = 1000  # groups with more than a thousandth of all rows are broadcast: fewer than 1,000


class Coded(NamedTuple):
    """Sorted distinct values as gaps: quotients in unary, remainders of ``shift`` bits."""

    count: int
    shift: int
    quotients: bytes
    remainders: bytes


def golomb(values: np.ndarray, width: int) -> Coded:
    """Code sorted distinct values below 2**width (Golomb code with a power of two as divisor)."""
    count = len(values)
    shift = max(0, int(np.log2(2.0**width / count))) if count else 0
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if count else 0, np.uint8)
    unary[ends - 1] = 1
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return Coded(count, shift, np.packbits(unary).tobytes(), np.packbits(rest).tobytes())


def decoded(code: Coded) -> np.ndarray:
    unary = np.unpackbits(np.frombuffer(code.quotients, np.uint8))
    ends = np.flatnonzero(unary)[: code.count]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(code.remainders, np.uint8))[: code.count * code.shift]
    weights = np.uint64(1) << np.arange(code.shift - 1, -1, -1, dtype=np.uint64)
    rest = bits.reshape(code.count, code.shift).astype(np.uint64) @ weights
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(code.shift)) + rest, dtype=np.uint64)


class Sizes(NamedTuple):
    bits: int  # of a fingerprint
    owner_bits: int  # its highest bits name the owner

    @classmethod
    def of(cls, rows: int, tasks: int) -> Sizes:
        owners = max(1, tasks, -(-rows // OWNER_ROWS))
        owner_bits = (owners - 1).bit_length()
        return cls(min(63, max(owner_bits + 1, rows.bit_length() + SPARE_BITS)), owner_bits)


def numbered(docs: DataFrame) -> Column:
    """The row's partition (times 2**33) and place in it: the same whenever the table is read."""
    return F.monotonically_increasing_id()


def fingerprint_lists(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """The rows (row, id, hash, digest) with the owner, place and copies of their fingerprint, and
    one row per list: (part, owner, count, shift, quotients, remainders), its id columns null.

    A task holds the narrow rows of its partition, no texts.
    """
    listed = "part bigint, owner int, place int, twice boolean, count int, shift int, quotients binary, remainders binary"
    own = [StructField(f.name, f.dataType) for f in rows.schema.fields]  # null in the rows of lists
    schema = StructType([*own, *StructType.fromDDL(listed).fields])
    low = sizes.bits - sizes.owner_bits

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in small(batches) if batch.num_rows]
        if not held:
            return
        part = held[0].column(0)[0].as_py() >> 33
        types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        hashes = np.concatenate([b.column(2).to_numpy() for b in held]).view(np.uint64)
        values, which, copies = np.unique(
            hashes >> np.uint64(64 - sizes.bits), return_inverse=True, return_counts=True
        )
        owners = (values >> np.uint64(low)).astype(np.int32)
        firsts = np.searchsorted(owners, owners)
        places = (np.arange(len(values)) - firsts).astype(np.int32)
        first = 0
        for batch in held:
            mine = which[first : first + batch.num_rows]
            first += batch.num_rows
            known = [np.full(len(mine), part), owners[mine], places[mine], copies[mine] > 1]
            columns = [pa.array(c, t) for c, t in zip(known, types, strict=False)]
            columns += [pa.nulls(len(mine), t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)
        del held
        for owner in np.unique(owners).tolist():
            inside = values[np.searchsorted(owners, owner) : np.searchsorted(owners, owner, "right")]
            code = golomb(inside & np.uint64((1 << low) - 1), low)
            filled = [part, owner, None, None, *code]
            columns = [pa.array([v], t) for v, t in zip(filled, types, strict=True)]
            empty = [pa.nulls(1, c.type) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*empty, *columns], names=schema.names)

    return rows.mapInArrow(coded, schema)


def answers(lists: DataFrame, sizes: Sizes) -> DataFrame:
    """(part, owner, bitmap): which fingerprints of a list are in another list of the owner too."""
    names = ["part", "owner", "bitmap"]

    def answered(held: list[tuple]) -> pa.RecordBatch:
        values = [decoded(Coded(*row[2:])) for row in held]
        _, which, lists_with = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = lists_with[which] > 1
        bounds = np.cumsum([len(v) for v in values])[:-1]
        bitmaps = [np.packbits(piece).tobytes() for piece in np.split(shared, bounds)]
        columns = [
            pa.array([row[0] for row in held], pa.int64()),
            pa.array([row[1] for row in held], pa.int32()),
            pa.array(bitmaps, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][1] != row[1]:
                    yield answered(held)
                    held = []
                held.append(row)
        if held:
            yield answered(held)

    sent = lists.select("part", "owner", "count", "shift", "quotients", "remainders")
    placed = sent.repartitionById(1 << sizes.owner_bits, F.col("owner")).sortWithinPartitions("owner")
    return placed.mapInArrow(owned, "part bigint, owner int, bitmap binary")


def marked_rows(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """The rows with ``suspect``: another row may have the same text."""
    both = written(fingerprint_lists(rows, sizes))
    lists, own = both.where("count is not null"), both.where("count is null")
    eight = F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))
    byte = F.conv(F.hex(eight), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, 7 - place % 8) & 1")
    joined = own.join(answers(lists, sizes), ["part", "owner"]).withColumn("_byte", byte)
    return joined.select(*rows.columns, "part", (F.col("twice") | (bit == 1)).alias("suspect"))


def picked(docs: DataFrame, content: Column, folder: str, wanted: bool) -> DataFrame:
    """The rows of the table that are listed in the folder, or all but those.

    The folder has (row, hash) by part. The table must give the same rows in the same partitions
    again, as files do; a difference is an error.
    """
    out = docs.schema
    names = [f"c{k}" for k in range(len(out))] + ["row", "hash"]  # the table's own may clash
    table = docs.select(*docs.columns, numbered(docs), F.xxhash64(content)).toDF(*names)

    def listed(part: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = file_system(folder)
        found = store.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
        files = [f.path for f in found if f.is_file and f.path.endswith(".parquet")]
        tables = [pq.read_table(path, filesystem=store, partitioning=None) for path in files]
        if not tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every = pa.concat_tables(tables)
        rows, hashes = every["row"].to_numpy(), every["hash"].to_numpy()
        order = np.argsort(rows)
        return rows[order], hashes[order]

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = hashes = None
        met = 0
        for batch in small(batches):
            if not batch.num_rows:
                continue
            here, texts = (column.to_numpy() for column in batch.columns[-2:])
            if rows is None:
                rows, hashes = listed(int(here[0]) >> 33)
            spots = np.searchsorted(rows, here)
            inside = spots < len(rows)
            inside[inside] = rows[spots[inside]] == here[inside]
            if (hashes[spots[inside]] != texts[inside]).any():
                raise RuntimeError("the table changed between two readings")
            met += int(inside.sum())
            mask = pa.array(inside if wanted else ~inside)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:-2]], names=out.names)
        if rows is not None and met != len(rows):
            raise RuntimeError("the table changed between two readings")

    return table.mapInArrow(filtered, out)


def listed_by_part(rows: DataFrame) -> str:
    """Write (part, row, hash) to a folder of the shared one, a folder per part; returns its name."""
    folder = f"{ensure_checkpoint_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.select("part", "row", "hash").repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def judged(docs: DataFrame, identifier: Column, content: Column) -> DataFrame:
    """(part, row, id, hash, digest, keep_id, group_size, kept) of every row; see ``exact_duplicates``."""
    spark = docs.sparkSession
    count = docs.count()
    sizes = Sizes.of(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        numbered(docs).alias("row"),
        identifier.alias("id"),
        F.xxhash64(content).alias("hash"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    )
    marked = written(marked_rows(rows, sizes))
    suspects = marked.where("suspect")
    texts = docs.select(numbered(docs).alias("row"), identifier.alias("id"), content.alias("text"))
    again = picked(texts, F.col("text"), listed_by_part(suspects), True)
    groups = written(
        again.groupBy(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
        .select("digest", "group_size", "keep")
    )
    hot = F.broadcast(groups.where(F.col("group_size") > count // HOT_SHARE))
    cold = groups.where(F.col("group_size") <= count // HOT_SHARE)
    grouped = suspects.join(hot, "digest").unionByName(suspects.join(hot, "digest", "left_anti").join(cold, "digest"))
    columns = ["part", "row", "id", "hash", "digest"]
    alone = marked.where("not suspect").select(
        *columns, F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")
    )
    copies = grouped.select(
        *columns, F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept")
    )
    return alone.unionByName(copies)


def same(text: Column) -> Column:
    return text


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = same
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when their bytes are after ``normalise``; null counts as empty, and empty texts
    are one group. Of a group the row with the largest id stays. Where rows repeat that id, or all
    ids of a group are null, the last of them in the table stays, so one row of each group does.
    Texts of any length are compared whole, one at a time in a task. Other columns are not read.
    The table must give the same rows in the same partitions twice, as files do (checked). An
    empty table gives no rows.
    """
    content = F.coalesce(normalise(F.col(f"`{text}`")), F.lit(""))
    found = judged(docs, F.col(f"`{id_column}`"), content)
    return found.select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = same
) -> DataFrame:
    """The rows that stay, with all their columns; only lists of the others move."""
    content = F.coalesce(normalise(F.col(f"`{text}`")), F.lit(""))
    found = judged(docs, F.col(f"`{id_column}`"), content)
    return picked(docs, content, listed_by_part(found.where("not kept")), False)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs)


SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS (SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size
  FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM sized
"""

QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLES = {"op13_exact_dedup": SQL}
