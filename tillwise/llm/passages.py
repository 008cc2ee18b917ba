"""Suffix-array dedup: passages of fifty words and more that occur again are cut.

A sparse suffix array: of every window of ``SPAN`` starts of ``GRAM``-word grams the least hash is
kept, so each passage of ``GRAM + SPAN - 1`` = ``LEAST`` words, wherever it stands, keeps the same
suffix. Suffixes whose gram occurs once are dropped, and with them every passage that cannot occur
again. The others are range-sorted by their words: the gram, the words after it, then those before
it, read backwards. Every suffix is compared with its neighbours above and below, and the match is
extended word by word to the right and to the left. Passages within the match with a neighbour from
an earlier place are cut. No suffix has more words on the right in common with any other than with
a neighbour, so passages that reach further to the right than this cannot occur again.

What is left open then, passages that a neighbour from a later place or with other words on the left
hides, goes to an exact pass: sorted by gram and all words, then by place, all but the first are cut.
The first place of a passage is never found by a neighbour, so it is in the exact pass if any later
place is. So a word is cut if and only if it is in a passage that stands at an earlier place.

Both passes are streams in range partitions; a gram or passage with a third of all rows is spread
over many. At the borders of partitions the first pass leaves open what it cannot see; of the exact
pass two rows per partition are sorted again until one task holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwise.functions.lineage import written
from tillwise.llm.hot import join_by_size
from tillwise.llm.quality import free_prefix
from tillwise.llm.texts import packed_texts, unpacked
from tillwise.llm.words import MIX_A, MIX_B, mixed, slices, small, windows, words_of

# Parameters: least words of a passage, words of a gram; every SPAN grams in a row keep one.
LEAST = 50
GRAM = 25
SPAN = LEAST - GRAM + 1
#: Bytes kept of the hash of a neighbouring word.
CODE = 5
#: Passages at the borders of partitions that one task sorts.
BORDER_ROWS = 50_000

SORTED = ["key", "right", "left", "doc_id", "place"]
KEY = ["key", "window", "doc_id", "place"]


def tag_of(text: Column) -> Column:
    """31 bits of a text, which tell rows with the same id apart."""
    return F.crc32(text).bitwiseAND(F.lit(0x7FFFFFFF))


def kept_suffixes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each passage of ``LEAST`` words, first word of the suffix it keeps, and all gram hashes.

    Words are counted through the texts; a passage stays within its text.
    """
    grams = windows(hashes, GRAM)
    starts = len(grams) - SPAN + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    least = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(axis=1) + np.arange(starts)
    owner = owners(bounds)
    whole = np.flatnonzero(owner[:starts] == owner[LEAST - 1 : LEAST - 1 + starts])
    return whole, least[whole], grams


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, place) of the kept suffixes of (doc_id, text); place is tag and first word."""
    schema = StructType([*StructType.fromDDL("key bigint").fields, docs.schema["doc_id"], *StructType.fromDDL("place bigint").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for first, piece in slices(batch.column(1)):
                words = words_of(piece)
                _, least, grams = kept_suffixes(words.hashes, words.bounds)
                here = np.unique(least)
                text, key = owners(words.bounds)[here], grams[here]
                at = here - words.bounds[text]
                content, cuts = words.data.tobytes(), words.texts.tolist()
                tags = np.array([zlib.crc32(content[a:b]) & 0x7FFFFFFF for a, b in zip(cuts, cuts[1:], strict=False)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(text + first)), pa.array((tags[text] << 32) | at)],
                    names=schema.names,
                )

    return docs.mapInArrow(rows, schema)


def word_codes(hashes: np.ndarray, at: np.ndarray, step: int, bounds: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """``SPAN`` - 1 words from each place on, forwards or backwards, as bytes of their hashes; zeros beyond the text."""
    places = at[:, None] + step * np.arange(SPAN - 1)
    inside = (places >= bounds[0][:, None]) & (places < bounds[1][:, None])
    codes = np.where(inside, hashes[np.where(inside, places, 0)], np.uint64(0)) if len(hashes) else np.zeros(places.shape, np.uint64)
    content = np.ascontiguousarray(codes.astype(">u8")).view(np.uint8).reshape(len(at), SPAN - 1, 8)[:, :, :CODE]
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary((SPAN - 1) * CODE), len(at), [None, pa.py_buffer(np.ascontiguousarray(content))]
    ).cast(pa.binary())


def contexts(found: DataFrame) -> DataFrame:
    """The suffixes of (doc_id, tag, text, places) with the words right of the gram and left of it, backwards.

    ``low`` to ``high`` are the numbers of words that the passages keeping a suffix have left of it.
    """
    schema = StructType(
        [
            *StructType.fromDDL("key bigint, `right` binary, `left` binary").fields,
            found.schema["doc_id"],
            *StructType.fromDDL("place bigint, low int, high int").fields,
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = unpacked(batch.column(2))
            ids, places = batch.column(0), batch.column(3)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for first, piece in slices(texts):
                words = words_of(piece)
                asked = np.zeros(len(words.hashes), bool)
                for k in range(len(piece)):
                    asked[places[first + k].values.to_numpy(zero_copy_only=False) + words.bounds[k]] = True
                starts, least, grams = kept_suffixes(words.hashes, words.bounds)
                here, begins, counts = np.unique(least, return_index=True, return_counts=True)
                mine = asked[here]
                here, begins, counts = here[mine], begins[mine], counts[mine]
                if not len(here):
                    continue
                text = owners(words.bounds)[here]
                limits = words.bounds[text], words.bounds[text + 1]
                high = here - starts[begins]  # the passages that keep a suffix start one after the other
                columns = [
                    pa.array(grams[here].view(np.int64)),
                    word_codes(words.hashes, here + GRAM, 1, limits),
                    word_codes(words.hashes, here - 1, -1, limits),
                    ids.take(pa.array(first + text)),
                    pa.array((tags[first + text] << 32) | (here - limits[0])),
                    pa.array((high - counts + 1).astype(np.int32)),
                    pa.array(high.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.select("doc_id", "tag", "text", "places").mapInArrow(rows, schema)


def codes_of(column: pa.Array) -> np.ndarray:
    """(row, word, byte) of a column of word codes."""
    content = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return content.reshape(len(column), SPAN - 1, CODE)


def common_words(codes: np.ndarray) -> np.ndarray:
    """How many words each row shares with the next one, from the first on."""
    same = (codes[1:] == codes[:-1]).all(axis=2)
    return np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)


def earlier_than(ids: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row stands before the next one, and after it; null ids come first."""
    one, other = ids.slice(0, len(ids) - 1), ids.slice(1)
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    none, following = nulls[:-1], nulls[1:]
    less = pc.less(one, other).fill_null(False).to_numpy(zero_copy_only=False) | (none & ~following)
    more = pc.greater(one, other).fill_null(False).to_numpy(zero_copy_only=False) | (following & ~none)
    tie = ~less & ~more
    return less | (tie & (place[:-1] < place[1:])), more | (tie & (place[:-1] > place[1:]))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the first 0, 1, ... words of each row."""
    padded = np.zeros((*codes.shape[:2], 8), np.uint8)
    padded[:, :, :CODE] = codes
    words = padded.view("<u8")[:, :, 0]
    out = np.zeros((len(words), SPAN), np.uint64)
    for k in range(SPAN - 1):
        out[:, k + 1] = mixed(out[:, k] * np.uint64(MIX_A) + words[:, k] + np.uint64(k + 1))
    return out


def compared(sorted_rows: DataFrame) -> DataFrame:
    """Suffixes in the order of ``SORTED`` against their neighbours.

    Rows (doc_id, tag, first, last): passages to be cut begin at these words. Rows (key, window,
    doc_id, place): passages left open, ``window`` hashes their words beside the gram.
    """
    schema = StructType(
        [
            sorted_rows.schema["doc_id"],
            *StructType.fromDDL("tag bigint, first int, last int, key bigint, window bigint, place bigint").fields,
        ]
    )
    right_all = SPAN - 1

    def judged(line: pa.RecordBatch, begin: int, end: int, opening: bool, closing: bool) -> Iterator[pa.RecordBatch]:
        """The rows [begin, end) of the line; the others are only neighbours."""
        key, place, low, high = (line.column(k).to_numpy() for k in (0, 4, 5, 6))
        right, left = codes_of(line.column(1)), codes_of(line.column(2))
        same = key[1:] == key[:-1]
        to_right = np.where(same, common_words(right), -1)
        to_left = np.where(same, common_words(left), -1)
        before, after = earlier_than(line.column(3), place)
        reach = np.full(len(key), -1)
        reach[1:] = to_right
        reach[:-1] = np.maximum(reach[:-1], to_right)
        if opening:
            reach[0] = right_all
        if closing:
            reach[-1] = right_all
        # Words to the left of the passages that may occur again, and of those that a neighbour holds.
        least = np.maximum(low, right_all - reach)
        found = []
        for step, is_earlier in ((1, before), (-1, after)):  # the neighbour above, then the one below
            a, b = np.zeros(len(key), np.int64), np.full(len(key), -1)
            mine = slice(1, None) if step == 1 else slice(0, -1)
            usable = is_earlier & same
            a[mine] = np.where(usable, np.maximum(low[mine], right_all - to_right), 0)
            b[mine] = np.where(usable, np.minimum(high[mine], to_left), -1)
            found.append((a, b))
        spot = np.arange(SPAN)
        covered = np.zeros((len(key), SPAN), bool)
        for a, b in found:
            covered |= (spot >= a[:, None]) & (spot <= b[:, None])
        inside = np.zeros(len(key), bool)
        inside[begin:end] = True
        at = place & 0xFFFFFFFF
        for a, b in found:
            rows = np.flatnonzero(inside & (a <= b))
            if len(rows):
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        line.column(3).take(pa.array(rows)), pa.array(place[rows] >> 32), pa.array((at - b)[rows].astype(np.int32)),
                        pa.array((at - a)[rows].astype(np.int32)), none, none, none,
                    ],
                    names=schema.names,
                )
        left_open = (spot >= least[:, None]) & (spot <= high[:, None]) & ~covered & inside[:, None]
        rows, words = np.nonzero(left_open)
        if len(rows):
            some, which = np.unique(rows, return_inverse=True)
            whole = prefix_hashes(left[some])[which, words] * np.uint64(MIX_B)
            whole = mixed(whole ^ (prefix_hashes(right[some])[which, right_all - words] + words.astype(np.uint64)))
            none = pa.nulls(len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    line.column(3).take(pa.array(rows)), none.cast(pa.int64()), none, none, pa.array(key[rows]),
                    pa.array(whole.view(np.int64)), pa.array(place[rows] - words),
                ],
                names=schema.names,
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, not judged yet, and the one before it
        first = True
        for batch in small(batches):
            if not batch.num_rows:
                continue
            line = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            begin = 0 if held is None else held.num_rows - 1
            if line.num_rows - 1 > begin:
                yield from judged(line, begin, line.num_rows - 1, first and begin == 0, False)
                first = False
            held = line.slice(max(0, line.num_rows - 2))
        if held is not None:
            yield from judged(held, held.num_rows - 1, held.num_rows, first and held.num_rows == 1, True)

    return sorted_rows.select(*SORTED, "low", "high").mapInArrow(rows, schema)


def later_places(sorted_rows: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, tag, first, last): first words of passages to be cut, and the rows (key set) to be sorted again.

    ``whole``: all rows are in this one partition, so none is left over.
    """
    schema = StructType(
        [
            sorted_rows.schema["doc_id"],
            *StructType.fromDDL("tag bigint, first int, last int, key bigint, window bigint, place bigint").fields,
        ]
    )

    def packed(rows: pa.RecordBatch, cut: bool) -> pa.RecordBatch:
        place = rows.column(3).to_numpy()
        none = pa.nulls(len(place), pa.int64())
        if cut:
            at = pa.array((place & 0xFFFFFFFF).astype(np.int32))
            columns = [pa.array(place >> 32), at, at, none, none, none]
        else:
            columns = [none, none.cast(pa.int32()), none.cast(pa.int32()), rows.column(0), rows.column(1), rows.column(3)]
        return pa.RecordBatch.from_arrays([rows.column(2), *columns], names=schema.names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, leader = None, None  # first row of the partition, and of the passage the last batch ended in
        for batch in small(batches):
            if not batch.num_rows:
                continue
            if leader is None:
                opening = leader = batch.slice(0, 1)
            line = pa.Table.from_batches([leader, batch]).combine_chunks().to_batches()[0]
            key, window, place = (line.column(i).to_numpy() for i in (0, 1, 3))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            ids = line.column(2).dictionary_encode("encode").indices.to_numpy()
            later = (place != place[head]) | (ids != ids[head])  # not a repeated row
            if later.any():
                yield packed(line.take(pa.array(np.flatnonzero(later))), True)
            leader = line.slice(int(head[-1]), 1)
        if leader is not None and not whole:
            yield packed(opening, False)
            yield packed(leader, False)

    return sorted_rows.select(*KEY).mapInArrow(rows, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, starts): spans of first words of the passages to be cut from (doc_id, text), text not null."""
    kept = written(suffixes(docs))
    again = written(kept.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    places = (
        join_by_size(kept, again, ["key"], F.col("_n"), kept.count())
        .groupBy("doc_id", F.shiftright("place", 32).alias("tag"))
        .agg(F.collect_set(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("places"))
    )
    texts = packed_texts(docs, "text", "tag")
    renamed = places.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    found = texts.join(renamed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    first_pass = written(compared(contexts(found).orderBy(*SORTED)))
    cuts = first_pass.where("key is null").select("doc_id", "tag", "first", "last")
    for result in exact_pass(first_pass.where("key is not null").select(*KEY)):
        cuts = cuts.union(result.where("key is null").select("doc_id", "tag", "first", "last"))
    return cuts.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("starts"))


def exact_pass(passages: DataFrame) -> Iterator[DataFrame]:
    """``later_places`` of passages in any order, in rounds of ever fewer rows at borders."""
    result, parts = written(later_places(passages.orderBy(*KEY), False)), 1 << 30
    yield result
    while left := result.where("key is not null").count():
        rest = result.where("key is not null").select(*KEY)
        parts = min(parts // 2, left // BORDER_ROWS)
        if parts <= 1:
            yield later_places(rest.coalesce(1).sortWithinPartitions(*KEY), True)
            return
        result = written(later_places(rest.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY), False))
        yield result


def merged_spans(starts: list[dict] | None) -> list[tuple[int, int]]:
    """The words [first, last) of passages whose first words are these spans."""
    if not starts:
        return []
    spans = np.array([(s["first"], s["last"] + LEAST) for s in starts], np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    apart = np.flatnonzero(spans[1:, 0] > ends[:-1])
    first, last = spans[np.append(0, apart + 1), 0], ends[np.append(apart, len(ends) - 1)]
    return list(zip(first.tolist(), last.tolist(), strict=True))


def cut_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """Every row with its repeated passages cut from the text.

    A passage of ``LEAST`` words or more (runs between blanks, compared as they are) that stands
    at an earlier place, by rising id (null first) and place in the text, is cut with the blanks
    that follow it. Added, named with ``prefix``: n_words, cut_words (counts) and spans (first word
    and the one after the last, in the uncut text); columns of these names are replaced. A null
    text has no words and stays null. Rows that repeat an id and a text are treated alike; rows
    that share only the id are told apart by their texts. An empty table gives an empty one.
    """
    added = [prefix + name for name in ("n_words", "cut_words", "spans")]
    keep = [c for c in docs.columns if c not in added]
    source = docs.select(*[f"`{c}`" for c in keep])
    base = source.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = free_prefix(keep, "_cut_")
    starts = repeated_passages(base).withColumnsRenamed({name: own + "of_" + name for name in ("doc_id", "tag", "starts")})
    whole = packed_texts(source.withColumn(own + "null", F.col(f"`{text}`").isNull()), text, own + "tag")
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(own + "of_doc_id")) & (F.col(own + "tag") == F.col(own + "of_tag"))
    joined = whole.join(starts, same, "left").drop(own + "tag", own + "of_doc_id", own + "of_tag")
    schema = StructType(
        [
            *source.schema.fields,
            *StructType.fromDDL(
                f"`{added[0]}` bigint, `{added[1]}` bigint, `{added[2]}` array<struct<first: bigint, last: bigint>>"
            ).fields,
        ]
    )
    at = keep.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, lists = unpacked(batch.column(at)), batch.column(len(keep) + 1).to_pylist()
            nulls = batch.column(len(keep)).to_pylist()
            done: list[str | None] = []
            counts, cuts, kept_spans = [], [], []
            for first, piece in slices(texts):
                words = words_of(piece)
                content = words.data.tobytes()
                for k in range(len(piece)):
                    low, high = int(words.bounds[k]), int(words.bounds[k + 1])
                    begin, end = int(words.texts[k]), int(words.texts[k + 1])
                    gone = merged_spans(lists[first + k])
                    parts, now = [], begin
                    for a, b in gone:
                        parts.append(content[now : int(words.starts[low + a])])
                        now = int(words.starts[low + b]) if low + b < high else int(words.ends[high - 1])
                    parts.append(content[now:end])
                    done.append(None if nulls[first + k] else b"".join(parts).decode())
                    counts.append(high - low)
                    cuts.append(sum(b - a for a, b in gone))
                    kept_spans.append([{"first": a, "last": b} for a, b in gone])
            columns = list(batch.columns)[: len(keep)]
            columns[at] = pa.array(done, pa.string())
            span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            columns += [pa.array(counts, pa.int64()), pa.array(cuts, pa.int64()), pa.array(kept_spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(rows, schema)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated passages; n_chars follows; every row stays."""
    columns, prefix = list(docs.columns), free_prefix(docs.columns, "passages_")
    cut = cut_passages(docs, prefix=prefix)
    counted = F.when(F.col(f"`{prefix}cut_words`") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", counted).select(*[f"`{c}`" for c in columns])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES: dict[str, str] = {}
