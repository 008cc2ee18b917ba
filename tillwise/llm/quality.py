"""Quality rules: compression bands.

A text is rejected when its zstandard ratio (bytes before / bytes after) lies outside the band
for its length: above it the text repeats itself, below it the text does not compress like
language (random or encoded data). Fixed chunks of the text are measured too, so a long text
cannot hide a repetitive or random half behind an ordinary one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tillwise.llm.words import small

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


class Band(NamedTuple):
    """Limits of the ratio for texts of at least ``size`` bytes."""

    size: int
    least: float
    most: float


# Parameters. Short texts carry the frame and table cost of zstandard, so their limits are wide.
BANDS = (
    Band(0, 0.0, float("inf")),
    Band(64, 0.0, 3.5),
    Band(256, 1.15, 4.0),
    Band(512, 1.25, 4.0),
    Band(1024, 1.35, 4.2),
    Band(4096, 1.45, 5.0),
    Band(16384, 1.5, 6.0),
)
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.25
LEVEL = 3
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_bytes bigint, ratio double, n_chunks bigint, bad_chunks bigint"
)


def limits(size: int, bands: Sequence[Band] = BANDS) -> Band:
    return [band for band in bands if size >= band.size][-1]


def ratios(content: bytes, pack) -> tuple[float, int, int]:
    """Ratio of the whole text, number of its chunks, and how many of them lie outside their band.

    An empty text has ratio 0 and no chunks. A last chunk under a quarter of the size is left out.
    """
    if not content:
        return 0.0, 0, 0
    whole = len(content) / len(pack(content))
    chunks = bad = 0
    if len(content) > CHUNK_BYTES:
        for first in range(0, len(content), CHUNK_BYTES):
            chunk = content[first : first + CHUNK_BYTES]
            if len(chunk) * 4 < CHUNK_BYTES:
                break
            chunks += 1
            band = limits(len(chunk))
            bad += not band.least <= len(chunk) / len(pack(chunk)) <= band.most
    return whole, chunks, bad


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five that occur twice or more in the text."""
    grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = end = 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif WORD.search(line):
            seen.add(line)
    return again


def measure(text: str | None, pack) -> tuple:
    """The measures and the verdict of one text (null: empty)."""
    text = text or ""
    words = WORD.findall(text)
    content = text.encode("utf-8", "surrogatepass")
    n_words, repeats = len(words), repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    ratio, chunks, bad = ratios(content, pack)
    band = limits(len(content))
    fits = not content or band.least <= ratio <= band.most
    kept = not base_failed and fits and bad <= CHUNK_SHARE * chunks
    return (
        n_words, sum(map(len, words)), len(SYMBOL.findall(text)), repeated_lines(text), repeats,
        base_failed, kept, len(content), ratio, chunks, bad,
    )


def quality(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measures and the verdict to every document; no shuffle, one text at a time.

    The added columns are named ``prefix`` + measure and replace columns of that name. A null or
    empty text has no words, so its base rules fail; repeated rows are judged alike; an empty
    table gives an empty one. Texts of any length are measured whole. Those of up to 4,096 bytes
    have no chunks, and a last chunk under 1,024 bytes is in none; the ratio of the whole text
    judges these.
    """
    fields = [piece.split() for piece in MEASURES.split(", ")]
    added = [prefix + name for name, _ in fields]
    keep = [c for c in docs.columns if c == text or c not in added]
    source = docs.select(*[docs[f"`{c}`"] for c in keep])
    extra = StructType.fromDDL(", ".join(f"`{prefix}{name}` {kind}" for name, kind in fields))
    schema = StructType([*source.schema.fields, *extra.fields])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        for batch in small(batches):
            rows = [measure(value.as_py(), pack) for value in batch.column(keep.index(text))]
            columns = [
                pa.array([row[k] for row in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*keep, *added])

    return source.mapInArrow(judged, schema)


def free_prefix(columns: Sequence[str], prefix: str) -> str:
    """The prefix, made longer until no column begins with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the columns stay."""
    columns, prefix = list(docs.columns), free_prefix(docs.columns, "quality_")
    return quality(docs, prefix=prefix).where(f"`{prefix}kept`").select(*[f"`{c}`" for c in columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).drop("text")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
