"""Packing: optimal length buckets and token-budget batches.

The lengths of all rows become one histogram. Dynamic programming over it chooses the bucket borders
with the least padding, when every row is padded to its bucket's border; inside a bucket, batches hold
as many padded rows as the token budget allows.

The histogram holds every distinct length at any size, so the choice is optimal: d distinct lengths
need rows of d * d / 2 tokens in all, so 30 GB of text have some 100 000 of them at most. Rows
are dealt to parts of a bucket by a hash of key, length and row number, about PART rows each whatever key repeats, and batched inside a part in order of
id, so no bucket meets in one task; only the last batch of a part may be short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import free_name, lean, table, written
from framewell.llm.token_files import encoder
from framewell.llm.words import pieces

PART = 10_000
#: Text bytes that are counted at once: the units of a text take some 15 times its size beside it.
PIECE = 2 << 20


def _cheapest(cost: list[int], x: list[int], many: list[int], mass: list[int]) -> tuple[list[int], list[int]]:
    """cost with one more bucket where that is cheaper, and where the last bucket starts then (else -1).

    A start i costs cost[i] + mass[i] - many[i] * x[j - 1], a line in x[j - 1]; slopes fall and x rises, so the lower hull is walked once.
    """
    new, cut = cost.copy(), [-1] * len(cost)
    starts, at = [], 0
    height = [c + m for c, m in zip(cost, mass, strict=True)]
    for j in range(2, len(cost)):
        i = j - 1
        while len(starts) - at >= 2:
            a, b = starts[-2], starts[-1]
            if (height[b] - height[a]) * (many[i] - many[b]) < (height[i] - height[b]) * (many[b] - many[a]):
                break
            starts.pop()
        starts.append(i)
        to = x[j - 1]
        while at + 1 < len(starts) and height[starts[at + 1]] - many[starts[at + 1]] * to < height[starts[at]] - many[starts[at]] * to:
            at += 1
        best = starts[at]
        total = height[best] - many[best] * to + to * many[j] - mass[j]
        if total < new[j]:
            new[j], cut[j] = total, best
    return new, cut


def best_borders(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Borders, at most `buckets` of the sorted lengths and the last among them, with the least total padding."""
    x, n = list(lengths), len(lengths)
    many, mass = [0, *accumulate(counts)], [0, *accumulate(c * v for c, v in zip(counts, x, strict=True))]
    # cost[j] of the first j lengths in the buckets so far; a bucket of lengths i .. j - 1 is padded to x[j - 1]
    cost = [0, *(x[j - 1] * many[j] - mass[j] for j in range(1, n + 1))]
    cuts = []
    for _ in range(1, min(buckets, n)):
        cost, cut = _cheapest(cost, x, many, mass)
        cuts.append(cut)
    borders, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            borders.append(x[j - 1])
            j = cut[j]
    return [*([x[j - 1]] if j else []), *reversed(borders)]


def histogram(lengths: DataFrame, column: str) -> list[tuple[int, int]]:
    """(length, rows) of all rows, in order of the length."""
    counts = lengths.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("rows"))
    return sorted((int(r.x), int(r.rows)) for r in counts.collect())


def pack(rows: DataFrame, key: str, length: str, buckets: int = 8, budget: int = 16_384) -> DataFrame:
    """rows plus (bucket, bucket_len, batch_id, slot, padding).

    rows: `key` and `length` (a count; null counts as 0), other columns are kept unless they have one of
    the new names. bucket_len is the bucket's border, 1 at least; a batch holds max(1, budget // bucket_len)
    rows, so a row longer than the budget is a batch of its own. batch_id is `bucket-part-number`. Rows
    that repeat a key are packed like any others. An empty table gives an empty result.
    """
    new = ("bucket", "bucket_len", "batch_id", "slot", "padding")
    rows = rows.select(*[F.col(c) for c in rows.columns if c.lower() not in (*new, length.lower())], F.coalesce(F.col(length), F.lit(0)).cast("long").alias(length))
    cells = histogram(rows, length)
    if not cells:
        return rows.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"), F.lit("").alias("batch_id"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("padding"))
    borders = best_borders([x for x, _ in cells], [n for _, n in cells], buckets)
    inside = [sum(n for x, n in cells if lo < x <= hi) for lo, hi in zip([-1, *borders[:-1]], borders, strict=True)]
    part, place = free_name(rows.columns, "_part"), free_name(rows.columns, "_place")
    bucket, pads, parts = F.lit(len(borders) - 1), F.lit(max(1, borders[-1])), F.lit(-(-inside[-1] // PART))
    for i in reversed(range(len(borders) - 1)):
        here = F.col(length) <= borders[i]
        bucket, pads, parts = F.when(here, i).otherwise(bucket), F.when(here, max(1, borders[i])).otherwise(pads), F.when(here, max(1, -(-inside[i] // PART))).otherwise(parts)
    dealt = rows.select("*", bucket.alias("bucket"), pads.cast("long").alias("bucket_len"), F.pmod(F.xxhash64(key, length, F.monotonically_increasing_id()), parts).alias(part))
    rank = F.row_number().over(Window.partitionBy("bucket", part).orderBy(key, length)) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    dealt = dealt.withColumn(place, rank)
    return dealt.select(
        *rows.columns, "bucket", "bucket_len",
        F.concat_ws("-", "bucket", part, F.floor(F.col(place) / room)).alias("batch_id"),
        F.pmod(place, room).cast("int").alias("slot"), (F.col("bucket_len") - F.col(length)).alias("padding"),
    )


def token_counts(docs: DataFrame, tokenizer: str | None = None, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, n_tokens): the ids of the whole text, as token_files writes them, with the end id; null and empty texts have the end id alone."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, name)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(encode.counts(piece.column(1)))], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def pack_documents(docs: DataFrame, buckets: int = 8, budget: int = 16_384) -> DataFrame:
    """pack() over docs(doc_id, text, ...); lengths are written to the shared folder once."""
    return pack(written(token_counts(docs), "lengths"), "doc_id", "n_tokens", buckets, budget)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
