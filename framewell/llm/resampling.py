"""Importance resampling towards a target distribution, over hashed word n-grams.

The texts of a batch are joined with separators; one pass of a pattern finds all words, a binary search among the
documents' offsets tells the document of each, and n-grams that cross documents are masked before the buckets are
counted. Bucket counts of all rows and of the target give a gain for each bucket; a document weighs the mean gain of
its features, Gumbel noise from its key is added, and the highest scores are drawn.

Counts are summed in each task before they are shuffled. The driver holds one number for each bucket and the score
at which the draw ends. Scores are whole numbers between the least and the largest gain and noise, so a histogram
of them has some 100 000 rows at any size; only rows from that score on are brought in order, over ranges.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import free_name, table, written
from framewell.llm.words import pieces

SEED, BUCKETS, PERCENT, MIN_WORDS = 2024, 10_000, 10, 20
#: Bytes of words of lower-cased UTF-8 text; the separator is none of them.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = b"\x00"
#: Bits of monotonically_increasing_id() that count rows inside a partition.
_ROW_BITS = 33


def feature_buckets(col: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the features of each text, for runs of 1, 2, ... `longest` words. The first tells the words."""
    texts = [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
    joined = _SEPARATOR.join(texts).lower()
    starts, words = [], []
    for found in _WORD.finditer(joined):
        starts.append(found.start())
        words.append(found.group())
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    row = np.searchsorted(offsets, np.array(starts, np.int64), side="right") - 1
    distinct = pa.array(words, pa.large_binary()).dictionary_encode()
    of_word = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = distinct.dictionary.to_pylist()
    crc = np.array([zlib.crc32(w) for w in vocabulary], np.int64)
    run = of_word  # the number of the run that starts at each word
    for k in range(longest):
        if k:
            # runs of k words, each with the word behind them; crc32 goes on from where the shorter run ends
            pair = run[: len(row) - k] * len(vocabulary) + of_word[k:]
            pairs, run = np.unique(pair, return_inverse=True)
            before, word = np.divmod(pairs, max(1, len(vocabulary)))
            crc = np.array([zlib.crc32(b" " + vocabulary[w], int(crc[b])) for b, w in zip(before.tolist(), word.tolist(), strict=True)], np.int64)
        whole = row[: len(row) - k] == row[k:] if len(row) > k else np.zeros(0, bool)
        run = run[: len(whole)]
        yield row[: len(whole)][whole], (crc[run] % buckets)[whole]


def bucket_counts(rows: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features stand in all texts of rows(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                for _, bucket in feature_buckets(piece.column("text"), longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "features"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features")).collect():  # a row for each bucket at most
        out[r.bucket] = r.features
    return out


def gains(spark, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    n, rows = len(source), [(i, int(s), int(t)) for i, (s, t) in enumerate(zip(source, target, strict=True))]
    ratio = (F.col("t") + 1.0) * F.lit(float(source.sum() + n)) / ((F.col("s") + 1.0) * F.lit(float(target.sum() + n)))
    found = spark.createDataFrame(rows, "i long, s long, t long").select("i", F.floor(1000 * F.ln(ratio)).alias("gain"))
    out = np.zeros(n, np.int64)
    for r in found.collect():  # a row for each bucket
        out[r.i] = r.gain
    return out


def _scored(docs: DataFrame, gain: np.ndarray, longest: int, key: str, seed: int) -> DataFrame:
    """(key, text_hash, n_words, n_features, weight, score)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                n = len(piece)
                words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for k, (row, bucket) in enumerate(feature_buckets(piece.column("text"), longest, len(gain))):
                    of_row = np.bincount(row, minlength=n)
                    words = words if k else of_row
                    features += of_row
                    total += np.bincount(row, gain[bucket], minlength=n)  # whole numbers far below 2**53
                weight = total.astype(np.int64) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("text_hash"), *map(pa.array, (words, features, weight))], names=["id", "text_hash", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).alias("id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"id {kind}, text_hash long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return rows.select("*", (F.col("weight") + noise).cast("long").alias("score"))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(key, text_hash, n_words, n_features, weight, score, rank) for each row of docs(key, text, ...); target(text, ...).

    Words are runs of code points other than ASCII signs, A-Z lower-cased; features are runs of up to `longest`
    words. rank counts from 1 through the floor(percent * N / 100) highest scores of the N rows with min_words
    words; all others have null. Ties go to the smaller key, null first, then to the smaller hash of the text;
    rows equal in both take places in a row. A null text has no words and weighs 0; a null key counts as an empty
    one in the noise. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    gain = gains(spark, bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = written(_scored(docs, gain, longest, key, seed), "scores")
    enough = F.col("n_words") >= min_words
    histogram = rows.where(enough).groupBy("score").agg(F.count("*").alias("rows"))
    drawn = int(histogram.agg(F.sum("rows")).first()[0] or 0) * percent // 100
    # a row for each score: one task sums them
    last = histogram.select("score", (F.sum("rows").over(Window.orderBy(F.desc("score"))) - F.col("rows")).alias("above")).where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    name = free_name(rows.columns, key) if key != "id" else "id"
    columns = [F.col("id").alias(name), *[c for c in rows.columns if c != "id"]]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    within = enough & (F.col("score") >= last)
    # a key and text may stand in many rows: their place in the files deals them over ranges too
    order = [F.desc("score"), F.asc("id"), F.asc("text_hash"), F.asc("place")]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.where(within).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(sorted_.drop("place").withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, inside = F.shiftrightunsigned("at", _ROW_BITS), F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # a row for each range
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    starts = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))
    rank = F.col("start") + inside + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rows.where(~within).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that importance() draws, whole, with all their columns. Rows that repeat a key and its text are drawn together if one of them is."""
    name, hash_ = free_name(docs.columns, "_key"), free_name(docs.columns, "_hash")
    drawn = importance(docs, target, key, **options).where("rank is not null").select(F.col(key).alias(name), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(drawn, (docs[key].eqNullSafe(drawn[name])) & (F.xxhash64(docs["text"]) == drawn[hash_]), "left_semi")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
with recursive crc_table(i, c, k) as (select i, i, 0 from range(256) r(i) union all select i, case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_table where k < 8),
tab as (select list(c order by i) as t from crc_table where k = 8),
w as (select 's' as side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all select 't', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
x as (select side, doc_id, unnest(ws) as word from w),
v as (select distinct word, hex(encode(word)) as h from x),
b as (select word, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 1 + 2 * i, 2))::bigint for i in range(length(h) // 2)]),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket from v, tab),
n as (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from x join b using (word) group by bucket),
a as (select sum(s) as s, sum(t) as t from n),
g as (select bucket, floor(1000 * ln((n.t + 1)::double * (a.s + 10000)::double / ((n.s + 1)::double * (a.t + 10000)::double)))::bigint as gain from n, a),
d as (select doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from x join b using (word) join g using (bucket) where side = 's' group by doc_id),
o as (select w.doc_id, coalesce(d.n, 0) as n_features, coalesce(d.weight, 0) as weight, ('0x' || substr(sha256('2024:' || w.doc_id::varchar), 1, 8))::bigint as h from w left join d on d.doc_id = w.doc_id where side = 's'),
e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from o),
r as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place, count(*) filter (n_features >= 20) over () as many from e)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when place <= 10 * many // 100 then place end::bigint as rank from r"""
