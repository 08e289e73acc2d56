"""Benchmark decontamination: size-partitioned MinHash containment search.

A document is contaminated by an item when it holds at least `percent` of the item's distinct word
shingles. A short item inside a long document has a tiny Jaccard similarity to it, so neither side is
compared whole:

1. Items are partitioned by their number of shingles, into classes of sizes up to 1, 2, 4, 8
   and so on. For a class of upper size u, a document is a row of blocks of u shingles, and
   each two neighbouring blocks are a search domain of 2 u shingles; a passage of u shingles lies
   in one. A domain that holds `percent` of an item has a Jaccard similarity to it bounded from below
   by the class, whatever the length of the document.
2. Each block has a MinHash signature of `perms` permutations, one minimum each; the signature of two
   blocks, and of the blocks of the next class, is the minimum of theirs. A domain and an item that
   agree in one position are candidates: bands of one row, as the bounded similarity is low.
3. Candidates are verified by exact containment in the whole document.

The chance to miss a contaminated passage is (1 - j) ** perms with the class's bound j on its Jaccard
similarity: for j = 0.19, the least at 80 percent, and 96 permutations it is 2e-9. Shingles that are
scattered over a document without a common passage are no target of the search, but count in step 3.

Items are a stated query set: they go to the tasks in blocks of BLOCK items, one block after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import free_name, identity, lean, table
from framewell.llm.words import SMALL_PIECE, U, mix, ngrams, pieces, shingle_sets, words

#: Items that are broadcast at once: about 8 bytes a shingle and permutation, some MB.
BLOCK = 20_000


def _multipliers(perms: int) -> np.ndarray:
    return mix(np.arange(1, perms + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _permuted(h: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A random-looking order of hashes for multiplier a; the high half of a product depends on all bits below."""
    return ((h * a) >> U(32)).astype(np.uint32)


class Items:
    """A block of items: their shingle sets, and for each size class and permutation the minima."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, perms: int) -> None:
        w = words(pa.array(texts, pa.string()), lower=True)
        row, h = shingle_sets(w, k)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        self.ids, self.sets = ids, [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.short = [(i, len(s)) for i, s in enumerate(self.sets) if 0 < len(s) and w.first[i + 1] - w.first[i] < k]
        mult = _multipliers(perms)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        member: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                u = 1
                while u < len(s):
                    u *= 2
                member.setdefault(u, []).append(i)
        with np.errstate(over="ignore"):
            for u, items in sorted(member.items()):
                table_ = []
                for a in mult:
                    low = np.array([_permuted(self.sets[i], a).min() for i in items], np.uint32)
                    order = np.argsort(low, kind="stable")
                    table_.append((low[order], np.array(items)[order]))
                self.classes[u] = table_


def _search(k: int, percent: int, perms: int, block):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, mult = block.value, _multipliers(perms)
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                w = words(piece.column(1), lower=True)
                h, whole = ngrams(w, k)
                row = w.row[: len(h)][whole]
                h = h[whole]
                counts = np.diff(w.first)
                found: set[tuple[int, int]] = set()
                if len(h) and items.classes:
                    first = np.searchsorted(row, np.arange(len(piece) + 1))
                    pos = np.arange(len(h)) - first[row]
                    least = min(items.classes)
                    starts = np.flatnonzero(pos % least == 0)
                    with np.errstate(over="ignore"):
                        for j, a in enumerate(mult):
                            low = np.minimum.reduceat(_permuted(h, a), starts)
                            of = row[starts]
                            u = least
                            for size, table_ in items.classes.items():
                                while u < size:  # two blocks of a document become one; the last may stand alone
                                    begin = np.searchsorted(of, np.arange(len(piece) + 1))
                                    head = np.flatnonzero((np.arange(len(of)) - begin[of]) % 2 == 0)
                                    low, of = np.minimum.reduceat(low, head), of[head]
                                    u *= 2
                                pair = low.copy()
                                joined = of[1:] == of[:-1]
                                pair[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                                mins, which = table_[j]
                                left = np.searchsorted(mins, pair, side="left")
                                hit = np.flatnonzero(mins[np.minimum(left, len(mins) - 1)] == pair)
                                for d, x, m in zip(of[hit].tolist(), left[hit].tolist(), pair[hit].tolist(), strict=True):
                                    while x < len(mins) and mins[x] == m:
                                        found.add((d, int(which[x])))
                                        x += 1
                # texts of fewer than k words are one shingle, and equal only to such an item
                if items.short and (counts < k).any():
                    srow, sh = shingle_sets(w, k)
                    for i, _ in items.short:
                        found.update((int(d), i) for d in srow[sh == items.sets[i][0]])
                if not found:
                    continue
                srow, sh = shingle_sets(w, k)
                border = np.searchsorted(srow, np.arange(len(piece) + 1))
                out = []
                for d, i in sorted(found):
                    mine, item = sh[border[d] : border[d + 1]], items.sets[i]
                    both = int((mine[np.minimum(np.searchsorted(mine, item), len(mine) - 1)] == item).sum()) if len(mine) else 0
                    if 100 * both >= percent * len(item):
                        out.append((piece.column(0)[d].as_py(), items.ids[i], len(item), both))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "n_shingles", "n_found"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, perms: int = 96) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found), a row for each document and item that it contains.

    Words are maximal runs of other characters than space and \\t-\\r; A-Z count as a-z. A text of
    fewer than k words is one shingle, its whole sequence. Items that are null, empty or blank are in no
    document, and such documents contain nothing; rows with a null id are left out. Rows that repeat
    a doc_id or an item_id with the same text give the pair once. Extra columns are ignored; without
    items or documents the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    schema = "doc_id long, item_id long, n_shingles long, n_found long"
    found, ids, texts = [], [], []

    def search() -> None:
        block = spark.sparkContext.broadcast(Items(ids, texts, k, perms))
        found.append(docs.mapInArrow(_search(k, percent, perms, block), schema))

    for r in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        ids.append(r.item_id), texts.append(r.text)
        if len(ids) == BLOCK:
            search()
            ids, texts = [], []
    if ids:
        search()
    return reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, that contain no item. Rows with a null doc_id are searched too; rows that repeat a doc_id go together."""
    key = free_name(docs.columns, "_key")
    found = contaminated(docs.select(identity().alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, identity()).join(found, key, "left_anti").select(*docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with t as (
  select 0 as kind, doc_id as id, text from documents where doc_id is not null
  union all select 1, item_id, text from benchmark where item_id is not null and text is not null
), w as (
  select kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from t
), e as (
  select distinct kind, id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w
), n as (select id, count(*)::bigint as n from e where kind = 1 group by id)
select d.id as doc_id, i.id as item_id, n.n as n_shingles, count(*)::bigint as n_found
from e i join e d on d.s = i.s and d.kind = 0 join n on n.id = i.id
where i.kind = 1 group by d.id, i.id, n.n having 100 * count(*) >= 80 * n.n
"""
