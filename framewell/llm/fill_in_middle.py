"""Fill-in-the-middle: texts cut at two line borders and written as prefix, suffix and middle behind sentinels.

A document's line borders are a set of byte offsets in the manner of Roaring sets: one container for each 65536
offsets, as a sorted array, a bitmap or runs, whichever is smallest, and the cumulative cardinalities of the
containers. The k-th border is found by a search among those and a select inside one container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import free_name, table
from framewell.llm.words import pieces, text_bytes

#: Bits of an offset inside its container, and bytes of a bitmap container.
LOW = 16
BITMAP_BYTES = (1 << LOW) // 8
SENTINELS = ("<P>", "<S>", "<M>")
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class ArrayContainer:
    def __init__(self, values: np.ndarray) -> None:
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    def __init__(self, values: np.ndarray) -> None:
        bits = np.zeros(1 << LOW, bool)
        bits[values] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(_BITS[self.bytes], dtype=np.int64)))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bytes[at : at + 1], bitorder="little"))
        return at * 8 + int(inside[k - self.before[at]])


class RunContainer:
    def __init__(self, first: np.ndarray, length: np.ndarray) -> None:
        self.first = first.astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted distinct values below 65536."""
    if len(values) < 3:  # no run of them is smaller
        return ArrayContainer(values)
    start = np.flatnonzero(np.diff(values, prepend=values[0] - 2) != 1)
    if 4 * len(start) < min(2 * len(values), BITMAP_BYTES):
        return RunContainer(values[start], np.diff(start, append=len(values)))
    return ArrayContainer(values) if 2 * len(values) <= BITMAP_BYTES else BitmapContainer(values)


class Borders:
    """A sorted set of offsets with select."""

    def __init__(self, offsets: np.ndarray) -> None:
        if len(offsets) and offsets[-1] < 1 << LOW:
            keys, first = [0], [0, len(offsets)]
        else:
            high = offsets >> LOW
            starts = np.flatnonzero(np.diff(high, prepend=-1))
            keys, first = high[starts].tolist(), [*starts.tolist(), len(offsets)]
        self.keys = keys
        self.before = np.array(first, np.int64)
        self.containers = [container(offsets[a:b] & ((1 << LOW) - 1)) for a, b in zip(first, first[1:], strict=False)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (self.keys[at] << LOW) + self.containers[at].select(k - int(self.before[at]))

    def cut(self, units: int) -> int:
        """The offset after so many units."""
        return self.select(units - 1) if units else 0


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Raises where an end of one sentinel begins another: a piece and a sentinel could then read as a sentinel together."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("the three sentinels must differ and not be empty")
    if any(a.endswith(b[:n]) for a in sentinels for b in sentinels for n in range(1, len(b) + (a != b))):
        raise ValueError("no sentinel may end as another begins")


def _numbers(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs plus (n, form, prefix_chars, middle_chars, output).

    n counts the lines of `text`, whose end each is a border; `rate` percent of the rows are cut, `spm` percent of
    those are written suffix first. Which rows and where is a matter of `seed` and `key` alone, so that any run
    gives the same. A null text is an empty one; an empty text, and one that holds a sentinel, stays plain. A null
    key counts as an empty one. Rows that repeat a key are cut by the same numbers. Other columns are kept, unless
    they have one of the new names. An empty table gives an empty result.
    """
    check_sentinels(sentinels)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c.lower() not in new]
    numbers = []
    for i in range(4):
        numbers.append(free_name([*kept, *numbers], f"_h{i + 1}"))
    rows = docs.select(*kept, *[h.alias(name) for h, name in zip(_numbers(key, seed), numbers, strict=True)])
    out = rows.select(*kept).limit(0).selectExpr("*", "0L as n", "'' as form", "0L as prefix_chars", "0L as middle_chars", "'' as output").schema
    for f in out:
        f.nullable = True
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield _cut_piece(piece)

    def _cut_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
        data, edge = text_bytes(piece.column("text"))
        ends = np.flatnonzero(data == 10) + 1
        first = np.searchsorted(ends, edge, side="right")  # ends[first[i]:first[i + 1]] lie in (edge[i], edge[i + 1]]
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))  # code points before each byte
        h1, h2, h3, h4 = (piece.column(name).to_numpy(zero_copy_only=False) for name in numbers)
        n, form, prefix, middle, output = [], [], [], [], []
        for i in range(len(piece)):
            a, b = int(edge[i]), int(edge[i + 1])
            text = data[a:b].tobytes()
            of = ends[first[i] : first[i + 1]] - a
            if text and not text.endswith(b"\n"):
                of = np.append(of, b - a)
            n.append(len(of))
            if not text or p in text or s in text or m in text or h3[i] % 100 >= rate:
                form.append("plain"), prefix.append(None), middle.append(None), output.append(text)
                continue
            borders = Borders(of)
            low, high = sorted((int(h1[i] % (len(of) + 1)), int(h2[i] % (len(of) + 1))))
            x, y = borders.cut(low), borders.cut(high)
            prefix.append(int(chars[a + x] - chars[a])), middle.append(int(chars[a + y] - chars[a + x]))
            suffix_first = h4[i] % 100 < spm
            form.append("spm" if suffix_first else "psm")
            pre, mid, suf = text[:x], text[x:y], text[y:]
            output.append(b"".join((s, suf, p, pre, m, mid) if suffix_first else (p, pre, s, suf, m, mid)))
        made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], *made], names=[*kept, *new])

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle() has written as `output` in `form`, with the same sentinels."""
    marks = "|".join(rf"\Q{x}\E" for x in sentinels)
    parts = F.split(output, marks)
    pieces_of = F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
    return F.when(form == "plain", output).otherwise(pieces_of)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id::varchar) as h from documents),
l as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as ls, [('0x' || substr(h, 1 + 8 * i, 8))::bigint for i in range(4)] as hs from t),
c as (select *, len(ls) as n, hs[1] % (len(ls) + 1) as a, hs[2] % (len(ls) + 1) as b, text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 100 as plain from l),
p as (select *, array_to_string(ls[:least(a, b)], '') as pre, array_to_string(ls[least(a, b) + 1:greatest(a, b)], '') as mid, array_to_string(ls[greatest(a, b) + 1:], '') as suf from c)
select doc_id, n::bigint as n, case when plain then 'plain' when hs[4] % 100 < 50 then 'spm' else 'psm' end as form,
  case when not plain then length(pre) end::bigint as prefix_chars, case when not plain then length(mid) end::bigint as middle_chars,
  sha256(case when plain then text when hs[4] % 100 < 50 then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
  sha256(case when plain then text else pre || mid || suf end) as restored_sha256
from p"""
