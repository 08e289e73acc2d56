"""Substring dedup with prefix-partitioned suffix trees.

A window is `window` consecutive words of one document. The operator removes each word covered by a
window whose word sequence also starts in a document with a smaller doc_id.

Suffixes start at each word that starts a window, and are grouped by a prefix that equal windows share: in each
window the rarest run of ANCHOR words (by a count sketch over all documents, then by hash) is its
anchor, so equal windows have equal anchors at equal offsets, and about a fifth of all positions are anchors; a
common phrase anchors a window only where all of the window is common. The steps:

1. Prefixes are counted. Anchors that start in one document only can't be part of a repeat, and fall
   out. An anchor that more than GROUP suffixes share, or that the sketch says is common, is too short a prefix for
   a memory-sized group: its suffixes are told apart by longer ones, of all words of the window.
2. Suffixes are partitioned by these variable-length prefixes. A task combines them first: of a window
   that several of its documents hold, the smallest doc_id keeps the suffix, and the others are repeats for certain.
   So an anchor's group has GROUP suffixes at most, and a window's group a row for each task that meets it, which
   is read as a stream in order of doc_id and never held.
3. In a group, the sorted suffixes and the words that neighbours have in common from their start are the
   subtree. Its internal nodes of window depth or deeper are the repeats: of a node's documents the
   smallest doc_id keeps the words. Places in a row below such nodes form the maximal repeats.

Suffixes are compared word by word, by the words' 64-bit hashes; hashes of windows only choose partitions and order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import table
from framewell.llm.sketch import Counts, sketch
from framewell.llm.words import STEP, U, Words, mix, ngrams, pieces, signed, words

#: Words of an anchor.
ANCHOR = 5
#: Text bytes whose suffixes one task combines before it sends them on.
COMBINE = 8 << 20
#: Suffixes of a memory-sized group.
GROUP = 20_000
#: Places that a task gathers before it sends them on.
MARKS = 1 << 20
#: Partitions of texts for one of suffixes.
SHARE = 3
#: Parts that the documents of a common anchor are dealt to while anchors are counted.
PARTS = 64


def _anchors(w: Words, window: int, common: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the word it starts with, the word its anchor starts with and the anchor's hash."""
    k = min(ANCHOR, window)
    h, _ = ngrams(w, k)
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    whole = w.row[:n] == w.row[window - 1 :]
    rank = (common.of(h).astype(U) << U(48)) | (h >> U(16))
    low, at = rank[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window - k + 1):
        less = rank[i : i + n] < low
        low[less] = rank[i : i + n][less]
        at[less] = i
    start = np.flatnonzero(whole)
    at = start + at[whole]
    return start, at, h[at]


def _run_lists(of: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For places sorted by `of` and place: where each value of `of` starts, and its places as runs: first, after the last, first, after the last, ..."""
    if not len(of):
        return np.zeros(0, np.int64), pa.array([], pa.list_(pa.int32()))
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    begins = new.copy()
    begins[1:] |= places[1:] > places[:-1] + 1
    first = np.flatnonzero(begins)
    stop = places[np.append(first[1:], len(of)) - 1] + 1
    heads = np.flatnonzero(new)
    offsets = 2 * np.append(np.searchsorted(first, heads), len(first))
    return heads, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.stack([places[first], stop], 1).ravel(), pa.int32()))


def _expanded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places in lists of runs."""
    runs = lists.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) // 2)
    size = runs[:, 1] - runs[:, 0]
    before = np.cumsum(size) - size
    return np.repeat(owner, size), np.repeat(runs[:, 0] - before, size) + np.arange(size.sum())


def _phrases(window: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for piece in pieces(batch, "text"):
            h, whole = ngrams(words(piece.column(piece.schema.get_field_index("text"))), min(ANCHOR, window))
            yield h[whole]

    return run


def _occurrences(window: int, sketch_):
    """(anchor, part, doc_id, uses): how many windows of a document an anchor has in COMBINE bytes of text. part is null, or for a common anchor the part of PARTS that its documents are dealt to."""

    def flush(ids: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        d, h = np.concatenate(ids), np.concatenate(hashes)
        order = np.lexsort((d, h))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        uses = np.diff(np.append(first, len(d)))
        d, h = d[first], h[first]
        part = pa.array((d % PARTS).astype(np.int32), mask=sketch_.value.common(h) == 0)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), part, pa.array(d), pa.array(uses.astype(np.int32))], names=["anchor", "part", "doc_id", "uses"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held = [], [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = words(piece.column(1))
                start, _, h = _anchors(w, window, sketch_.value)
                ids.append(piece.column(0).to_numpy()[w.row[start]])
                hashes.append(h)
                held += len(w.data)
                if held >= COMBINE:
                    yield flush(ids, hashes)
                    ids, hashes, held = [], [], 0
        if ids:
            yield flush(ids, hashes)

    return run


SUFFIX = "key long, doc_id long, text int, at long, words binary, starts array<int>, kind int"
#: Kinds of rows: suffixes of a short prefix, of one of all words of the window, and places that repeat for certain.
SHORT, LONG, KNOWN = 0, 1, 2


class _Texts:
    """Words of several pieces, and the windows of interest in them."""

    def __init__(self) -> None:
        self.words: list[Words] = []
        self.windows: list[tuple[np.ndarray, ...]] = []  # (word it starts with, doc_id, hash of its text, place, offset and hash of its anchor, hot)
        self.n_words = self.n_bytes = 0

    def add(self, w: Words, start: np.ndarray, doc: np.ndarray, text: np.ndarray, offset: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> None:
        self.windows.append((start + self.n_words, doc, text, start - w.first[w.row[start]], offset, anchor, hot))
        self.words.append(w)
        self.n_words += len(w.hash)
        self.n_bytes += len(w.data)

    def all(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.windows, strict=True))

    def hashes(self) -> np.ndarray:
        return np.concatenate([w.hash for w in self.words])

    def slices(self, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """Words first up to stop, with one space between."""
        base = np.cumsum([0, *(len(w.data) for w in self.words)])
        start = np.concatenate([w.start + b for w, b in zip(self.words, base, strict=False)])
        end = np.concatenate([w.end + b for w, b in zip(self.words, base, strict=False)])
        data = np.concatenate([w.data for w in self.words])
        odd = np.zeros(len(start) + 1, np.int64)  # gaps before a word that aren't one space
        odd[1:-1] = np.cumsum((start[1:] != end[:-1] + 1) | (data[np.minimum(end[:-1], len(data) - 1)] != 32))
        plain, raw = (odd[stop - 1] == odd[first]).tolist(), data.tobytes()
        return [raw[i:j] if one else b" ".join(raw[i:j].split()) for i, j, one in zip(start[first].tolist(), end[stop - 1].tolist(), plain, strict=True)]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of integers."""
    with np.errstate(over="ignore"):
        return signed(mix(mix(a.astype(np.int64).view(U)) + b.astype(np.int64).view(U)))


def _suffix_rows(key: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray, body: pa.Array, starts: pa.Array, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(text), pa.array(at), body, starts, pa.array(np.full(len(key), kind, np.int32))], names=[c.split()[0] for c in SUFFIX.split(", ")])


def _combined(texts: _Texts, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of SUFFIX. SHORT and LONG: windows start at the offsets in the runs `starts` of `words`, which start at word `at` of the document; with at -1 `words` is one window, and `starts` are all its places in the document. KNOWN: runs of places where windows repeat."""
    hashes = texts.hashes()
    word, doc, text, place, offset, anchor, hot = texts.all()
    with np.errstate(over="ignore"):
        whole = np.zeros(len(word), U)
        for k in range(window):
            whole = whole * STEP + hashes[word + k]
        whole = mix(whole)
    order = np.lexsort((place, doc, whole))
    word, doc, text, place, offset, anchor, hot, whole = (x[order] for x in (word, doc, text, place, offset, anchor, hot, whole))
    row = _row(doc, text)
    new = np.ones(len(word), bool)
    new[1:] = whole[1:] != whole[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
    rest = np.flatnonzero(~new)
    equal = np.ones(len(rest), bool)
    for k in range(window):
        equal &= hashes[word[rest] + k] == hashes[word[head[rest]] + k]
    new[rest[~equal]] = True  # other words with the same hash
    head[rest[~equal]] = rest[~equal]
    own = doc == doc[head]
    several = np.bincount(head[own], minlength=len(head))[head] > 1
    one = np.flatnonzero(own & ~several & ~hot)
    one = one[np.lexsort((place[one], (place + offset)[one], row[one]))]
    if len(one):
        # the windows of one place of an anchor overlap: they share a row
        body = np.ones(len(one), bool)
        body[1:] = (row[one][1:] != row[one][:-1]) | ((place + offset)[one][1:] != (place + offset)[one][:-1])
        first = one[body]
        last = one[np.append(np.flatnonzero(body)[1:], len(one)) - 1]
        nth = np.cumsum(body) - 1
        _, starts = _run_lists(nth, place[one] - place[first][nth])
        yield _suffix_rows(anchor[first], doc[first], text[first], place[first], pa.array(texts.slices(word[first], word[last] + window), pa.binary()), starts, SHORT)
    for kind in (SHORT, LONG):
        some = np.flatnonzero(own & (hot if kind == LONG else several & ~hot))
        some = some[np.lexsort((place[some], row[some], head[some]))]
        if len(some):
            heads, starts = _run_lists(_row(head[some], row[some]), place[some])
            first = some[heads]
            key = signed(whole[first]) if kind == LONG else anchor[first]
            yield _suffix_rows(key, doc[first], text[first], np.full(len(first), -1), pa.array(texts.slices(word[first], word[first] + window), pa.binary()), starts, kind)
    known = np.flatnonzero(~own)
    known = known[np.lexsort((place[known], row[known]))]
    if len(known):
        heads, starts = _run_lists(row[known], place[known])
        of = known[heads]
        yield _suffix_rows(row[of], doc[of], text[of], np.zeros(len(of), np.int64), pa.nulls(len(of), pa.binary()), starts, KNOWN)


def _suffixes(window: int, sketch_):
    """Rows of SUFFIX from (doc_id, text, its hash, anchors, hot anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts()
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = words(piece.column(1))
                start, at, h = _anchors(w, window, sketch_.value)
                keep = _listed(w.row[start], signed(h), piece.column(3))
                start, at, h = start[keep], at[keep], signed(h[keep])
                row = w.row[start]
                texts.add(w, start, piece.column(0).to_numpy()[row], piece.column(2).to_numpy()[row], at - start, h, _listed(row, h, piece.column(4)))
                if texts.n_bytes >= COMBINE:
                    yield from _combined(texts, window)
                    texts = _Texts()
        if texts.n_bytes:
            yield from _combined(texts, window)

    return run


def _listed(row: np.ndarray, anchor: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which anchors are in the lists of their rows."""
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    listed = lists.flatten().to_numpy()
    if not len(listed):
        return np.zeros(len(row), bool)
    with np.errstate(over="ignore"):
        x, y = (mix(h.view(U) ^ mix(r.astype(U))) for h, r in ((anchor, row), (listed, owner)))
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _matrix(text: pa.Array, window: int, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The word hashes of the windows at word `offset` of each row's text."""
    w = words(text.cast(pa.string()))
    return w.hash[(w.first[row] + offset)[:, None] + np.arange(window)]


def subtree(suffixes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which suffixes, as rows of words, have an equal one in a smaller doc: suffixes are sorted, and each run of neighbours with all words in common is an internal node of full depth."""
    order = np.lexsort(suffixes.T[::-1])
    ranked, docs = suffixes[order], doc[order]
    equal = ranked[1:] == ranked[:-1]
    common = np.where(equal.all(1), suffixes.shape[1], equal.argmin(1))  # words from the start that neighbours share
    node = np.flatnonzero(np.append(True, common < suffixes.shape[1]))
    least = np.repeat(np.minimum.reduceat(docs, node), np.diff(np.append(node, len(docs))))
    found = np.zeros(len(doc), bool)
    found[order] = docs > least
    return found


class _Marks:
    """Places of a task, gathered to a row for each text."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((doc, text, place))
        self.held += len(doc)

    def rows(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.held < least:
            return
        doc, text, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        row = _row(doc, text)
        order = np.lexsort((place, row))
        heads, starts = _run_lists(row[order], place[order])
        self.parts, self.held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(doc[order][heads]), pa.array(text[order][heads]), starts], names=["doc_id", "digest", "starts"])


def _trees(window: int):
    """(doc_id, digest, starts): runs of places where windows start that a smaller doc_id has too. Rows come in order of key and doc_id."""

    def of_group(rows: pa.RecordBatch, marks: _Marks) -> None:
        doc, text, at, starts = rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(5)
        row, place = _expanded(starts)
        several = at[row] < 0
        once = np.flatnonzero(at < 0)  # one window, whatever the number of its places
        of = np.concatenate([row[~several], once])
        offset = np.concatenate([place[~several], np.zeros(len(once), np.int64)])
        found = subtree(_matrix(rows.column(4), window, of, offset), doc[of])
        n = int((~several).sum())
        marked = np.zeros(len(doc), bool)
        marked[once[found[n:]]] = True
        hit = several & marked[row]
        single = found[:n]
        row = np.concatenate([row[hit], of[:n][single]])
        marks.add(doc[row], text[row], np.concatenate([place[hit], (at[of] + offset)[:n][single]]))

    class Stream:
        """Windows with a prefix of all their words: the first row of a key has the smallest doc_id."""

        def __init__(self) -> None:
            self.key, self.owners = None, {}

        def read(self, rows: pa.RecordBatch, marks: _Marks) -> None:
            key, doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            suffix = _matrix(rows.column(4), window, np.arange(len(key)), np.zeros(len(key), np.int64))
            later = np.zeros(len(key), bool)
            for i, (k, d) in enumerate(zip(key.tolist(), doc.tolist(), strict=True)):
                if k != self.key:
                    self.key, self.owners = k, {}
                later[i] = self.owners.setdefault(suffix[i].tobytes(), d) < d
            row, place = _expanded(rows.column(5))
            row, place = row[later[row]], place[later[row]]
            marks.add(doc[row], rows.column(2).to_numpy()[row], place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stream, marks = [], Stream(), _Marks()
        for batch in batches:
            kind = batch.column(6).to_numpy()
            for which in (KNOWN, LONG, SHORT):
                rows = batch if (kind == which).all() else batch.filter(pa.array(kind == which))
                if not len(rows):
                    continue
                if which == KNOWN:
                    row, place = _expanded(rows.column(5))
                    marks.add(rows.column(1).to_numpy()[row], rows.column(2).to_numpy()[row], place)
                elif which == LONG:
                    stream.read(rows, marks)
                else:
                    held.append(rows)
                    if sum(map(len, held)) >= GROUP:
                        group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        key = group.column(0).to_numpy()
                        whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                        if whole:
                            of_group(group.slice(0, whole), marks)
                        held = [group.slice(whole)]
            yield from marks.rows(MARKS)
        if sum(map(len, held)):
            of_group(pa.Table.from_batches(held).combine_chunks().to_batches()[0], marks)
        yield from marks.rows()

    return run


def _cut(window: int):
    """The words that stay: their count, how many go, and the digest or the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, removed, kept = [], [], []
            for text, lists in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = (text or "").encode().split()
                n_words.append(len(parts))
                if lists:
                    gone = np.zeros(len(parts) + 1, np.int64)
                    runs = np.concatenate([np.asarray(x, np.int64) for x in lists])
                    np.add.at(gone, runs[::2], 1)
                    np.add.at(gone, runs[1::2] - 1 + window, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    parts = [p for p, s in zip(parts, stay.tolist(), strict=True) if s]
                removed.append(n_words[-1] - len(parts))
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs(doc_id, text, ...).

    Words are maximal runs of other characters than space and \\t-\\r, compared unchanged. Windows are
    judged on the input, not on what is left of it. A null, empty or blank text has no words; a text
    of fewer than `window` words keeps all. Repeats inside one document stay. Rows with a null
    doc_id are left out, since they can't be ordered; rows that repeat a doc_id come back as often and count
    as one document, each with its own text. Extra columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    common = spark.sparkContext.broadcast(sketch(docs.select("text"), _phrases(window)))
    found = docs.mapInArrow(_occurrences(window, common), "anchor long, part int, doc_id long, uses int")
    same = Window.partitionBy("anchor", "part")
    found = found.withColumn("low", F.min("doc_id").over(same)).withColumn("high", F.max("doc_id").over(same)).withColumn("uses", F.sum("uses").over(same)).where("part is not null or low < high")
    lists = found.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("part").isNotNull() | (F.col("uses") > GROUP), F.col("anchor"))).alias("hot"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(n, "doc_id")
    digest = F.hash("text").alias("digest")
    suffixes = dealt.join(lists, "doc_id").select("doc_id", "text", digest, "anchors", "hot").mapInArrow(_suffixes(window, common), SUFFIX)
    # suffixes are small: fewer and larger tasks send on fewer rows for each text
    marks = suffixes.repartition(max(1, n // SHARE), "key").sortWithinPartitions("key", "doc_id").mapInArrow(_trees(window), "doc_id long, digest int, starts array<int>")
    # dealt by doc_id as the texts are; texts that differ under one doc_id have marks of their own
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "starts")).alias("lists"))
    own = F.transform(F.filter("lists", lambda x: x["digest"] == F.hash("text")), lambda x: x["starts"])
    return dealt.join(marks, "doc_id", "left").select("doc_id", "text", own.alias("lists")).mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents where doc_id is not null
), win as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as t
  from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)
), low as (select t, min(doc_id) as d from win group by t having min(doc_id) <> max(doc_id)),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from win join low using (t) where low.d < win.doc_id
), kept as (
  select doc_id, count(*)::bigint as n, string_agg(x, ' ' order by p) as s
  from (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w) anti join gone using (doc_id, p)
  group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from w left join kept using (doc_id)
"""
