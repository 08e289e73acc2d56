"""N-gram Jaccard join with a token-group matrix.

Two documents link when the Jaccard similarity of their sets of distinct word shingles reaches a
threshold. The steps, each a Spark job over all rows:

1. Every document becomes its set of shingle hashes (64 bits; taken as the shingles). Documents of
   equal sets, by a fingerprint of 128 bits, form a class; only classes are compared, and a hot group of copies is one class.
2. A count sketch of fixed size (SLOTS counters, summed over all documents) orders the shingles from
   rare to common. Any fixed order gives the same links; this one keeps common passages from making
   candidates. The first n - need + l shingles of a set are its tokens, for need = ceil(t n) and
   l = min(HITS, need): two sets that link share l of them, which sets with a chance shingle in common don't.
3. Classes of about one size whose most shared token is the same form groups, split by hash so that a
   group has about GROUP classes at any size of the corpus. The token-group matrix has a row for each token in a
   group's token union. Shingles beyond step 2's are left out of it: links are found by the tokens alone.
4. If a query class links to a member of a group, it shares at least l tokens with the group's union, and
   more where the sizes ask for more overlap than `need`: overlap a = ceil(t (n + m) / (1 + t)) means
   l + a - max(need, need of m) shared tokens. Groups hold sets of about one size, so that this bound is
   tight; groups that don't reach it, or whose sizes are out of reach, stay closed.
5. Open pairs of groups are compared exactly, set by set; a pair of groups sends on the links that
   span it, not all pairs. Connected components of the links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.common import lean, table, written
from framewell.llm.components import components
from framewell.llm.sketch import CHUNK, SLOTS, Sketch, summed
from framewell.llm.words import SMALL_PIECE, U, mix, pieces, shingle_sets, signed, words

#: Classes of a group, on average at most.
GROUP = 256
#: Parts that a common token, and the members of a group's home, are dealt to.
PARTS = 64
#: Tokens that linked sets share at least.
HITS = 8


def _set_stats(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Borders, sizes and fingerprints of the sets of each row; a fingerprint has 128 bits, so that no two sets of any corpus share one."""
    borders = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(borders)
    fp, fp2 = np.zeros(rows, U), np.zeros(rows, U)
    if len(h):
        full = n > 0
        with np.errstate(over="ignore"):
            for out, salt in ((fp, U(0x5851F42D4C957F2D)), (fp2, U(0x2545F4914F6CDD1D))):
                out[full] = mix(np.add.reduceat(mix(h ^ salt), borders[:-1][full]) + n[full].astype(U))
    return borders, n, fp, fp2


def _stats(k: int):
    """Rows of documents, (doc_id, n, fp, fp2), and at the end of a task its part of the sketch in chunks."""
    names = ["doc_id", "n", "fp", "fp2", "chunk", "task", "counts"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Sketch()
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                row, h = shingle_sets(words(piece.column(1), lower=True), k)
                part.add(h)
                _, n, fp, fp2 = _set_stats(row, h, len(piece))
                nil = pa.nulls(len(n), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n.astype(np.int64)), pa.array(signed(fp)), pa.array(signed(fp2)), nil, nil, pa.nulls(len(n), pa.binary())], names=names)
        nil = pa.nulls(SLOTS // CHUNK, pa.int64())
        yield pa.RecordBatch.from_arrays([nil, nil, nil, nil, *part.chunks()], names=names)

    return run


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n shingles with any set that it links to."""
    return -(-percent * n // 100)


def _tokens(k: int, percent: int, sketch):
    """(token, fp, fp2, n, common): the tokens of each set, the rarest shingles first; one row for each set and piece. common: the shingle's count, where it stands out, else 0."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                row, h = shingle_sets(words(piece.column(1), lower=True), k)
                borders, n, fp, fp2 = _set_stats(row, h, len(piece))
                once = np.zeros(len(n), bool)
                once[np.unique(np.stack([fp, fp2]), axis=1, return_index=True)[1]] = True
                key = (row.astype(U) << U(16)) | counts.of(h).astype(U)
                order = np.argsort(key, kind="stable")
                rank = np.arange(len(h)) - borders[row]
                need = needed(n, percent)
                keep = (rank < (n - need + np.minimum(HITS, need))[row]) & once[row]
                at, token = row[keep], h[order][keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(signed(fp)[at]), pa.array(signed(fp2)[at]), pa.array(n[at].astype(np.int64)), pa.array(counts.common(token))], names=["token", "fp", "fp2", "n", "common"])

    return run


def _sets(k: int):
    """(fp, rep, n, weight, grp, lo, hi, shingles): a row for each open pair of groups in the list `pairs`, with the text's set; texts of other classes under the same doc_id give none."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                row, h = shingle_sets(words(piece.column(1), lower=True), k)
                borders, _, fp, fp2 = _set_stats(row, h, len(piece))
                of_class = piece.column(2)
                same = (signed(fp) == of_class.to_numpy()) & (signed(fp2) == piece.column(3).to_numpy())
                pairs = piece.column(7)
                at = np.repeat(np.arange(len(piece)), np.diff(pairs.offsets.to_numpy()))
                flat = pairs.flatten().filter(pa.array(same[at]))
                at = pa.array(at[same[at]])
                sets = pa.array([h[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
                columns = [c.take(at) for c in (of_class, piece.column(0), piece.column(4), piece.column(5), piece.column(6))]
                yield pa.RecordBatch.from_arrays([*columns, flat.field(0), flat.field(1), sets.take(at)], names=["fp", "rep", "n", "weight", "grp", "lo", "hi", "shingles"])

    return run


def _compare(percent: int):
    """The links inside an open pair of groups: a spanning forest of them, and for each class the documents that it links to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        pdf = pdf.drop_duplicates(["fp", "n"]).sort_values(["n", "fp"])
        fp, rep, n, weight, grp = (pdf[c].to_numpy() for c in ("fp", "rep", "n", "weight", "grp"))
        sets = [np.frombuffer(x, U) for x in pdf["shingles"]]
        root = np.arange(len(rep))
        degree = np.zeros(len(rep), np.int64)
        forest = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(rep)):
            stop = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            other = np.arange(i + 1, stop)
            if lo != hi:
                other = other[grp[other] != grp[i]]
            if not len(other):
                continue
            mine = sets[i]
            theirs = np.concatenate([sets[j] for j in other])
            at = np.searchsorted(mine, theirs)
            hit = mine[np.minimum(at, len(mine) - 1)] == theirs
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[other])[:-1]]), dtype=np.int64)
            for j in other[100 * both >= percent * (n[i] + n[other] - both)]:
                degree[i] += weight[j]
                degree[j] += weight[i]
                if (x := find(i)) != (y := find(j)):
                    root[x] = y
                    forest.append((rep[i], rep[j], None, None))
        rows = forest + [(fp[i], None, n[i], degree[i]) for i in np.flatnonzero(degree)]
        return pd.DataFrame(rows, columns=["a", "b", "n", "w"]).astype("Int64")

    return run


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs(doc_id, text, ...).

    Words are maximal runs of other characters than space and \\t-\\r; A-Z count as a-z. A text of
    fewer than k words has its whole sequence as one shingle; a null, empty or blank text has the
    empty set, is linked with nothing and is its own component. Rows with a null doc_id are left
    out: they have no identity to link. Rows that repeat a doc_id come back as often and are one document:
    it links where one of its texts does. n_links counts the other documents that a text links to, and
    those of the same set. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    stats = written(docs.mapInArrow(_stats(k), "doc_id long, n long, fp long, fp2 long, chunk int, task int, counts binary"), "shingle-stats")
    tasks = stats.agg(F.max("task")).first()[0]
    per_doc = stats.where("chunk is null").select("doc_id", "n", "fp", "fp2")
    if tasks is None:
        return per_doc.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    sketch = spark.sparkContext.broadcast(summed(stats.where("chunk is not null").select("chunk", "task", "counts"), tasks + 1))
    key = ["fp", "fp2"]
    classes = per_doc.where("n > 0").groupBy(*key, "n").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("weight"))

    # tokens of several classes; a common one is kept as it is, in PARTS parts
    tokens = docs.mapInArrow(_tokens(k, percent, sketch), "token long, fp long, fp2 long, n long, common long")
    of_token = Window.partitionBy("token", "part")
    shared = tokens.withColumn("part", F.when(F.col("common") > 0, F.pmod("fp", F.lit(PARTS)))).withColumn("low", F.min("fp").over(of_token)).withColumn("high", F.max("fp").over(of_token)).withColumn("sharing", F.count("*").over(of_token)).where("low < high or common > 0")
    shared = written(shared.select("token", *key, "n", F.greatest("sharing", "common").alias("sharing")).distinct(), "shared-tokens")

    # groups: classes of about one size with the same most shared token, split into about equal parts
    home = shared.groupBy(*key, "n").agg(F.max_by("token", F.struct("sharing", "token")).alias("home"))
    home = home.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(1.1)))).withColumn("share", F.pmod("fp", F.lit(PARTS)))
    # members of a home are counted in PARTS shares, and each share learns the sum
    shares = home.groupBy("home", "band", "share").agg(F.count("*").alias("members"))
    sizes = shares.groupBy("home", "band").agg(F.sum("members").alias("members"), F.collect_list("share").alias("shares"))
    sizes = sizes.select("home", "band", "members", F.explode("shares").alias("share"))
    split = F.pmod(F.xxhash64("fp"), F.ceil(F.col("members") / F.lit(group)))
    grouped = written(home.join(sizes, ["home", "band", "share"]).select(*key, "n", F.xxhash64("home", "band", split).alias("grp")), "groups")
    member = shared.join(grouped, [*key, "n"])
    matrix = member.groupBy("token", "grp").agg(F.count("*").alias("classes"), F.min("n").alias("least"), F.max("n").alias("most"))
    query = member.select("token", *key, "n", F.col("grp").alias("own"))
    n, least, most = F.col("n"), F.col("least"), F.col("most")

    def need_of(size):
        return F.ceil(size * percent / F.lit(100))

    def more(size):
        """Shared tokens that sizes n and `size` ask for beyond l."""
        return F.ceil((n + size) * percent / F.lit(100 + percent)) - F.greatest(need_of(n), need_of(size))

    reachable = (least * percent <= n * 100) & (most * 100 >= n * percent)
    others = (F.col("own") != F.col("grp")) | (F.col("classes") > 1)  # in its own group a query is no partner of itself
    bound = query.join(matrix, "token").where(reachable & others).groupBy(*key, "n", "own", "grp").agg(F.count("*").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))
    lo, hi = F.greatest(least, need_of(n)), F.least(most, F.floor(n * 100 / F.lit(percent)))
    few = F.least(F.lit(HITS), need_of(F.least(n, lo)))
    # between two sizes, `more` is least at one of them, up to rounding
    opened = bound.where(F.col("hits") >= few + F.greatest(F.lit(0), F.least(more(lo), more(hi)) - 1))
    # a row for each class with the pairs it is open in: its text is fetched and hashed once
    pair = F.struct(F.least("own", "grp").alias("lo"), F.greatest("own", "grp").alias("hi"))
    opened = opened.groupBy(*key, "n", F.col("own").alias("grp")).agg(F.collect_set(pair).alias("pairs"))
    opened = written(opened.join(classes, [*key, "n"]).select(F.col("rep").alias("doc_id"), *key, "n", "weight", "grp", "pairs"), "opened")
    work = docs.join(opened.hint("merge"), "doc_id").mapInArrow(_sets(k), "fp long, rep long, n long, weight long, grp long, lo long, hi long, shingles binary")
    found = written(work.groupBy("lo", "hi").applyInPandas(_compare(percent), "a long, b long, n long, w long"), "links")

    # a document of several texts connects their classes
    several = per_doc.where("n > 0").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id")
    texts = per_doc.join(several, "doc_id", "left_semi").join(classes.select(*key, "rep"), key).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comp = components(found.where("b is not null").select("a", "b").unionByName(texts))
    degree = found.where("b is null").groupBy(F.col("a").alias("fp"), "n").agg(F.sum("w").alias("linked"))
    of_class = classes.join(comp, F.col("rep") == F.col("node"), "left").join(degree, ["fp", "n"], "left")
    of_class = of_class.select(*key, F.coalesce("component", "rep").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return per_doc.join(of_class, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: The same rows by comparing every pair that shares a shingle.
SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents where doc_id is not null
), x as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
s as (
  select doc_id, concat_ws(' ', x, a, b, c, d) as t from (
    select doc_id, x, lead(x, 1) over q as a, lead(x, 2) over q as b, lead(x, 3) over q as c, lead(x, 4) over q as d from x window q as (partition by doc_id order by p)
  ) where d is not null
  union select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4
), n as (select w.doc_id, count(t)::bigint as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
e as (select doc_id, t from (select doc_id, t, count(*) over (partition by t) as k from s) where k > 1),
links as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.t = b.t and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach as (
  select doc_id as d, doc_id as c from n
  union select l.b, r.c from reach r join links l on l.a = r.d
)
select n.doc_id, n.n as n_shingles, c.c as component_id, coalesce(k.k, 0)::bigint as n_links
from n join (select d, min(c) as c from reach group by d) c on c.d = n.doc_id
left join (select a, count(*) as k from links group by a) k on k.a = n.doc_id
"""
