"""Language identification with error-correcting output codes.

Each language has a codeword of bits; a binary classifier for each bit says on which side of the code a
text lies. A classifier weighs hashed byte n-grams (1 to 3 bytes of the letters, digits folded away) by
the log odds of their counts in the languages of either side, as a naive Bayes classifier with equal
priors does, so it is learned from counts that sum over all labelled texts: nothing is sampled. The bits'
mean margins, scaled by their spread on the training texts, are decoded by loss: the language
whose codeword has the least sum of exp(-bit * margin) wins. The score is its share of the sum of
exp(-loss) over all codewords. The gap of a text is the mean margin by which its language beats another
on the bits that tell the two apart, for the closest other language: about 1 for a text like those
learned from, 0 for a tie and 2a - 1 for a mix of two languages with a share a of the one, for any number of
languages. A text with a gap below a limit is ambiguous; the limit is AMBIGUOUS, or less where more
than CLEAN of the rightly identified training texts would fall below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import lean, table, written
from framewell.llm.words import pieces, text_bytes

#: Text bytes worked on at once: their n-grams take some 100 times as much.
PIECE = 1 << 18
#: Hashed n-grams.
DIMS = 1 << 14
NGRAMS = 3
#: Bits of a code for more than five languages, and 16 for each binary digit of their number beyond 64; for few, all ways to part them.
BITS = 32
#: Gaps below this are ambiguous: the second language has over a third of the text.
AMBIGUOUS = 0.30
#: Share of the clean training texts that may be ambiguous.
CLEAN = 0.01
#: Steps of a gap that training counts apart.
STEPS = 100
FOLDS = 5


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language. Up to five languages: every way to part them; more: BITS rows of fixed pseudorandom halves, far apart."""
    if languages <= 1:
        return np.ones((languages, 1), np.int64)
    if languages <= 5:
        parts = np.arange(1, 1 << (languages - 1))
        return np.array([[1 if p >> i & 1 else -1 for p in parts] for i in range(languages)])
    bits = BITS if languages <= 64 else 16 * languages.bit_length()
    best, apart = None, -1
    for seed in range(64 if languages <= 64 else 1):  # many random codewords are apart without a search
        rng = np.random.default_rng(seed)
        code = np.stack([rng.permutation(np.where(np.arange(languages) < languages // 2, 1, -1)) for _ in range(bits)], 1)
        if languages > 64:
            return code
        least = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


#: Bytes as they count: ASCII letters fold to lower case, other ASCII to spaces.
_FOLDED = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint32)


def grams(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that lie in one row, and n + 1 borders of the rows among them. ASCII letters fold to lower case, other ASCII to spaces."""
    b = _FOLDED[data]
    row_of = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    found, at = [], []
    for k in range(1, NGRAMS + 1):
        n = len(b) - k + 1
        if n <= 0:
            continue
        x = np.full(n, k, np.uint32)
        for i in range(k):
            x = (x << np.uint32(8)) | b[i : i + n]
        x = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)
        inside = row_of[:n] == row_of[k - 1 :]
        found.append(x[inside])
        at.append(row_of[:n][inside])
    # each length's n-grams are in order of their rows, so that a row's places follow from the counts
    counts = np.maximum(np.diff(borders) - np.arange(NGRAMS)[:, None], 0)
    border = np.concatenate([[0], np.cumsum(counts.sum(0))])
    out, start = np.zeros(border[-1], np.int64), border[:-1].copy()
    for x, row, n in zip(found, at, counts):
        out[np.arange(len(x)) + (start - (np.cumsum(n) - n))[row]] = x
        start += n
    return out, border


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, texts) of the task: gram -1 has the number of texts."""
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            x, border = grams(*text_bytes(piece.column(0)))
            langs = piece.column(1).to_pylist()
            for lang in set(langs):
                rows = [i for i, v in enumerate(langs) if v == lang]
                texts[lang] = texts.get(lang, 0) + len(rows)
                part = np.bincount(np.concatenate([x[border[i] : border[i + 1]] for i in rows]), minlength=DIMS)
                total[lang] = total.get(lang, 0) + part
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(n[at], texts[lang]))], names=["lang", "gram", "n"])


class Model:
    def __init__(self, langs: list[str], counts: Callable[[], Iterable[tuple[str, int, int]]]) -> None:
        """langs in order; counts() gives (language, n-gram, n) as often as it is called. What is held grows with the bits of the code, not with the languages."""
        self.langs, self.code = langs, codewords(len(langs))
        bits, at = self.code.shape[1], {v: i for i, v in enumerate(langs)}
        size = np.full(len(langs), 0.5 * DIMS)
        for lang, _, n in counts():
            size[at[lang]] += n
        sides = [self.code > 0, self.code < 0]  # languages x bits
        share = np.zeros((2, bits, DIMS))
        for side, member in zip(share, sides, strict=True):
            side += (0.5 / size @ member)[:, None]
        for lang, gram, n in counts():
            i = at[lang]
            share[0, sides[0][i], gram] += n / size[i]
            share[1, sides[1][i], gram] += n / size[i]
        self.weights = np.zeros((bits, DIMS), np.float32)
        self.middle, self.scale = np.zeros(bits), np.ones(bits)
        if len(langs) > 1:
            members = np.stack([m.sum(0) for m in sides])
            self.weights = (np.log(share[0] / members[0][:, None]) - np.log(share[1] / members[1][:, None])).astype(np.float32)
            # mean margins of the two sides, from the counts themselves
            plus, minus = (np.einsum("bd,bd->b", s, self.weights) / m for s, m in zip(share, members, strict=True))
            self.middle, self.scale = (plus + minus) / 2, np.maximum(1e-6, (plus - minus) / 2)
        self.limit = AMBIGUOUS

    def predict(self, x: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, gap to the closest other language) for each row; with one language the gap is 1."""
        rows, bits = len(border) - 1, len(self.weights)
        margin = np.zeros((rows, bits))
        n = np.diff(border)
        if len(x):
            full = n > 0
            for j in range(bits):
                margin[full, j] = np.add.reduceat(self.weights[j].astype(np.float64).take(x), border[:-1][full]) / n[full]
        margin = np.clip((margin - self.middle) / self.scale, -3, 3)
        loss = np.cosh(margin).sum(1, keepdims=True) - np.sinh(margin) @ self.code.T  # the sum of exp(-bit * margin)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(rows), best]
        if p.shape[1] == 1:
            return best, score, np.ones(rows)
        # codewords differ where their product is -1, so both sums count each of those bits twice
        total, apart = margin @ self.code.T, bits - (self.code @ self.code.T)[best]
        apart[np.arange(rows), best] = 1
        gap = (total[np.arange(rows), best][:, None] - total) / apart
        gap[np.arange(rows), best] = np.inf
        return best, score, gap.min(1)


def train(docs: DataFrame) -> Model | None:
    """From all rows of docs(text, lang) where neither is null, for any number of languages; None if there are none."""
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    counts = written(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    langs = sorted(r.lang for r in counts.where("gram = -1").select("lang").collect())  # a row for each language
    if not langs:
        return None
    grams_ = counts.where("gram >= 0")
    model = Model(langs, lambda: ((r.lang, r.gram, r.n) for r in grams_.toLocalIterator()))  # DIMS rows a language at most
    if len(langs) > 1:
        model.limit = min(AMBIGUOUS, clean_gap(rows, model))
    return model


def clean_gap(rows: DataFrame, model: Model) -> float:
    """The largest step of a gap with at most CLEAN of the rightly identified rows(text, lang) below it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros(6 * STEPS + 1, np.int64)  # margins lie in -3 .. 3
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                best, _, gap = model.predict(*grams(*text_bytes(piece.column(0))))
                right = np.array([model.langs[i] == lang for i, lang in zip(best, piece.column(1).to_pylist(), strict=True)], bool)
                total += np.bincount(np.clip((gap[right] + 3) * STEPS, 0, 6 * STEPS).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["step", "n"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n")).collect())
    below, all_ = 0, sum(n for _, n in found)
    for step, n in found:
        below += n
        if below > CLEAN * all_:
            return step / STEPS - 3
    return AMBIGUOUS


def identify(docs: DataFrame, model: Model | None, ambiguous: float | None = None) -> DataFrame:
    """docs plus (lang_pred, score, ambiguous), from the whole text alone; gaps below `ambiguous`, by default the model's limit, are ambiguous.

    A null text, or one without a letter, is `und` with score 0 and ambiguous, and so is every text without
    a model. Columns of docs with the new names are replaced; rows are kept as they come.
    """
    new = {"lang_pred", "score", "ambiguous"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                col = piece.column(next(i for i, c in enumerate(piece.schema.names) if c.lower() == "text"))
                letter = pc.fill_null(pc.match_substring_regex(col, r"\pL"), False).to_numpy(zero_copy_only=False)
                if model is None:
                    letter = np.zeros(len(piece), bool)
                    best, score = np.zeros(len(piece), np.int64), np.zeros(len(piece))
                else:
                    best, score, gap = model.predict(*grams(*text_bytes(col)))
                names = [model.langs[i] if k else "und" for i, k in zip(best, letter, strict=True)]
                score = np.where(letter, score, 0.0)
                unsure = ~letter if model is None else ~letter | (gap < (model.limit if ambiguous is None else ambiguous))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=[*piece.schema.names, "lang_pred", "score", "ambiguous"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("ambiguous", F.lit(False)).schema
    for f in schema:
        f.nullable = True
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train_fold(docs: DataFrame) -> Model | None:
    return train(docs.where(~held_out(F.col("doc_id"))))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return identify(rows, train_fold(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
