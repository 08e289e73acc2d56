"""License scans, importance resampling and fill-in-the-middle against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewell.llm import fill_in_middle as M
from framewell.llm import license_scan as L
from framewell.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(L._UPPER, L._LOWER)))


# ---- license scans


def scanned(texts, templates):
    """(n_words, n_base, first, last, base_labels, labels, score) of each text, every alignment tried."""
    docs = [words(t) for t in texts]
    segments = L.segments_of(templates)
    df = Counter(w for d in docs for w in set(d))
    rarity = {w: 1 + math.floor(1000 * math.log((len(docs) + 1) / (df[w] + 1))) for s in segments for w in s.words}
    L.indexed(segments, rarity)
    out = []
    for d in docs:
        base, found, score = [], set(), 0.0
        for n, s in enumerate(segments):
            for start in range(-len(s.words), len(d)):
                stands = [0 <= start + k < len(d) and d[start + k] == w for k, w in enumerate(s.words)]
                if sum(stands[k] for k in s.posted) < min(L.AGREE, len(s.posted)):
                    continue
                score = max(score, sum(w for w, x in zip(s.weights, stands, strict=True) if x) / sum(s.weights))
                if all(x or not m for x, m in zip(stands, s.must, strict=True)):
                    found.add(n)
                    base += [start] if templates[s.template].base else []
        whole = [t for i, t in enumerate(templates) if all(n in found for n, s in enumerate(segments) if s.template == i)]
        out.append((len(d), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({t.label for t in whole if t.base})), ",".join(sorted({t.label for t in whole})), score))
    return out


def test_license_scan_against_brute_force(spark):
    rng = random.Random(4)
    notices = [re.sub(r"[\[\]]", "", s) for t in L.TEMPLATES for s in t.segments]
    texts = [None, "", " .,; ", "UNDER the MIT-license", "KK under the mıt license", "é under\nthe\tMIT  License!! under the mit license under the mit license", "apache license version 2.0", "Apache Licence, Version 2", "cc by nc cc by nc by", "all rights reserved", "\U0001f600 CC-BY-NC ", "license " * 300]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = words(rng.choice(notices))
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(["the", "license", "x", "software"])
            parts += [" ".join(w), " ".join(rng.choices(["the", "of", "mit", "by", "license", "under", "zebra"], k=rng.randint(0, 9)))]
        texts.append(" # ".join(parts))
    docs = spark.createDataFrame([(i % 50, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, word string")
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.license_scan(docs).collect())))
    want = scanned(texts, L.TEMPLATES)
    assert got == sorted(str((i % 50, *w[:6], round(w[6], 9))) for i, w in enumerate(want))
    assert sum(w[1] for w in want) > 15 and len({w[5] for w in want}) > 10
    assert want[4][5] == "" and want[3][4] == "mit"


def test_license_scan_of_nothing_and_own_templates(spark):
    docs = spark.createDataFrame([(None, "some words of ours stand here"), (None, "some words of yours")], "doc_id long, text string")
    own = [L.Template("ours", ["words of [ours]"]), L.Template("both", ["[some words]", "[stand here]"])]
    assert sorted((r.labels, r.n_base, r.base_labels) for r in L.license_scan(docs, own).collect()) == [("", 0, ""), ("both,ours", 0, "")]
    assert L.license_scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="mandatory"):
        L.license_scan(docs, [L.Template("none", [" . "])])


def test_long_text_of_license_words(spark):
    docs = spark.createDataFrame([(1, "x " * 50_000 + "under the MIT license " * 2000)], "doc_id long, text string")
    r = L.license_scan(docs).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (58_000, 2000, 50_000, 57_996, "mit")


# ---- importance resampling


def drawn(rows, target, longest, buckets, percent, least, seed):
    def features(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    docs = [(k, *features(t)) for k, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for k, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    many = sorted((-x[4], -1 if x[0] is None else x[0]) for x in out if x[1] >= least)
    return out, many[: percent * len(many) // 100]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_resampling_against_brute_force(spark, longest, buckets):
    rng = random.Random(7)
    vocabulary = ["the", "Über", "x1", "日本", "a", "ÀB", "end", "of", "zu", "Kelvin"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", "\n", "\x00 a", "-b"])) for i in range(300)]
    rows += [(None, None), (None, "a b c " * 20), (5, ""), (7, rows[7][1]), (400, "w" * 5000 + " x" * 30)] + [(9, "the of " * 30)] * 40
    target = ["the of zu end " * 9, None, "日本 über"]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.importance(docs, aim, longest=longest, buckets=buckets).collect()
    want, taken = drawn(rows, target, longest, buckets, R.PERCENT, R.MIN_WORDS, R.SEED)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(taken) + 1)) and [(-r.score, -1 if r.doc_id is None else r.doc_id) for r in ranked] == taken
    kept = R.resample(docs, aim, longest=longest, buckets=buckets)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in ranked}


def test_resampling_ties_and_nothing(spark):
    """One key and text in all rows: as many are drawn as are asked for."""
    docs = spark.createDataFrame([(None, "a b c d " * 6)] * 500, "doc_id long, text string").repartition(6)
    aim = spark.createDataFrame([], "text string")
    ranks = [r["rank"] for r in R.importance(docs, aim).collect() if r["rank"]]
    assert sorted(ranks) == list(range(1, 51))
    assert R.importance(docs.limit(0), aim).count() == 0
    assert R.importance(docs.limit(5), aim).where("rank is not null").count() == 0, "a tenth of five rows is none"


def test_ngrams_do_not_cross_documents():
    row, bucket = zip(*R.feature_buckets(pa.array(["a b", None, "", "c", "b a b"]), 2, 1 << 32), strict=True)
    crc = lambda s: zlib.crc32(s.encode())
    assert row[0].tolist() == [0, 0, 3, 4, 4, 4] and bucket[0].tolist() == [crc(w) for w in "abcbab"]
    assert row[1].tolist() == [0, 4, 4] and bucket[1].tolist() == [crc("a b"), crc("b a"), crc("a b")]


# ---- fill-in-the-middle


def test_borders_select():
    rng = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1), (5, 9), (3000, 10**6), (60_000, 70_000), (20_000, 1 << 16), (65_536, 1 << 16), (200, 1 << 20), (100_000, 400_000)):
        offsets = np.sort(rng.choice(top, n, replace=False)).astype(np.int64)
        found = M.Borders(offsets)
        assert len(found) == n and [found.select(k) for k in range(0, n, max(1, n // 500))] == offsets[:: max(1, n // 500)].tolist()
        with pytest.raises(IndexError):
            found.select(n)
    kinds = {type(c).__name__ for o in (np.arange(100_000), np.arange(0, 60_000, 3), np.arange(0, 10**6, 900)) for c in M.Borders(o).containers}
    assert kinds == {"RunContainer", "BitmapContainer", "ArrayContainer"}


def cut(key, text, seed, rate, spm):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (3, 60, 0), (1, 0, 50)])
def test_fill_in_middle_against_brute_force(spark, seed, rate, spm):
    rng = random.Random(11)
    parts = ["a", "é", "日本", "\U0001f600", "\n", "\n", "\r\n", " ", "<", "<P", "P>", " ", "\x0b"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, None), (None, "a\nb\n"), (1, ""), (2, "\n"), (3, "x<P>\ny"), (4, "<S>"), (5, "\n" * 100_000), (6, "ab\n" * 60_000), (7, "é" * 70_000 + "\n" + "z" * 9), (7, "twice\nagain\n"), (8, "<M"), (9, "line\r\nline")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _H1 string, N string")
    out = M.fill_in_middle(docs, seed=seed, rate=rate, spm=spm)
    assert out.columns == ["doc_id", "text", "_H1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", M.restored(F.col("output"), F.col("form")).alias("again"), "text").collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(str((k, *cut(k, t, seed, rate, spm))) for k, t in rows)
    assert all(r.again == (r.text or "") for r in got)
    assert M.fill_in_middle(docs.limit(0)).count() == 0


def test_sentinels():
    M.check_sentinels(("<fim-prefix>", "<fim-suffix>", "<fim-middle>"))
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d"), ("aba", "x", "y"), ("ab", "abc", "x"), ("xab", "ab", "y")):
        with pytest.raises(ValueError, match="sentinel"):
            M.check_sentinels(bad)
