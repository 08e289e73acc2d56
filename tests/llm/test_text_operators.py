"""Operators on texts against brute force, on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.llm import decontaminate, ngram_join, quality_rules, substring_dedup

BLANK = re.compile(r"[\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, component_id string, n_words string, known string, key string"


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ß", "a\u00a0b", "ⅷ"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", "\x0b"]) for _ in range(n))

    texts = [None, "", " \n\t", "one", "one two", "ONE two", "one two three four", "a b c d e"]
    base = [text(rng.randint(20, 120)) for _ in range(25)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for b in base:
        texts.append(b)
        if rng.random() < 0.7:
            edited = words(b)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
        if rng.random() < 0.4:
            texts.append(b)
        if rng.random() < 0.4:
            texts.append(text(15) + passage + " " + text(10))
    texts.append(" ".join(["again and"] * 300))
    texts.append(text(20_000))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [rows[12]]  # a repeated row


def frame(spark, rows, schema=EXTRA):
    return spark.createDataFrame([(i, t, "x", None, "y", None) for i, t in rows], schema)


def shingles(text, k=5):
    ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def deduplicated(rows):
    """(words, words removed, digest of the rest) of each row."""
    first = {}
    for i, t in rows:
        ws = words(t)
        for p in range(len(ws) - 12):
            w = tuple(ws[p : p + 13])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        ws, gone = words(t), set()
        for p in range(len(ws) - 12):
            if first[tuple(ws[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


def test_substring_dedup(spark):
    rows = corpus()
    want = deduplicated(rows)
    assert digests(substring_dedup.substring_dedup(frame(spark, rows))) == want
    assert any(v[2] for v in want)


def test_substring_dedup_with_several_texts_of_one_id(spark):
    rng = random.Random(21)
    a, b = (" ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (4, a + " tail"), (4, "x " * 40 + b), (4, "x " * 40 + b), (2, b), (4, None), (3, "x " * 40)]
    assert digests(substring_dedup.substring_dedup(frame(spark, rows))) == deduplicated(rows)


@pytest.mark.parametrize(("group", "common"), [(10, 1 << 12), (20_000, 1), (3, 2)])
def test_prefixes_over_the_bound_are_lengthened(spark, monkeypatch, group, common):
    """A phrase that many documents share: its suffixes go by all their words, and none is lost."""
    from framewell.llm import sketch

    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "COMBINE", 4000)
    monkeypatch.setattr(sketch, "COMMON", common)
    rng = random.Random(22)
    phrase = "the one common phrase that all the documents of this small table hold in them".split()
    rows = corpus(3)
    for i in range(60):
        ws = [f"z{rng.randrange(40)}" for _ in range(30)]
        ws[rng.randrange(30) : 0] = phrase
        rows.append((1000 + i, " ".join(ws * 2)))
    assert digests(substring_dedup.substring_dedup(frame(spark, rows).repartition(5))) == deduplicated(rows)


def test_subtree_against_all_pairs():
    rng = np.random.default_rng(5)
    suffixes, doc = rng.integers(0, 2, (400, 5)).astype(np.uint64), rng.integers(0, 30, 400)
    least = {}
    for x, d in zip(map(tuple, suffixes.tolist()), doc.tolist(), strict=True):
        least[x] = min(d, least.get(x, d))
    assert substring_dedup.subtree(suffixes, doc).tolist() == [d > least[tuple(x)] for x, d in zip(suffixes.tolist(), doc.tolist(), strict=True)]


def test_substring_dedup_over_pieces(spark, monkeypatch):
    rows = corpus(5)
    whole = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    monkeypatch.setattr(substring_dedup, "COMBINE", 500)
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    small = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(frame(spark, rows).repartition(7)).collect()}
    assert whole == small


def test_ngram_join(spark):
    rows = corpus(2)
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}
    degree = dict.fromkeys(sets, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            degree[a] += 1
            degree[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert sum(degree.values()) > 20
    once = ngram_join.ngram_join(frame(spark, dict(rows).items())).collect()
    assert {r.doc_id: r.n_links for r in once} == degree


def test_ngram_join_with_one_hot_group(spark, monkeypatch):
    """Near copies in groups of a few classes: links that span groups are found."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(70):
        ws = list(base)
        ws[rng.randrange(60)] = f"u{i}"
        rows.append((i, " ".join(ws)))
    got = ngram_join.ngram_join(frame(spark, rows), group=4).collect()
    sets = {i: shingles(t) for i, t in rows}
    degree = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    assert {r.doc_id: r.n_links for r in got} == degree
    assert {r.component_id for r in got if r.n_links} == {0}


def test_ngram_join_with_several_texts_of_one_id(spark):
    rng = random.Random(13)
    a, b, c = ([f"t{rng.randrange(10**6)}" for _ in range(80)] for _ in range(3))
    near = lambda ws, i: " ".join([*ws[:-1], f"x{i}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a, 7)), (8, near(b, 8)), (9, " ".join(c)), (3, " ".join(c)), (9, " ".join(c)), (11, near(c, 11)), (6, "alone " * 9), (9, near(a, 9))]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i if i == 6 else 3) for i, _ in rows}
    got = ngram_join.ngram_join(frame(spark, rows[:-1])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (8, 5), (9, 3), (3, 3), (11, 3), (6, 6)}
    assert {(r.doc_id, r.n_links) for r in got} == {(5, 1), (7, 1), (8, 1), (9, 2), (3, 2), (11, 2), (6, 0)}  # a repeated row is no other document


def test_ngram_join_with_common_tokens(spark, monkeypatch):
    """Tokens that count as common are dealt to parts: no link is lost."""
    from framewell.llm import sketch

    rows = corpus(7)
    plain = {(r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    monkeypatch.setattr(sketch, "COMMON", 1)
    assert {(r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_join(frame(spark, rows), group=3).collect()} == plain


def test_sketch_counts_scale():
    from framewell.llm.sketch import SLOTS, Counts

    counts = np.full(SLOTS, 5_000_000, np.int64)
    counts[:10] = [2**40 + i for i in range(10)]
    found = Counts(counts)
    assert (found.common(np.arange(10, dtype=np.uint64)) > 2**39).all() and not found.common(np.arange(10, 100, dtype=np.uint64)).any()
    assert (np.diff(Counts(np.arange(SLOTS)).of(np.arange(1000, dtype=np.uint64)).astype(int)) > 0).all()


def test_decontaminate(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 6, 8, 15, 40, 57, 200])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "tiny"), (None, "no id at all in this row"), (5, items[5][1])]
    rows = [(0, None), (1, ""), (2, "tiny"), (3, "TINY"), (4, "tiny but more")]
    for i in range(80):
        ws = rng.choices(vocabulary, k=rng.choice([10, 300, 4000]))
        if i % 2:
            part = words(items[rng.randrange(60)][1])
            for _ in range(rng.randint(0, 1 + len(part) // 30)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(ws))
            ws[at:at] = part
        rows.append((10 + i, " ".join(ws)))
    rows.append(rows[-1])
    want = set()
    for i, t in rows:
        have = shingles(t)
        for j, u in items:
            s = shingles(u)
            if j is not None and s and 100 * len(s & have) >= 80 * len(s):
                want.add((i, j, len(s), len(s & have)))
    bench = spark.createDataFrame([(j, u, "z") for j, u in items], "item_id long, text string, doc_id string")
    docs = frame(spark, rows)
    got = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in {w[0] for w in want})


def base_counts(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for p in range(len(ws) - 7):
        at.setdefault(tuple(ws[p : p + 8]), []).append(p)
    covered = {q for ps in at.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rows = corpus(6) + [(900, "x y z " * 10 + "\n" + "x y z " * 10 + "\n" + "\n".join(["same line here"] * 9)), (901, "## $$ %% " * 30)]
    docs = spark.createDataFrame([(i, t, [None, "en", "de"][i % 3], [None, "s"][i % 2], 1) for i, t in rows], "doc_id long, text string, lang string, source string, kept int")
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, lines, repeat = base_counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat), r.doc_id
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[901].kept and sum(r.kept for r in got) > 20


def test_cutoffs_are_quantile_fences(spark):
    rng = random.Random(9)
    names = list(quality_rules.MEASURES)
    rows = []
    for lang, source, n in (("en", "a", 300), ("en", "b", 40), ("de", "a", 1), (None, None, 25)):
        for _ in range(n):
            values = [rng.gauss(5, 0.4 if source == "a" else 0.1), rng.choice([0.0, 0.0, 0.0, 0.0, rng.random()]), rng.choice([0.0] * 9 + [0.3 + rng.random() / 9]), rng.random() / 9]
            rows.append((lang, source, rng.random() < 0.1, *values))
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"{m} double" for m in names))

    def quantile(x, q):
        return sorted(x)[max(0, math.ceil(len(x) * q) - 1)] if x else 0.0

    def says(of, i):
        x, some, every = ([r[3 + i] for r in of], [r[3 + i] for r in of if r[3 + i] > 0], [r[3 + i] for r in good if r[3 + i] > 0])
        low, high, tail = (quantile(x, q) for q in (0.25, 0.75, 127 / 128))
        if high > low:
            value = high + quality_rules.FENCE * (high - low)
        elif high == 0 and quantile(every, 1 / 64) > quantile(every, 0.5) / 4:
            value = quantile(some, 1 / 64) / 2
        else:
            value = tail
        return value * (1 + 1 / 32)

    good = [r for r in rows if not r[2]]
    for got in quality_rules.cutoffs(df).collect():
        own, wide = [r for r in good if r[:2] == (got.lang, got.source)], [r for r in good if r[0] == got.lang]
        assert got.members == len(own)
        for i, m in enumerate(names):
            of_lang = (len(wide) * says(wide, i) + 100 * says(good, i)) / (len(wide) + 100)
            assert got[f"max_{m}"] == pytest.approx((len(own) * says(own, i) + 100 * of_lang) / (len(own) + 100))


def test_sources_get_cutoffs_of_their_own(spark):
    """The same text stays where such texts are usual and goes where they are not."""
    rng = random.Random(11)

    def text(symbols, i):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        return " ".join(w + "###" if k < symbols else w for k, w in enumerate(ws)) + f" t{i}"

    rows = [(i, text(rng.randint(0, 30), i), "en", "code") for i in range(1500)] + [(i, text(0, i), "en", "prose") for i in range(1500, 3000)]
    odd = text(30, "odd")
    docs = spark.createDataFrame([*rows, (9001, odd, "en", "code"), (9002, odd, "en", "prose")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert got[9001] and not got[9002] and all(got[i] for i, *_ in rows)


def test_learned_cutoffs_decide(spark):
    """On the given documents each measure's cutoff rejects rows that pass the base rules, and most rows stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.written(quality_rules.measured(docs), "measures")
    limits = quality_rules.cutoffs(rows).withColumnsRenamed({"lang": "l", "source": "s"})
    good = rows.join(limits, F.expr("lang <=> l and source <=> s")).where("not base_failed")
    over = good.agg(F.count("*").alias("n"), *[F.count_if(F.col(m) > F.col(f"max_{m}")).alias(m) for m in quality_rules.MEASURES]).first()
    assert all(over[m] > 0 for m in quality_rules.MEASURES)
    kept = quality_rules.quality_rules(docs).where("kept").count()
    assert kept > 0.85 * over.n
    # no constant is a cutoff: cutoffs differ from group to group, and none is 0
    seen = limits.select(*[F.count_distinct(f"max_{m}").alias(m) for m in quality_rules.MEASURES], F.count("*").alias("n"), F.min(F.least(*[f"max_{m}" for m in quality_rules.MEASURES])).alias("least")).first()
    assert seen.least > 0 and all(seen[m] > 0.5 * seen.n for m in quality_rules.MEASURES)


def test_values_apart_from_zero_go_and_a_tail_stays(spark):
    """Where most texts measure 0: a cluster away from 0 is cut off in the gap, a run from 0 upward only at its tail."""
    rng = random.Random(12)
    rows = [("en", "s", False, 5 + rng.random() / 9, 0.2 + rng.random() / 9 if i % 10 == 0 else 0.0, 0.0, rng.random() / 4 if i % 10 == 1 else 0.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"{m} double" for m in quality_rules.MEASURES))
    got = quality_rules.cutoffs(df).first()
    assert 0.09 < got.max_symbol_share < 0.13
    above = sum(r[6] > got.max_repeat_share for r in rows)
    assert 0 < above < 20 and got.max_dup_line_share == 0


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, ngram_join.ngram_join])
def test_empty_and_null_ids(spark, operator):
    assert operator(frame(spark, [])).collect() == []
    assert [r.doc_id for r in operator(frame(spark, [(None, "a b"), (1, None)])).collect()] == [1]


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([(1, "some words of an item to look for")], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.contaminated(frame(spark, [(1, "x")]), bench.limit(0)).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules.quality_rules(empty).count() == 0
