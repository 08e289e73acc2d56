"""License scans over a positional index of rare words.

Templates are labels with one or more segments of licence text. The index posts each segment under its rarest words,
by how many documents hold them, with their places in the segment. A text's words are looked up in it; each hit says
where the segment would have to start, and postings that agree on that start are an alignment. Its segment is
then compared word by word, weighted by rarity, and counts as found where all words of its mandatory phrases stand
in their places. A template's label is given where all its segments are found.

Templates are a parameter, so the index fits every task and is broadcast; a phrase of the base rules is a template whose
whole text is mandatory, and since the words that it is posted under stand in each of its places, none is missed.
Texts are read twice: once for the counts of licence words, once for the search. A row of the one shuffle is a
document, never a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm.common import table
from framewell.llm.quality_rules import let

#: Words that a segment is posted under, and how many of them must agree on a start.
POSTED, AGREE = 3, 2
#: Words of the longest segment: a hit carries so many words before and after it.
LONGEST = 40
#: Segments at most, so that the index, some KB for each, stays fit for a broadcast.
SEGMENTS = 10_000

# Signs between words, and the words' case.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP_CHARS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


@dataclass(frozen=True)
class Template:
    """segments: text in which mandatory phrases stand between brackets; a text without brackets is mandatory as a whole."""

    label: str
    segments: Sequence[str]
    base: bool = False


@dataclass
class Segment:
    template: int
    words: list[str]
    must: list[bool]
    posted: list[int] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)


# The base rules' phrases, and sentences of well-known licence notices.
BASE = [
    Template("mit", ["under the MIT License"], True),
    Template("apache-2", ["Apache License, Version 2"], True),
    Template("cc-by-nc", ["CC BY-NC"], True),
]
NOTICES = [
    Template("mit", [
        "[Permission is hereby granted, free of charge,] to any person obtaining a copy of this software and associated documentation files",
        "to [deal in the Software without restriction,] including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ]),
    Template("isc", ["[Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted]"]),
    Template("bsd", ["[Redistribution and use in source and binary forms,] with or without modification, are [permitted provided that the following conditions are met]"]),
    Template("bsd-3", [
        "[Redistribution and use in source and binary forms,] with or without modification, are [permitted provided that the following conditions are met]",
        "[may be used to endorse or promote products derived from this software] without specific prior written permission",
    ]),
    Template("apache-2", ["[you may not use this file except in compliance with the License]"]),
    Template("gpl-2", ["[either version 2 of the License,] or at your option any [later version]", "[GNU General Public License as published by the Free Software Foundation]"]),
    Template("gpl-3", ["[either version 3 of the License,] or at your option any [later version]", "[GNU General Public License as published by the Free Software Foundation]"]),
    Template("gpl-2", ["licensed under the [GNU General Public License, version 2]"]),
    Template("gpl-3", ["licensed under the [GNU General Public License, version 3]"]),
    Template("lgpl", ["[GNU Lesser General Public License]"]),
    Template("agpl-3", ["[GNU Affero General Public License]"]),
    Template("mpl-2", ["This Source Code Form is [subject to the terms of the Mozilla Public License, v. 2.0]"]),
    Template("epl-2", ["This program and the accompanying materials are [made available under the terms of the Eclipse Public License 2.0]"]),
    Template("cc0", ["has [waived all copyright and related or neighboring rights] to this work"]),
    Template("cc-by", ["licensed under a [Creative Commons Attribution 4.0 International License]"]),
    Template("cc-by-sa", ["licensed under a [Creative Commons Attribution-ShareAlike 4.0 International License]"]),
    Template("cc-by-nc", ["licensed under a [Creative Commons Attribution-NonCommercial 4.0 International License]"]),
    Template("unlicense", ["This is [free and unencumbered software released into the public domain]"]),
    Template("all-rights-reserved", ["[All rights reserved]"]),
]
TEMPLATES = BASE + NOTICES


def segments_of(templates: Sequence[Template]) -> list[Segment]:
    out = []
    for i, t in enumerate(templates):
        for text in t.segments:
            words, must = [], []
            for k, part in enumerate(re.split(r"[\[\]]", text)):
                found = words_of(part)
                words += found
                must += [k % 2 == 1 or "[" not in text] * len(found)
            if not words or len(words) > LONGEST or not any(must):
                raise ValueError(f"a segment of {t.label} needs 1 to {LONGEST} words and a mandatory phrase: {text}")
            out.append(Segment(i, words, must))
    if len(out) > SEGMENTS:
        raise ValueError(f"{len(out)} segments are more than {SEGMENTS}")
    return out


def _words(text: Column) -> Column:
    """The words of a text: none for one without."""
    text = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_GAP_CHARS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _GAP))


def rarities(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """1 + floor(1000 ln((N + 1) / (n + 1))) for each of the words: n of the N documents hold it."""
    n = docs.count()
    held = docs.select(F.explode(F.array_intersect(_words(F.col("text")), F.lit(list(words)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in held.collect()}  # a row for each licence word at most
    return {w: 1 + math.floor(1000 * math.log((n + 1) / (found.get(w, 0) + 1))) for w in words}


def indexed(segments: list[Segment], rarity: dict[str, int]) -> list[Segment]:
    """The segments with their words' weights, and posted under the places of their rarest words, rarest first."""
    for s in segments:
        s.weights = [rarity[w] for w in s.words]
        places = sorted(range(len(s.words)), key=lambda k: (-s.weights[k], s.words[k], k))
        seen: set[str] = set()
        s.posted = [k for k in places if not (s.words[k] in seen or seen.add(s.words[k]))][:POSTED]
    return segments


def searched(s: Segment) -> list[int]:
    """The places whose words are looked up: of AGREE agreeing postings one at least is among the rarest, so the most frequent need not be."""
    return s.posted[: len(s.posted) - min(AGREE, len(s.posted)) + 1]


def postings(spark: SparkSession, segments: list[Segment]) -> DataFrame:
    """The index: a row for each segment and word that it is looked up by."""
    rows = [(s.words[k], n, k, s.posted, s.words, s.weights, s.must) for n, s in enumerate(segments) for k in searched(s)]
    return spark.createDataFrame(rows, "word string, segment int, offset int, posted array<int>, words array<string>, weights array<long>, must array<boolean>")


def hits(docs: DataFrame, lookup: Sequence[str]) -> DataFrame:
    """(columns of docs but text ..., n_words, at, word, first, context): a row for each word of the look-up, its place, and the words around it from `first` on; texts without one have a row of nulls."""
    width = 2 * LONGEST - 1

    def found(words: Column) -> Column:
        places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(list(lookup)), i)))
        first = lambda i: F.greatest(i - (LONGEST - 1), F.lit(0))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.transform(places, lambda i: F.struct(i.alias("at"), F.get(words, i).alias("word"), first(i).alias("first"), F.slice(words, first(i) + 1, F.lit(width)).alias("context"))).alias("hits"))

    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.explode(F.array(let(_words(F.col("text")), found))).alias("found"))
    return rows.select(*rest, "found.n_words", F.explode_outer("found.hits").alias("hit")).select(*rest, "n_words", "hit.*")


def alignments(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows of hits() plus (segment, start, share, verified) of each alignment once; hits of none, and texts without a hit, have a row of nulls."""
    start = F.col("at") - F.col("offset")

    def at(k: Column) -> Column:
        return F.get("context", start + k - F.col("first"))

    def agrees(k: Column) -> Column:
        return F.coalesce(at(k) == F.get("words", k), F.lit(False))

    agreeing = F.filter("posted", agrees)
    # an alignment counts at the first posting that agrees
    once = (F.get(agreeing, 0) == F.col("offset")) & (F.size(agreeing) >= F.least(F.lit(AGREE), F.size("posted")))
    stands = F.transform("words", lambda w, k: F.coalesce(at(k) == w, F.lit(False)))
    joined = rows.join(F.broadcast(index), "word", "left").withColumn("aligned", F.coalesce(once, F.lit(False)))
    weighed = joined.withColumn("stands", F.when(F.col("aligned"), stands))
    total = F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x)
    matched = F.aggregate(F.zip_with("weights", "stands", lambda x, s: F.when(s, x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    verified = F.forall(F.zip_with("must", "stands", lambda m, s: s | ~m), lambda x: x)
    of_alignment = {"segment": F.col("segment"), "start": start, "share": matched / total, "verified": verified}
    return weighed.select(*[c for c in rows.columns if c not in ("word", "at", "first", "context")], *[F.when(F.col("aligned"), v).alias(c) for c, v in of_alignment.items()])


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, segments) for each row of docs(key, text, ...).

    Words are runs of code points other than ASCII signs, A-Z lower-cased. n_base counts the places of base
    templates' text, first_word and last_word are the smallest and largest start, null without one; labels are
    those of the base templates found and of the others whose segments all are, sorted; score is the largest share of
    a segment's words, by rarity, at an alignment, 0 without one; segments are the numbers of the segments
    found. A null text is an empty one. Rows that repeat a key are scanned each for itself; a null key is
    kept. Extra columns are ignored. An empty table gives an empty result.
    """
    segments = segments_of(templates)
    words = sorted({w for s in segments for w in s.words})
    segments = indexed(segments, rarities(docs, words))
    lookup = sorted({s.words[k] for s in segments for k in searched(s)})
    # a number for each row: a key may stand in many
    rows = hits(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), "text"), lookup)
    found = alignments(rows, postings(docs.sparkSession, segments))
    base = [i for i, s in enumerate(segments) if templates[s.template].base]
    is_base = F.col("verified") & F.col("segment").isin(base)
    start = F.when(is_base, F.col("start").cast("long"))
    by_row = found.groupBy("row", "key", "n_words").agg(
        F.count_if(is_base).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("segment")))).alias("segments"),
    )

    def named(which: Sequence[int]) -> Column:
        """Labels of those templates whose segments all are found."""
        rules = [F.struct(F.lit(templates[i].label).alias("label"), F.array(*[F.lit(n) for n, s in enumerate(segments) if s.template == i]).alias("of")) for i in which]
        if not rules:
            return F.lit("")
        whole = F.filter(F.array(*rules), lambda t: F.size(F.array_except(t["of"], F.col("segments"))) == 0)
        return F.array_join(F.array_sort(F.array_distinct(F.transform(whole, lambda t: t["label"]))), ",")

    every = range(len(templates))
    return by_row.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", named([i for i in every if templates[i].base]).alias("base_labels"), named(every).alias("labels"), "score", "segments"
    )


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("segments")


def _sql() -> str:
    rows, labels = [], []
    segments = segments_of(TEMPLATES)
    for n, s in enumerate(segments):
        rows += [f"({n}, {k}, '{w}', {str(m).lower()})" for k, (w, m) in enumerate(zip(s.words, s.must, strict=True))]
        labels.append(f"({n}, {s.template}, '{TEMPLATES[s.template].label}', {str(TEMPLATES[s.template].base).lower()})")
    return rf"""
with seg(seg, k, word, must) as (values {", ".join(rows)}), lab(seg, tpl, label, base) as (values {", ".join(labels)}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
x as materialized (select doc_id, p, word from (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as p from d) where word in (select word from seg)),
df as (select word, count(distinct doc_id) as n from x group by word),
sw as materialized (select seg.*, 1 + floor(1000 * ln(((select count(*) from d) + 1)::double / (coalesce(df.n, 0) + 1)))::bigint as w from seg left join df using (word)),
po as (select *, count(*) over (partition by seg) as m from (select seg, arg_min(k, k) as k, word, row_number() over (partition by seg order by any_value(w) desc, word) as rank from sw group by seg, word) where rank <= {POSTED}),
al as (select doc_id, seg, p - k as start from x join po using (word) group by doc_id, seg, p - k having count(*) >= least({AGREE}, any_value(m))),
ma as (select al.doc_id, al.seg, start, sum(w)::double as matched, count(*) filter (must) as musts from al join sw using (seg) join x on x.doc_id = al.doc_id and x.p = al.start + sw.k and x.word = sw.word group by all),
tot as (select seg, sum(w)::double as total, count(*) filter (must) as need from sw group by seg),
f as (select doc_id, seg, start, matched / total as share, musts = need as verified, tpl, label, base from ma join tot using (seg) join lab using (seg)),
parts as (select tpl, count(*) as n from lab group by tpl),
whole as (select doc_id, tpl, any_value(label) as label, any_value(base) as base from f where verified group by doc_id, tpl having count(distinct seg) = (select n from parts where parts.tpl = f.tpl)),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels, string_agg(distinct label, ',' order by label) filter (base) as base_labels from whole group by doc_id),
b as (select doc_id, count(*) filter (verified and base) as n_base, min(start) filter (verified and base) as first_word, max(start) filter (verified and base) as last_word, max(share) as score from f group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join b on b.doc_id = d.doc_id left join l on l.doc_id = d.doc_id"""


SQL = _sql()
