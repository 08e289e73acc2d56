"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Four fixed base rules' counts are taken from each text. For the texts that pass the base rules, quantile
summaries of four measures (Greenwald-Khanna, which merge over tasks) are kept for each language and
source, for each language and for all rows; of the values above 0 there are summaries of their own. What
a group's summaries say is the cutoff, in one of three ways:

- its quartiles differ: the upper quartile plus FENCE times the quartile range;
- its quartiles are 0 and the measure's values above 0 keep away from 0 over all rows (their lower edge, the
  quantile EDGE, is more than their median times NEAR): they are another kind of text, and the cutoff is in
  the middle of the gap, at half the group's own edge;
- else the upper-tail quantile TAIL, so that what is rare in the group goes.

SLACK is a share of what the summaries say, so that no cutoff is a constant. A group's cutoff is drawn to its
language's, and a language's to that of all rows, as if the wider one stood for PRIOR rows: large groups
decide for themselves and small ones by degrees less, without a switch. Rows then meet their cutoffs in a
join and are filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import table, written

FENCE = 6.0
TAIL = 127 / 128
EDGE = 1 / 64
NEAR = 1 / 4
SLACK = 1 / 32
#: Rows that the wider group's cutoff weighs as.
PRIOR = 100
#: Entries of a quantile summary: ranks are off by 1 / ACCURACY of the rows at most.
ACCURACY = 10_000
MEASURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share"]
#: Rows of cutoffs that are broadcast, some MB; beyond, the join is a shuffled one.
BROADCAST = 50_000

_GAP = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row: a lambda would compute an outer expression anew for each element."""
    return F.transform(F.array(value), body)[0]


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    chars = F.length(F.translate(text, _BLANKS, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(F.filter(F.split(text, _GAP), lambda x: x != ""), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup_lines.alias("n_dup_lines"),
        F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(let(_windows(words), _repeat_words)).alias("n_repeat_words"),
    ))


def _windows(words: Column) -> Column:
    """A hash of each 8 words in a row, 9 words at least."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, 8)))


def _repeat_words(windows: Column) -> Column:
    """Words in windows whose hash stands in the array twice or more."""
    sorted_ = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, F.lit(0).cast("long")).otherwise(let(sorted_, lambda s: _covered(F.array_sort(F.transform(F.filter(s, lambda x, k: _twice(s, x, k)), lambda x: x["i"])))))


def _twice(ordered: Column, x: Column, k: Column) -> Column:
    before, after = F.get(ordered, k - 1)["h"] == x["h"], F.get(ordered, k + 1)["h"] == x["h"]
    return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))


def _covered(at: Column) -> Column:
    """Words that windows of 8 starting at the sorted places cover: each adds what the one before doesn't reach."""
    state = F.aggregate(
        at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(8), x - s["last"])).alias("n"), x.alias("last")),
    )
    return state["n"]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts ..., base_failed, measures ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", base_counts(text).alias("c")).select("doc_id", "lang", "source", "c.*")
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_words") / 10, F.lit(1))
    return rows.select(
        "*", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
    )


def summaries(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, members, and for each measure the quantiles 1/4, 3/4 and TAIL of all values, <measure>, and EDGE and 1/2 of those above 0, <measure>_some."""
    aggs = []
    for m in MEASURES:
        some = F.when(F.col(m) > 0, F.col(m))
        aggs += [F.percentile_approx(m, [0.25, 0.75, TAIL], ACCURACY).alias(m), F.percentile_approx(some, [EDGE, 0.5], ACCURACY).alias(f"{m}_some")]
    return rows.where("not base_failed").groupBy(*by).agg(F.count("*").alias("members"), *aggs)


def cutoffs(rows: DataFrame, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """(lang, source, members, max_<measure> ...) for each language and source with a row that passes the base rules."""
    own, wide, all_ = (summaries(rows, by).alias(name) for name, by in (("o", ["lang", "source"]), ("w", ["lang"]), ("a", [])))
    # one row for all, and one for each language
    joined = own.join(wide, F.expr("o.lang <=> w.lang")).crossJoin(F.broadcast(all_))

    def says(group: str, m: str) -> Column:
        low, high, tail = (F.col(f"{group}.{m}")[i] for i in range(3))
        apart = F.col(f"a.{m}_some")[0] > F.col(f"a.{m}_some")[1] * NEAR
        gap = F.coalesce(F.col(f"{group}.{m}_some")[0], F.lit(0.0)) / 2
        return F.when(high > low, high + fence * (high - low)).when((high == 0) & apart, gap).otherwise(tail) * (1 + SLACK)

    def drawn(m: str) -> Column:
        of_lang = (F.col("w.members") * says("w", m) + prior * says("a", m)) / (F.col("w.members") + prior)
        return (F.col("o.members") * says("o", m) + prior * of_lang) / (F.col("o.members") + prior)

    return joined.select("o.lang", "o.source", "o.members", *[drawn(m).alias(f"max_{m}") for m in MEASURES])


def quality_rules(docs: DataFrame, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs(doc_id, text, lang, source, ...).

    Words are runs of other characters than space and \\t-\\r. A null text is an empty one and fails the
    base rules, as each text of fewer than 20 words does. Null languages and sources are groups like any
    other. Rows that repeat a doc_id count as often as they come; extra columns are ignored. An empty
    table gives an empty result.
    """
    rows = written(measured(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))), "measures")
    limits = written(cutoffs(rows, fence, prior).withColumnsRenamed({"lang": "l", "source": "s"}), "cutoffs")
    within = ~F.col("base_failed")
    for m in MEASURES:
        within &= F.col(m) <= F.col(f"max_{m}")
    joined = rows.join(F.broadcast(limits) if limits.count() <= BROADCAST else limits, F.expr("lang <=> l and source <=> s"), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", within.alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts = []
    for m in MEASURES:
        parts += [f"quantile_disc({m}, {x}) as {m}_{name}" for name, x in (("low", 0.25), ("high", 0.75), ("tail", TAIL))]
        parts += [f"quantile_disc({m}, {x}) filter ({m} > 0) as {m}_{name}" for name, x in (("edge", EDGE), ("mid", 0.5))]
    cut = ", ".join(parts)

    def says(g: str, m: str) -> str:
        fence = f"when {g}.{m}_high > {g}.{m}_low then {g}.{m}_high + {FENCE}::double * ({g}.{m}_high - {g}.{m}_low)"
        gap = f"when {g}.{m}_high = 0 and a.{m}_edge > a.{m}_mid * {NEAR}::double then coalesce({g}.{m}_edge, 0) / 2"
        return f"(case {fence} {gap} else {g}.{m}_tail end * {1 + SLACK}::double)"

    drawn = ", ".join(f"(o.n * {says('o', m)} + {PRIOR} * ((l.n * {says('l', m)} + {PRIOR} * {says('a', m)}) / (l.n + {PRIOR}))) / (o.n + {PRIOR}) as {m}" for m in MEASURES)
    within = " and ".join(f"m.{m} <= k.{m}" for m in MEASURES)
    leads = ", ".join(f"lead(x, {i}) over q as x{i}" for i in range(1, 8))
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') as ls from t),
x as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
w8 as (select doc_id, p, count(*) over (partition by doc_id, x, x1, x2, x3, x4, x5, x6, x7) as k from (select *, {leads} from x window q as (partition by doc_id order by p)) where x7 is not null),
r as (select doc_id, count(distinct p)::bigint as n from (select doc_id, p + unnest(range(8)) as p from w8 where k > 1) group by doc_id),
c as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from w left join r on r.doc_id = w.doc_id),
m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, word_chars::double / greatest(n_words, 1) as word_length, n_symbols::double / greatest(word_chars, 1) as symbol_share,
  n_dup_lines::double / greatest(n_words::double / 10, 1) as dup_line_share, n_repeat_words::double / greatest(n_words, 1) as repeat_share from c),
g as (select * from m where not base_failed), o as (select lang, source, count(*) as n, {cut} from g group by lang, source), l as (select lang, count(*) as n, {cut} from g group by lang), a as (select {cut} from g),
k as (select o.lang, o.source, {drawn} from o join l on o.lang is not distinct from l.lang cross join a)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {within} as kept
from m left join k on k.lang is not distinct from m.lang and k.source is not distinct from m.source"""


SQL = _sql()
