"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a condition over a text's measures. On a sample the cascade
measures every rule's selectivity and its cost, which is the time that the rule
takes on the sample, and evaluates the rules by rejection per cost, the best
first; a rejected document skips the rest. The order changes the work, never
the verdict. Measures that are there already are not computed again.

The sample is the first ``sample`` rows of a random tenth of the table, taken
from as few partitions as have them, and without texts of over SAMPLE_CHARS, so
that the driver gets a bounded number of bytes. It decides the order alone.

A null text has no words. Empty texts and texts without words fail the base
rules. A very long text is judged whole, with 64-bit numbers. Rules of equal
rejection per cost go by name. Extra columns are kept by ``keep_good`` and
dropped by ``score``. Repeated rows are judged one by one. An empty table gives
no rows. Windows are compared by a 64-bit hash of their words within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD, Scratch, carried, unpacked

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample that costs and selectivities are measured on, at most.
SAMPLE = 2_000
SAMPLE_CHARS = 1 << 15
#: Up to so many distinct repeated windows, their places are found by a scan, beyond by a sort.
SCAN = 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once for each row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _covered(places: Column) -> Column:
    """Words in 3-word windows that begin at the given ascending places."""
    return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), p - F.when(i > 0, F.get(places, i - 1)).otherwise(-3))), F.lit(0), lambda a, x: a + x)


def _places(hashes: Column, repeated: Column) -> Column:
    """Ascending indexes of the windows whose hash is among the repeated ones."""
    scan = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i).otherwise(-1)), lambda i: i >= 0)
    pairs = lambda: F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = lambda s, j: F.get(s, j).getField("h")
    by_sort = let(
        pairs(),
        lambda s: F.array_sort(
            F.transform(
                F.filter(F.transform(s, lambda x, j: F.struct(x.getField("i").alias("i"), (F.coalesce(x.getField("h") == near(s, j - 1), F.lit(False)) | F.coalesce(x.getField("h") == near(s, j + 1), F.lit(False))).alias("twin"))), lambda x: x.getField("twin")),
                lambda x: x.getField("i"),
            )
        ),
    )
    return F.when(F.size(repeated) <= SCAN, scan).otherwise(by_sort)


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    twins = lambda h: let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (x == F.get(s, F.greatest(j - 1, F.lit(0)))))))
    found = let(hashes, lambda h: let(twins(h), lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(let(_places(h, r), _covered))))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(found)


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, ""))


def duplicate_lines(found: Column) -> Column:
    return F.size(found) - F.size(F.array_distinct(found))


class Measures:
    """What rules judge: a text, its words, and measures of them, which are computed only where a rule asks for one."""

    def __init__(self, text: Column, words_: Column, **known: Column):
        self.text, self.words, self.known = text, words_, known

    def _long(self, name: str, make: Callable[[], Column]) -> Column:
        return (self.known[name] if name in self.known else make()).cast("long")

    @property
    def n_words(self) -> Column:
        return self._long("n_words", lambda: F.size(self.words))

    @property
    def word_chars(self) -> Column:
        return self._long("word_chars", lambda: word_chars(self.words))

    @property
    def symbols(self) -> Column:
        return self._long("symbols", lambda: symbols(self.text))

    @property
    def repeated(self) -> Column:
        return self._long("repeated", lambda: repeated_words(self.words))

    def of_lines(self, use: Callable[[Column, Column], Column]) -> Column:
        """use(lines, repeated ones among them), as numbers."""
        if "n_lines" in self.known:
            return use(self.known["n_lines"].cast("long"), self.known["dup_lines"].cast("long"))
        return let(lines(self.text), lambda x: use(F.size(x).cast("long"), duplicate_lines(x).cast("long")))


@dataclass(frozen=True)
class Rule:
    """fails(measures) is true for a document to reject."""

    name: str
    fails: Callable[[Measures], Column]


#: The base rules, which the contract fixes.
BASE = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_windows", lambda m: 100 * m.repeated > 50 * m.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m.symbols > m.n_words),
    Rule("capitals", lambda m: 10 * F.length(F.regexp_replace(m.text, "[^A-Z]+", "")).cast("long") > 3 * F.length(m.text).cast("long")),
    Rule("word_length", lambda m: let(m.word_chars, lambda c: (c < 3 * m.n_words) | (c > 10 * m.n_words))),
    Rule("duplicate_lines", lambda m: m.of_lines(lambda n, again: 2 * again > n)),
)


def _of(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(text, words) with the words bound inside the expression: no filter that Spark pushes down can split the text anew for each word."""
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(words(t), lambda w: use(t, w)))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample: int = SAMPLE, seed: int = 11) -> list[Rule]:
    """The rules by rejection per cost, both measured on a sample of up to ``sample`` rows."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    some = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    taken = some.sample(0.1, seed=seed).take(sample) or some.take(sample)  # the latter of a table of a few rows
    rows = scratch.write(spark.createDataFrame(taken, "text string").coalesce(1), "sample")
    n = max(1, len(taken))

    def timed(use: Callable[[Column, Column], Column]) -> tuple[float, float]:
        """Seconds, and the share of rows for which use() is true."""
        query, best, share = rows.agg(F.sum(_of(F.col("text"), use).cast("long"))), None, 0.0
        for _ in range(3):  # the first compiles the expression
            began = time.perf_counter()
            share = (query.first()[0] or 0) / n
            best = min(best or 1e9, time.perf_counter() - began)
        return best, share

    nothing, _ = timed(lambda t, w: F.size(w) < 0)
    found = {r.name: timed(lambda t, w, r=r: r.fails(Measures(t, w))) for r in rules}
    scratch.drop("sample")
    cost = {k: max(took - nothing, 1e-4) for k, (took, _) in found.items()}
    return sorted(rules, key=lambda r: (-found[r.name][1] / cost[r.name], cost[r.name] if not found[r.name][1] else 0, r.name))


def first_failure(rules: list[Rule], m: Measures) -> Column:
    """The name of the first rule, in this order, that rejects a text; null if none. The rules behind it are not evaluated."""
    out = F
    for r in rules:
        out = out.when(r.fails(m), F.lit(r.name))
    return out


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    order = ordered(docs, rules, text_col=text_col)
    failed = _of(F.col("_row").getField(text_col), lambda t, w: first_failure(order, Measures(t, w)))
    return unpacked(carried(docs).filter(failed.isNull()), docs.columns)


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and failed_rule, of every row of documents."""
    order = ordered(docs, tuple(r for r in rules if r not in BASE))
    base = [r for r in rules if r in BASE]

    def judge(t: Column, w: Column) -> Column:
        counted = let(lines(t), lambda x: F.array(F.size(w), word_chars(w), symbols(t), duplicate_lines(x), repeated_words(w), F.size(x)))
        names = ("n_words", "word_chars", "symbols", "dup_lines", "repeated", "n_lines")
        return let(counted, lambda m: F.struct(m.alias("m"), first_failure(base + order, Measures(t, w, **{k: m[i] for i, k in enumerate(names)})).alias("failed_rule")))

    judged = docs.select("doc_id", _of(F.col("text"), judge).alias("j")).select("doc_id", F.col("j.m").alias("m"), F.col("j.failed_rule").alias("failed_rule"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = judged.select("doc_id", *(F.col("m")[i].cast("long").alias(n) for i, n in enumerate(names)), "failed_rule")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *names, failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"), "failed_rule")


#: DuckDB SQL for the columns of score() but failed_rule, which depends on the cascade's order.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, ws[i : i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
m AS (SELECT doc_id, t, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t)
  OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 2 * n_dup_lines > len(ls)) AS kept FROM b
"""
