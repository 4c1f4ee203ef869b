"""Learned decision lists over text statistics, in DataFrame expressions alone.

Statistics are expressions within a row, O(n log n) in its words. Sequential covering learns an ordered list of rules on a
bounded sample of labelled rows: it grows a conjunction of threshold tests by information gain on one part of the sample,
prunes it from its end on the other part, keeps it if it is precise enough on both, takes away what it covers, and goes on.
The list is emitted as nested ``when`` expressions. Only the sample's statistics (at most ``SAMPLE`` rows) reach the driver.

Contract: a null text has no words; repeated rows count as often as they come but a labelled id trains once; a null label
doesn't train; without labels no rule is learned; a null id is judged like any other; an empty table gives no rows; extra
columns are kept by ``judged`` and ``accepted``, and one with the name of a result comes back from ``judged`` as input_<name>.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that training looks at, chosen by a hash of their ids.
SAMPLE = 8000
SPACE = "[ \\t-\\r]+"


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct"]


def _measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row (a row of docs) and its statistics, whatever the columns of docs are called."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    x = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")).withColumn("_w", F.array_remove(F.split(t, SPACE), ""))
    x = x.withColumns({
        "_h": F.expr("transform(_w, x -> xxhash64(x))"), "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"), "n_upper": F.regexp_count(t, F.lit("\\p{Lu}")).cast("long"), "n_marks": F.regexp_count(t, F.lit("!")).cast("long"),
        "_l": F.expr("filter(split(coalesce(_text, ''), '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')"),
    }).drop("_w", "_text")
    hashes = ", ".join(f"_h[i + {k}]" for k in range(5))
    x = x.withColumns({"n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_distinct": F.size(F.array_distinct("_h")).cast("long"), "_g": F.expr(f"if(size(_h) < 5, cast(array() as array<bigint>), transform(sequence(0, size(_h) - 5), i -> xxhash64({hashes})))")}).drop("_h", "_l")
    # Only texts with a repeated window pay for the sort that finds its places.
    x = x.withColumn("_s", F.expr("if(size(array_distinct(_g)) < size(_g), sort_array(transform(_g, (h, i) -> struct(h, i))), null)")).drop("_g")
    twice = "(k > 0 and _s[k - 1].h = _s[k].h) or (k < size(_s) - 1 and _s[k + 1].h = _s[k].h)"
    x = x.withColumn("_p", F.expr(f"if(_s is null, null, sort_array(transform(filter(sequence(0, size(_s) - 1), k -> {twice}), k -> _s[k].i)))")).drop("_s")
    covered = "aggregate(_p, named_struct('last', -5, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(5, i - a.last)), a -> a.n)"
    return x.withColumn("n_repeat_words", F.expr(f"if(_p is null, 0L, {covered})")).select("_row", *STATISTICS)


def _attached(docs: DataFrame, measured: DataFrame, results: list[str]) -> DataFrame:
    taken = {x.lower() for x in results}
    return measured.select(*[F.col("_row")[c].alias(f"input_{c}" if c.lower() in taken else c) for c in docs.columns], *results)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and the ``STATISTICS``; a column of docs with such a name comes back as input_<name>."""
    return _attached(docs, _measured(docs, text), STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: What rules test, as expressions over the statistics; every one is defined for texts without words.
_PER_WORD = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1)).cast("double")


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"), "symbols_per_word": _PER_WORD("n_symbols"), "marks_per_word": _PER_WORD("n_marks"), "upper_per_char": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "distinct_share": _PER_WORD("n_distinct"), "repeat_share": _PER_WORD("n_repeat_words"), "dup_lines_per_word": _PER_WORD("n_dup_lines"), "chars_per_word": _PER_WORD("word_chars"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= F.lit(self.threshold) if self.at_least else c <= F.lit(self.threshold)


Rule = tuple[Test, ...]
Rows = list[tuple[dict[str, float], bool]]


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(t.holds(row) for t in rule)


def _counts(rule: Rule, rows: Rows) -> tuple[int, int]:
    hits = [bad for row, bad in rows if _covers(rule, row)]
    return sum(hits), len(hits) - sum(hits)


def _best_test(rows: Rows) -> Test | None:
    """The threshold test of the highest FOIL gain; thresholds lie between neighbouring values of the rows."""
    p0 = sum(bad for _, bad in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return None
    before, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for name in sorted(rows[0][0]):
        ordered = sorted((row[name], bad) for row, bad in rows)
        p = n = 0
        for k in range(len(ordered) - 1):
            p, n = p + ordered[k][1], n + (not ordered[k][1])
            if ordered[k][0] == ordered[k + 1][0]:
                continue
            middle = (ordered[k][0] + ordered[k + 1][0]) / 2
            for at_least, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > best:
                    best, found = gain, Test(name, at_least, middle)
    return found


def learn(rows: Rows, precision: float = 0.95, least: int = 8, most_tests: int = 3, most_rules: int = 12) -> list[Rule]:
    """An ordered list of conjunctions that reject; rows: statistics and whether the label is bad, in a fixed order."""
    grow, prune = [x for k, x in enumerate(rows) if k % 3], [x for k, x in enumerate(rows) if not k % 3]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(bad for _, bad in grow):
        rule: Rule = ()
        covered = grow
        while len(rule) < most_tests and (test := _best_test(covered)):
            rule += (test,)
            covered = [x for x in covered if test.holds(x[0])]
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_counts(r, prune))
        candidates = [rule[:k] for k in range(1, len(rule) + 1)]
        if not candidates:
            break
        rule = max(candidates, key=lambda r: (worth(r), -len(r)))
        p, n = (sum(x) for x in zip(_counts(rule, grow), _counts(rule, prune), strict=True))
        if p < least or p < precision * (p + n) or worth(rule) <= 0:
            break
        rules.append(rule)
        grow, prune = ([x for x in part if not _covers(rule, x[0])] for part in (grow, prune))
    return rules


def emitted(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does: the list as one conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for t in rule[1:]:
            holds &= t.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from the labelled rows of docs, at most ``sample`` of them."""
    ids = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))  # at most `sample` ids
    names = features()
    seen = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), *[F.min(c).alias(k) for k, c in names.items()])
    found = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return learn([({k: float(r[k]) for k in names}, r.quality == 0) for r in found])


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = trained(docs, labels)
    out = _measured(docs).withColumns({"base_failed": base_failed(), "rule": emitted(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the statistics, base_failed, rule (the number of the rule that rejects, else 0) and kept."""
    return _attached(docs, _judged(docs, labels), [*STATISTICS, "base_failed", "rule", "kept"])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs as they are.

    The filter stands above a generator: pushed below the statistics it would repeat each of them in the next.
    """
    row = _judged(docs, labels).select(F.inline(F.array(F.struct("_row", "kept"))))
    return row.filter("kept").select("_row.*")
