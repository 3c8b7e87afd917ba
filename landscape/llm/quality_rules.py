"""Quality rules as a learned decision list, in DataFrame operations only.

``text_statistics`` counts words, characters, symbols, repeated lines and
repeated 3-word windows of every text. ``learn_rules`` runs sequential
covering over labelled statistics: conditions (statistic below or above a
threshold) are added to a rule while they raise its gain on a growing part of
the labels, then taken away again from its end while that raises its worth on
a pruning part; the rows a rule covers leave, and the next rule is sought.
Each step is one grouped count over the labelled statistics; thresholds are
quantiles. The list becomes one ordered Spark ``CASE`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WORDS = r"([^\x20\x09-\x0D]+)"
BLANKS = " \t\n\x0b\x0c\r"
NOT_SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 3


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``words``."""
    n = F.size(words)
    second = F.slice(words, 2, F.greatest(n, F.lit(1)))
    third = F.slice(words, 3, F.greatest(n, F.lit(1)))
    pairs = F.zip_with(words, second, lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, third, lambda h, c: F.xxhash64(h, c)), 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    return windows


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the counts of each text (null: empty).

    ``n_words``: runs of non-blank characters; ``word_chars``: code points in
    them; ``n_symbols``; ``n_lines`` and ``n_dup_lines``: lines with a word, and
    those equal to an earlier one; ``n_repeat_words``; ``n_chars``; ``n_upper``,
    ``n_letters``, ``n_digits``, ``n_distinct``: capitals, letters, digits,
    distinct words. Repeated rows are counted each.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("t_"))
    base = base.select("*", F.regexp_extract_all("t_", F.lit(WORDS), F.lit(1)).alias("w_"),
                       F.filter(F.split("t_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l_"))
    base = base.select("*", _repeated_words(F.col("w_")).alias("g_"))
    # most texts repeat no window: sort only where a hash set finds a repetition
    distinct = F.size(F.array_distinct("g_"))
    order = F.when(distinct < F.size("g_"), F.array_sort(F.transform(
        "g_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.select("*", order.alias("o_"))
    n = F.size("o_")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice("o_", 1, n - 1), lambda s: s["h"]))
    after = F.concat(F.transform(F.slice("o_", 2, n), lambda s: s["h"]), F.array(F.lit(None).cast("bigint")))
    base = base.select("*", F.when(F.col("o_").isNotNull(), F.arrays_zip(
        F.col("o_").alias("s"), before.alias("b"), after.alias("a"))).alias("z_"))
    twice = F.filter("z_", lambda z: F.coalesce(z["s"]["h"] == z["b"], F.lit(False))
                     | F.coalesce(z["s"]["h"] == z["a"], F.lit(False)))
    base = base.select("*", F.sort_array(F.transform(twice, lambda z: z["s"]["i"])).alias("p_"))
    # windows at sorted places p cover the sum of min(WINDOW, next place - place) words
    gaps = F.zip_with(F.col("p_"), F.slice("p_", 2, F.greatest(F.size("p_"), F.lit(1))),
                      lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0))
    upper = F.length(F.regexp_replace("t_", r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace("t_", r"[^\p{L}]+", ""))
    digits = F.length(F.regexp_replace("t_", r"[^0-9]+", ""))
    return base.select(
        *keep, F.size("w_").cast("long").alias("n_words"),
        F.length(F.translate("t_", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t_", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("l_").cast("long").alias("n_lines"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.length("t_").cast("long").alias("n_chars"), upper.cast("long").alias("n_upper"),
        letters.cast("long").alias("n_letters"), digits.cast("long").alias("n_digits"),
        F.size(F.array_distinct("w_")).cast("long").alias("n_distinct"))


#: statistics that rules may test, as SQL over the columns of text_statistics
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Rule:
    """IF all conditions hold THEN reject. A condition: (statistic, op, value)."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int     # labelled rows of the growing part that it rejects
    precision: float  # share of them that are bad, on all labelled rows it saw

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {v!r}D" for f, op, v in self.conditions)


@dataclass(frozen=True)
class CoveringParams:
    """``quantiles``: thresholds tried per statistic. A rule is kept when its
    Laplace-corrected precision is ``precision`` or more on the pruning part and
    it covers ``least`` bad rows of the growing part. ``rules`` and ``depth``
    bound the size of the list, not the data."""

    quantiles: int = 40
    precision: float = 0.9
    least: int = 4
    depth: int = 4
    rules: int = 16
    seed: int = 11


def _said(conditions: list[tuple[int, str, int]]) -> str:
    """SQL of conditions on bucket numbers (feature, op, threshold number)."""
    return " AND ".join(f"b[{f}] {op} {i}" for f, op, i in conditions) or "true"


def _histogram(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(feature, bucket) -> (bad, good) rows of the growing part: one aggregation,
    whose result has as many rows as there are thresholds."""
    long = rows.filter("grow").select("bad", F.posexplode("b").alias("f", "v"))
    counts = long.groupBy("f", "v").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    return {(r.f, r.v): (r.p, r.n) for r in counts}


def learn_rules(stats: DataFrame, bad: str, p: CoveringParams = CoveringParams()) -> list[Rule]:
    """Ordered reject rules for the rows where the boolean SQL ``bad`` holds.

    ``stats`` has the columns of ``text_statistics`` and those that ``bad``
    reads; rows where ``bad`` is null are left out. A third of the rows (by a
    hash of their statistics) prunes, the rest grows. No rows, or rows of one
    kind only, give an empty list, which rejects nothing. Only counts and
    thresholds reach the driver: each statistic is stored as the number of
    thresholds below it, so that one grouped count serves every condition.
    """
    names = list(FEATURES)
    raw = stage(stats.select(F.expr(f"({bad})").alias("bad"),
                             *[F.expr(FEATURES[f]).cast("double").alias(f) for f in names])
                .filter("bad IS NOT NULL")
                .withColumn("grow", F.expr(f"pmod(xxhash64({', '.join(names)}, {p.seed}), 3) <> 0")), "labelled")
    probs = [i / p.quantiles for i in range(1, p.quantiles)]
    tail = [0.001, 0.005, 0.01, 0.99, 0.995, 0.999]
    marks = raw.agg(*[F.percentile_approx(f, sorted(probs + tail), 10000).alias(f) for f in names],
                    *[F.expr(f"percentile_approx({f}, array(0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98), 10000) "
                             "FILTER (WHERE bad)").alias(f"{f}_bad") for f in names]).first()
    cuts = [sorted({float(v) for v in [*(marks[f] or []), *(marks[f"{f}_bad"] or [])]}) for f in names]
    if not all(cuts):
        return []
    below = [F.expr(f"size(filter(array({', '.join(f'{v!r}D' for v in values)}), t -> t < {f}))")
             for f, values in zip(names, cuts)]
    table = stage(raw.select("bad", "grow", F.array(*below).alias("b")), "bucketed")

    def counts(rows: DataFrame, heads: list[list[tuple[int, str, int]]], part: str) -> list[tuple[int, int]]:
        cols = [F.expr(f"count_if({'' if is_bad else 'NOT '}bad AND {part} AND {_said(h)})").alias(f"c{i}_{is_bad}")
                for i, h in enumerate(heads) for is_bad in (True, False)]
        r = rows.agg(*cols).first()
        return [(r[2 * i], r[2 * i + 1]) for i in range(len(heads))]

    rules: list[Rule] = []
    left = table
    while len(rules) < p.rules:
        (pos, neg), = counts(left, [[]], "grow")
        if pos < p.least or not neg:
            break
        conditions: list[tuple[int, str, int]] = []
        now = left
        while len(conditions) < p.depth and neg:
            seen = _histogram(now)
            base = math.log2(pos / (pos + neg))
            gain, choice = 1e-9, None
            for f, values in enumerate(cuts):
                pp = nn = 0
                for i in range(len(values)):  # value <= cut i: at most i cuts are below it
                    dp, dn = seen.get((f, i), (0, 0))
                    pp, nn = pp + dp, nn + dn
                    for op, a, b in (("<=", pp, nn), (">", pos - pp, neg - nn)):
                        worth = a * (math.log2(a / (a + b)) - base) if a else 0.0
                        if worth > gain + 1e-9:
                            gain, choice = worth, ((f, op, i), (a, b))
            if choice is None:
                break
            conditions.append(choice[0])
            pos, neg = choice[1]
            now = now.filter(_said([choice[0]]))
        if not conditions:
            break
        # pruning: the shortest head of the rule with the best worth on the other part
        heads = [conditions[:k] for k in range(1, len(conditions) + 1)]
        worth = [((pp + 1) / (pp + nn + 2), -k) for k, (pp, nn) in enumerate(counts(left, heads, "NOT grow"))]
        precision, at = max(worth)
        rule = heads[-at]
        (pp, nn), = counts(left, [rule], "true")
        if precision < p.precision or pp < p.least or pp / (pp + nn) < p.precision:
            break
        rules.append(Rule(tuple((names[f], op, cuts[f][i]) for f, op, i in rule), pp, pp / (pp + nn)))
        left = left.filter(f"NOT ({_said(rule)})")
    return rules


def rule_expression(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row of statistics, else null."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules)) + " END")


def judge_quality(stats: DataFrame, rules: list[Rule], least_words: int = 50,
                  repeat_percent: int = 50) -> DataFrame:
    """``stats`` with ``base_failed`` (too few words, or too many of them in
    repeated windows), ``rule`` (the first learned rule that rejects, from 0) and
    ``kept``. A text without words fails the base test."""
    failed = F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > {repeat_percent} * n_words")
    rule = rule_expression(rules)
    return stats.withColumn("base_failed", failed).withColumn("rule", rule).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())
