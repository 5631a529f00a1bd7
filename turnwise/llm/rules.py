"""Quality rules: a decision list learned by sequential covering.

Every document gets text statistics from built-in functions only. From labelled documents, rules for the class "reject"
are learned one after another: a rule grows by the threshold condition with the largest information gain, is pruned
back on rows it didn't grow on, and its rows leave before the next rule is sought. All that the learner sees are counts
per statistic and threshold bin, one small aggregation a step. The list becomes one ordered conditional expression.

``max_labelled`` bounds the labelled rows that learning uses (an even sample by digest of the id); scoring covers every
row. Without labels of both classes the list is empty and its verdict is "keep".

Defined results: a null or empty text has no words, so its base verdict is "failed"; repeated rows are scored one by one;
an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import let, stored, table, words_of
from turnwise.llm.registry import query

WINDOW = 8
#: What rules may test.
STATISTICS = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "digit_share", "distinct_share",
              "repeat_share", "dup_line_share")


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the given ascending starts."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    return F.aggregate(
        starts, zero,
        lambda a, p: F.struct((a["total"] + p + WINDOW - F.greatest(a["upto"], p)).alias("total"),
                              (p + WINDOW).alias("upto")),
        lambda a: a["total"])


def repeat_words(word_hashes: Column) -> Column:
    """Number of words in windows of eight words that occur twice or more in the text.

    Windows are 64-bit digests. Texts without a repeated window, most of them, need no sort.
    """
    def of_windows(grams: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = F.filter(
                F.sequence(F.lit(0), F.size(pairs) - 1),
                lambda j: F.coalesce(pairs[j]["h"] == F.get(pairs, j - 1)["h"], F.lit(False))
                | F.coalesce(pairs[j]["h"] == F.get(pairs, j + 1)["h"], F.lit(False)))
            return _covered(F.array_sort(F.transform(same, lambda j: pairs[j]["p"])))

        sorted_pairs = F.array_sort(F.transform(grams, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(sorted_pairs, of_sorted))

    grams = let(word_hashes, lambda hs: F.transform(
        F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))))
    return F.when(F.size(word_hashes) <= WINDOW, 0).otherwise(let(grams, of_windows)).cast("long")


def _characters(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and the statistics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    base = docs.select("doc_id", *keep, text.alias("_text"), words_of(F.col("text")).alias("_words"),
                       lines.alias("_lines"))
    hashed = base.select(
        "doc_id", *keep, "_text", F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_kinds"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    counted = hashed.select(
        "doc_id", *keep, F.size("_hashes").cast("long").alias("n_words"), "word_chars",
        _characters(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        (F.col("_n_lines") - F.col("_kinds")).cast("long").alias("n_dup_lines"), "_n_lines",
        repeat_words(F.col("_hashes")).alias("n_repeat_words"),
        F.size(F.array_distinct("_hashes")).alias("_distinct"),
        _characters(F.col("_text"), "\\p{Lu}").alias("_upper"),
        _characters(F.col("_text"), "!?").alias("_marks"),
        _characters(F.col("_text"), "0-9").alias("_digits"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counted.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("_upper", "word_chars").alias("upper_share"), share("_marks", "word_chars").alias("mark_share"),
        share("_digits", "word_chars").alias("digit_share"), share("_distinct", "n_words").alias("distinct_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold

    def on_bins(self) -> Column:
        value = F.col("bins")[STATISTICS.index(self.statistic)]
        return value >= self.bin if self.at_least else value < self.bin

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions hold; rejected and kept: labelled rows it covered on the pruning part."""

    conditions: tuple[Condition, ...] = field(default=())
    rejected: int = 0
    kept: int = 0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} ({self.rejected}:{self.kept})"


def _holds(conditions: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, [c.on_bins() for c in conditions], F.lit(True))


def labelled_sample(labels: DataFrame, label: str, bound: int, seed: str) -> DataFrame:
    """(doc_id, label) of about ``bound`` labelled ids, never over 1.25 times that; an even choice by digest."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    total = known.count()
    if total > bound:
        known = known.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / total))
    return known.limit(bound + bound // 4)


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= value))


def learn_rules(rows: DataFrame, bins: int = 24, max_rules: int = 8, max_conditions: int = 3,
                min_covered: int = 5) -> list[Rule]:
    """A decision list from a bounded table with ``label`` (0: reject) and the statistics."""
    fractions = [i / bins for i in range(1, bins)]
    both = [F.percentile_approx(F.when(F.col("label") == k, F.col(s)), F.array(*map(F.lit, fractions)), F.lit(1000))
            .alias(f"{s}_{k}") for s in STATISTICS for k in (0, 1)]
    found = rows.agg(*both).first()
    cuts = {s: sorted({*(found[f"{s}_0"] or ()), *(found[f"{s}_1"] or ())}) for s in STATISTICS}
    coded = stored(rows.select(
        "label", (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("prunes"),
        F.array(*[_bin(F.col(s), cuts[s]) for s in STATISTICS]).alias("bins")).coalesce(8))

    def table_of(rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
        """Per statistic: (reject, keep) counts by bin; at most statistics x bins rows come back."""
        out = {s: [(0, 0)] * (len(cuts[s]) + 1) for s in STATISTICS}
        pairs = rows.select("label", F.posexplode("bins").alias("which", "bin")).groupBy("which", "bin").agg(
            F.count_if(F.col("label") == 0).alias("r"), F.count_if(F.col("label") != 0).alias("k"))
        for x in pairs.collect():
            out[STATISTICS[x["which"]]][x["bin"]] = (x["r"], x["k"])
        return out

    def grown(rows: DataFrame) -> tuple[Condition, ...]:
        held: tuple[Condition, ...] = ()
        while len(held) < max_conditions:
            counts = table_of(rows.filter(_holds(held)))
            r_all, k_all = (sum(x[i] for x in counts[STATISTICS[0]]) for i in (0, 1))
            if r_all < min_covered or k_all == 0:
                break
            best, best_gain = None, 1e-9
            for s in STATISTICS:
                r = k = 0
                for at in range(1, len(cuts[s]) + 1):
                    r, k = r + counts[s][at - 1][0], k + counts[s][at - 1][1]
                    for at_least, p, n in ((False, r, k), (True, r_all - r, k_all - k)):
                        if p < min_covered:
                            continue
                        gain = p * (math.log2(p / (p + n)) - math.log2(r_all / (r_all + k_all)))
                        if gain > best_gain:
                            best, best_gain = Condition(s, at_least, cuts[s][at - 1], at), gain
            if best is None:
                break
            held += (best,)
        return held

    def pruned(rows: DataFrame, held: tuple[Condition, ...]) -> Rule:
        heads = [held[:i] for i in range(1, len(held) + 1)]
        sums = rows.agg(*[F.count_if(_holds(h) & (F.col("label") == 0)).alias(f"r{i}") for i, h in enumerate(heads)],
                        *[F.count_if(_holds(h) & (F.col("label") != 0)).alias(f"k{i}") for i, h in enumerate(heads)]).first()
        worth = [(sums[f"r{i}"] - sums[f"k{i}"]) / max(1, sums[f"r{i}"] + sums[f"k{i}"]) for i in range(len(heads))]
        i = max(range(len(heads)), key=lambda i: (worth[i], sums[f"r{i}"]))
        return Rule(heads[i], sums[f"r{i}"], sums[f"k{i}"])

    rules: list[Rule] = []
    left = coded
    while len(rules) < max_rules:
        held = grown(left.filter(~F.col("prunes")))
        if not held:
            break
        rule = pruned(left.filter("prunes"), held)
        if rule.rejected <= 2 * rule.kept:  # right in two of three rows at least, on rows it didn't grow on
            break
        rules.append(rule)
        left = left.filter(~_holds(rule.conditions))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: false where a rule rejects, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[Rule]:
    """Rules learned from the labelled documents."""
    sample = F.broadcast(labelled_sample(labels.select("doc_id", "quality"), "quality", max_labelled, "rules"))
    rows = stored(text_statistics(docs.select("doc_id", "text").join(sample, "doc_id"), "label"))
    return learn_rules(rows)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return text_statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"))


@query("op1_rule_list")
def op1_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, quality_rules(docs, table(spark, sf_dir, "labels")))
