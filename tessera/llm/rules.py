"""Quality rules: an ordered decision list, learnt from labelled statistics by sequential covering.

Each rule is a conjunction of thresholds that picks out documents of one class.  A rule is grown one condition at a time
on two thirds of the rows by information gain, pruned from its end on the other third, and kept while it is precise;
rows that it covers leave and the next rule is sought.  The list becomes one Spark CASE expression.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out
from tessera.llm.features import RATIOS, with_stats

MOST_ROWS, MOST_RULES, MOST_CONDITIONS, PRECISION, LEAST_COVER = 20_000, 12, 4, 0.9, 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> F.Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


def _covered(rule, x, n) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x, bad, rows) -> list[Condition]:
    rule, hit = [], rows.copy()
    while len(rule) < MOST_CONDITIONS and (hit & ~bad).any():
        p, best = (hit & bad).sum(), (0.0, None)
        base = np.log2(max(p, 1e-9) / hit.sum())
        for f in x:
            v = np.sort(np.unique(x[f][hit]))
            mids = (v[1:] + v[:-1]) / 2
            for cut in mids[:: max(1, len(mids) // 64)]:
                for above in (True, False):
                    c = Condition(f, above, float(f"{cut:.6g}"))
                    now = hit & c.holds(x)
                    q = (now & bad).sum()
                    if q and (gain := q * (np.log2(q / now.sum()) - base)) > best[0] + 1e-12:
                        best = gain, c
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Rules for the class `bad`, in the order found.  Deterministic: row k serves pruning if k mod 3 is 2."""
    n, rules = len(bad), []
    left, prune = np.ones(n, bool), np.arange(n) % 3 == 2
    while len(rules) < MOST_RULES and (left & bad & ~prune).sum() >= LEAST_COVER:
        rule = _grow(x, bad, left & ~prune)

        def worth(r):
            hit = _covered(r, x, n) & left & prune  # noqa: B023
            return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covered(rule, x, n) & left if rule else np.zeros(n, bool)
        if not rule or hit.sum() < LEAST_COVER or (hit & bad).sum() < PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> list[list[Condition]]:
    """Learn from at most `most_rows` labelled documents outside the held-out third, those first by a hash of their id.

    At most MOST_RULES rules of MOST_CONDITIONS conditions are learnt, and a condition's threshold is one of about 64
    midpoints between values.  Null labels and ids teach nothing, rows that share an id are one; without labelled rows there
    are no rules.
    """
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # A sort by hash with a limit: the driver gets at most most_rows rows of statistics.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # Rows that share an id are one (the least text by hash).
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_stats(one, keep=("doc_id", "quality")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return []
    return learn({f: np.array([r[f] for r in rows]) for f in RATIOS}, np.array([r.quality == 0 for r in rows]))


def verdict(rules) -> F.Column:
    """The ordered list as one expression: true (keep) unless a rule's conditions hold."""
    case = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed (under 50 words, or over half of them repeated) and kept.

    Null and empty texts have no words and so fail; every row of docs gives a row; other columns are ignored.
    """
    stats = with_stats(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
