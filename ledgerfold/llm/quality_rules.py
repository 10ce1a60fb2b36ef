"""Quality rules whose cutoffs are set by risk control.

A rule rejects a document when a statistic of its text is beyond a cutoff. Cutoffs are not chosen by hand but learned from labelled
documents that pass the base rule, in two steps:

1. a path of (rule, cutoff) pairs is chosen greedily on all labelled bad documents and a quarter of the good ones, by counts that Spark makes of them anew for each pair:
   each pair rejects bad documents that those before it let pass, at the lowest price in good ones, until the price is over ``PRICE``; a
   cutoff lies midway between the values that it parts;
2. the other good documents are the holdout. In each stratum the path is followed (fixed-sequence testing) as long as the exact binomial
   test says, at the stratum's level, that all its pairs so far reject less than ``risk`` of the good documents (the Clopper-Pearson upper
   limit on the holdout's rejections is below risk). Strata share delta evenly (Bonferroni); one whose path is certified to the end hands its share to the
   others, which go on with more (the step-down correction).

Strata with fewer than ``min_good`` documents in the holdout are pooled and have the pool's cutoffs; the guarantee is then the pool's. With
too few documents to certify anything, all that passes the base rule is kept.

Defined results: statistics cover whole texts; a null text is empty (no words, so it fails the base rule); repeated rows give repeated results
and are one trial; a null stratum is that of the empty string; of contradictory labels of a document good counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import bounded_batches, chunks, map_arrow, shared_checkpoint

SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long"
#: statistic of a rule, as SQL over the base columns; ``step`` puts it on a grid that is fine near zero
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "(word_chars / greatest(n_words, 1) - 4) / 20",
    "capitals": "n_upper / greatest(word_chars, 1)",
}
STEPS = 4096
#: Good documents that the path may cost for each bad one.
PRICE = 0.25
#: One in so many good documents chooses the path; all others are the holdout, as what chooses a cutoff can't certify it.
SHARE = 4
Path = list[tuple[str, int]]


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p, exactly, by summing logarithms of terms."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    top = lgamma(n + 1)
    return min(1.0, sum(exp(top - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


@dataclass(frozen=True)
class Risk:
    """At most ``risk`` of a stratum's good documents are rejected, with confidence 1 - delta over all strata at once."""

    risk: float = 0.05
    delta: float = 0.05
    min_good: int = 100


@dataclass(frozen=True)
class Cutoffs:
    """A path, how much of it is in force in each stratum, and how much in the strata that are pooled."""

    path: Path
    strata: dict[str, int]
    pooled: int


def _statistics(batch: pa.RecordBatch):
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    upper = np.zeros(256, dtype=bool)
    upper[65:91] = True
    for t in chunks(batch.column("__text")):
        start, end = t.words
        docs = t.offs.size - 1
        inside = np.zeros(t.size + 1, dtype=np.int8)
        inside[start] += 1
        np.subtract.at(inside, end, 1)  # a word may end where the next document's first begins
        body = t.buf[: t.size]
        chars = np.cumsum((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((body & 0xC0) != 0x80))
        per = lambda total: np.diff(np.concatenate([[0], total])[t.offs])
        h, whole = t.windows(5)
        at = np.flatnonzero(whole)
        owner = t.owner[at]
        repeat = np.zeros(start.size + 1, dtype=np.int32)
        if at.size:
            order = np.lexsort((h[at], owner))
            a, b = h[at][order], owner[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            twice = np.zeros(at.size, dtype=bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = at[order][twice]
            np.add.at(repeat, hit, 1)
            np.add.at(repeat, hit + 5, -1)
        repeated = np.concatenate([[0], np.cumsum(np.cumsum(repeat[:-1]) > 0)])[t.bounds]
        dup = np.zeros(docs, dtype=np.int64)
        for k in range(docs):
            lines = t.raw(k).split(b"\n")
            if len(lines) > len(set(lines)):
                seen: set[bytes] = set()
                for line in lines:
                    if line in seen:
                        dup[k] += bool(line.strip(b" \t\n\v\f\r"))
                    seen.add(line)
        yield {
            **{name: batch.column(name)[t.rows] for name in batch.schema.names if name != "__text"},
            "n_words": np.diff(t.bounds).astype(np.int64), "word_chars": per(chars).astype(np.int64),
            "n_symbols": per(np.cumsum(symbol[body])).astype(np.int64), "n_dup_lines": dup, "n_repeat_words": np.diff(repeated).astype(np.int64),
            "n_upper": per(np.cumsum(upper[body])).astype(np.int64),
        }


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the base statistics of each row's whole text."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep).schema
    return map_arrow(docs.select(*keep, F.col("text").alias("__text")), _statistics, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {BASE}")


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def step(rule: str):
    """The rule's statistic as a whole number, 0 to STEPS."""
    return F.expr(f"cast(least({STEPS}, floor({STEPS} * cbrt(greatest(0, {RULES[rule]})))) as int)")


def best_pair(levels: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], weight: float = SHARE) -> tuple[float, str, int] | None:
    """(price, rule, cutoff) of the pair that rejects bad documents at the lowest price. levels: of each rule, the steps that documents have, ascending, with the numbers of bad and good ones; each good one stands for weight."""
    best = None
    for rule, (level, n_bad, n_good) in levels.items():
        if not level.size:
            continue
        # from the largest value down: what a cutoff below each level rejects
        bad, lost = np.cumsum(n_bad[::-1]), np.cumsum(n_good[::-1]) * weight
        price = np.divide(lost + 1, bad, out=np.full(level.size, np.inf), where=bad > 0)
        k = int(np.argmin(price))
        at = level.size - 1 - k
        if at > 0 and (best is None or price[k] < best[0]):
            best = float(price[k]), rule, int(level[at] + level[at - 1]) // 2
    return best


def choose_path(steps: dict[str, np.ndarray], good: np.ndarray, weight: float = SHARE) -> Path:
    """fit_path for documents at hand: steps by rule, and which are good."""
    live, path = np.ones(good.size, dtype=bool), []
    while live.any():
        levels = {}
        for rule, value in steps.items():
            level, at = np.unique(value[live], return_inverse=True)
            levels[rule] = level, np.bincount(at[~good[live]], minlength=level.size), np.bincount(at[good[live]], minlength=level.size)
        best = best_pair(levels, weight)
        if best is None or best[0] > PRICE:
            break
        path.append(best[1:])
        live &= steps[best[1]] <= best[2]
    return path


def fit_path(some: DataFrame, weight: float = SHARE) -> Path:
    """Pairs (rule, cutoff) for labelled documents: a column of steps for each rule, and good. Each pair is chosen on the counts, by rule, step and label, of all documents that those before it let pass: STEPS + 1 rows a rule are
    all that reaches the driver."""
    path: Path = []
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x")
    while True:
        passed = some.where(F.expr(" and ".join(f"{rule} <= {cut}" for rule, cut in path) or "true")).select("good", each)
        counts = passed.groupBy("x.rule", "x.step").agg(F.count_if(~F.col("good")).alias("n_bad"), F.count_if("good").alias("n_good")).collect()
        levels = {r: np.array(sorted((x["step"], x["n_bad"], x["n_good"]) for x in counts if x["rule"] == r), dtype=np.int64).reshape(-1, 3).T for r in RULES}
        best = best_pair(levels, weight)
        if best is None or best[0] > PRICE:
            return path
        path.append(best[1:])


def position(path: Path):
    """Where on the path a document is rejected; the path's length if it isn't."""
    return F.coalesce(*[F.when(step(rule) > cut, F.lit(k)) for k, (rule, cut) in enumerate(path)], F.lit(len(path)))


def certify(counts: dict[str, np.ndarray], risk: Risk) -> dict[str, int]:
    """How far each stratum may follow the path. counts: of its good documents by position, the path's length last."""
    reached, open_ = dict.fromkeys(counts, 0), set(counts)
    while open_:
        level = risk.delta / len(open_)
        for name in open_:
            end = counts[name].size - 1
            while reached[name] < end and binomial_cdf(int(counts[name][: reached[name] + 1].sum()), int(counts[name].sum()), risk.risk) <= level:
                reached[name] += 1
        done = {name for name in open_ if reached[name] == counts[name].size - 1}
        if not done:
            break
        open_ -= done
    return reached


def fit_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, risk: Risk = Risk()) -> Cutoffs:
    """Learns from labels (doc_id, quality). The driver gets counts by rule and step, and by position of the strata with min_good labels."""
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality is not null")
    held = stats.where(~base_failed()).join(label, "doc_id").select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), (F.col("quality") == 1).alias("good"), *[c.split()[0] for c in BASE.split(", ")])
    held = shared_checkpoint(held)
    explores = F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0
    path = fit_path(held.where(~F.col("good") | explores).select("good", *[step(r).alias(r) for r in RULES]))
    if not path:
        return Cutoffs(path, {}, 0)
    trials = held.where(F.col("good") & ~explores).groupBy("stratum", "doc_id").agg(F.min(position(path)).alias("k"))
    n = trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= risk.min_good)
    pooled = trials.join(n, "stratum", "left").groupBy(F.when(F.col("n").isNotNull(), F.col("stratum")).alias("stratum"), "k").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str | None, np.ndarray] = {}
    for r in pooled.collect():
        counts.setdefault(r["stratum"], np.zeros(len(path) + 1, dtype=np.int64))[r["k"]] = r["n"]
    reached = certify(counts, risk)
    return Cutoffs(path, {name: k for name, k in reached.items() if name is not None}, reached.get(None, 0))


def verdict(cutoffs: Cutoffs, stratum: str):
    """True where no cutoff that is in force in the row's stratum is exceeded."""
    if not cutoffs.path:
        return F.lit(True)
    reach = F.lit(cutoffs.pooled)
    if cutoffs.strata:
        table = F.create_map(*[F.lit(x) for item in sorted(cutoffs.strata.items()) for x in item])
        reach = F.coalesce(F.element_at(table, F.coalesce(F.col(stratum), F.lit(""))), reach)
    return position(cutoffs.path) >= reach


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept; further columns of docs only if named in keep."""
    renamed = docs.withColumn("__stratum", F.col(stratum).cast("string"))
    stats = statistics(renamed, ("doc_id", "__stratum", *keep))
    if not keep:  # without texts the statistics are small, and one pass is enough
        stats = shared_checkpoint(stats)
    cutoffs = fit_cutoffs(stats.drop(*keep), labels, "__stratum", risk)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs, "__stratum")).drop("__stratum")
