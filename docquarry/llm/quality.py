"""Quality: a sparse ensemble of rules over text statistics.

Small trees are boosted on statistics of a bounded sample of labelled rows; each path from a root to a
node is a conjunctive rule; a lasso-penalised logistic fit weighs the rules and leaves most at zero. The
rest is compiled into one Spark column expression over the statistics, which are Spark columns too.

Only the rules are fitted on a sample (``most_good`` and ``most_bad`` training rows); scoring reads all
rows and whole texts. Defined results: null and empty texts have all statistics 0 and are scored by them;
without training rows of both classes every score is the smoothed share of good rows; rows that repeat an id, or
have none, are scored each by its text; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.labelled import fold, training_ids
from docquarry.llm.textkeys import quoted
from docquarry.session import table


NAMES = ["log_words", "word_length", "symbols", "upper", "digits", "distinct_words", "distinct_lines", "words_per_line", "end_marks", "bars"]


def statistics(t: Column) -> Column:
    """A record of doubles, one for each statistic of the text; null counts as empty."""
    t = F.coalesce(t, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    parts = F.struct(
        F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x != "").alias("l"),
        F.length(t).cast("double").alias("n"),
        count(r"[^\p{L}\p{N}\x20\x09-\x0D]").alias("symbols"),
        count(r"\p{Lu}").alias("upper"),
        count(r"\p{N}").alias("digits"),
        count(r"[.!?](?=\s|$)").alias("ends"),
        (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).cast("double").alias("bars"),
    )

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    def record(p: Column) -> Column:
        words, lines = F.size(p["w"]), F.size(p["l"])
        values = [
            F.log1p(words.cast("double")), over(p["n"], words), over(p["symbols"], p["n"]), over(p["upper"], p["n"]), over(p["digits"], p["n"]), over(F.size(F.array_distinct(p["w"])), words),
            over(F.size(F.array_distinct(p["l"])), lines), over(words, lines), over(p["ends"], words), over(p["bars"], words),
        ]
        return F.struct(*[v.alias(n) for v, n in zip(values, NAMES, strict=True)])

    # A lambda's variable is bound once, so that the parts are found once.
    return F.element_at(F.transform(F.array(parts), record), 1)


#: A rule is a conjunction of (statistic, is_above, threshold).
Rule = tuple[tuple[int, bool, float], ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, cuts: int = 32, rate: float = 0.3, seed: int = 3) -> list[Rule]:
    """Paths of gradient-boosted trees on logistic loss; each tree sees a random half of the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    f, rules = np.zeros(len(x)), set()

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, out: list[tuple[Rule, float]]) -> None:
        if path:
            rules.add(tuple(sorted(path)))
        best = (1e-6, None)
        G, H = g[rows].sum(), h[rows].sum()
        if len(path) < depth and len(rows) >= 20:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[j][rows]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                gain[(nl < 8) | (nl > len(rows) - 8)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            out.append((path, G / (H + 1)))
            return
        j, k = best[1]
        left = binned[j][rows] <= k
        cut = float(edges[j][k])
        grow(rows[left], g, h, (*path, (j, False, cut)), out)
        grow(rows[~left], g, h, (*path, (j, True, cut)), out)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        leaves: list[tuple[Rule, float]] = []
        grow(np.sort(rng.choice(len(x), max(1, len(x) // 2), replace=False)), y - p, p * (1 - p), (), leaves)
        for path, value in leaves:
            f += rate * value * _holds(path, x)
    return sorted(rules)


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-3, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Constant and weights of the L1-penalised logistic fit, by accelerated proximal gradient."""
    weight = weight / weight.sum()
    size = 0.25 * float(np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1]) + 0.25 if z.shape[1] else 0.25
    b, c = np.zeros(z.shape[1]), 0.0
    u, d, t = b, c, 1.0
    for _ in range(rounds):
        r = weight * (1 / (1 + np.exp(-np.clip(z @ u + d, -30, 30))) - y)
        nb, nc = u - z.T @ r / size, d - r.sum() / size
        nb = np.sign(nb) * np.maximum(np.abs(nb) - penalty / size, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, d = nb + (t - 1) / nt * (nb - b), nc + (t - 1) / nt * (nc - c)
        b, c, t = nb, nc, nt
    return c, b


@dataclass
class RuleEnsemble:
    names: list[str]
    constant: float
    rules: list[tuple[Rule, float]]

    def column(self, stats: Column) -> Column:
        """The score as a Spark column over the record of statistics."""
        z = F.lit(float(self.constant))
        for rule, weight in self.rules:
            parts = [(stats[self.names[j]] > cut) if above else (stats[self.names[j]] <= cut) for j, above, cut in rule]
            z = z + F.when(reduce(lambda a, b: a & b, parts), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[j]} {'>' if a else '<='} {c:.4g}" for j, a, c in r) for r, w in self.rules]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_good: int = 6000, most_bad: int = 6000) -> RuleEnsemble:
    ids, total = training_ids(labels, label, {1: most_good, 0: most_bad})
    names = NAMES
    stats = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", statistics(F.col("text")).alias("q")).select("y", "q.*")
    rows = np.array(sorted([float(v) for v in r] for r in stats.collect())).reshape(-1, 1 + len(names))
    x, y = rows[:, 1:], rows[:, 0]
    share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    if len(set(y)) < 2:
        return RuleEnsemble(names, float(np.log(share / (1 - share))), [])
    weight = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    rules = tree_rules(x, y)
    z = np.stack([_holds(r, x) for r in rules], 1).astype(float)
    constant, w = lasso(z, y, weight)
    return RuleEnsemble(names, constant, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6])


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """rec (the columns of ``docs``, or ``keep``) and score of each row."""
    rec = F.struct(*quoted(list(docs.columns if keep is None else keep))).alias("rec")
    stats = docs.select(rec, statistics(F.col(quoted([text])[0])).alias("q"))
    return stats.select("rec", model.column(F.col("q")).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), keep=("doc_id",)).select("rec.doc_id", "score")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
