"""Quality by a sparse rule ensemble.

Statistics of a text are column expressions. Small trees on them, grown one
after another on what the ones before leave unexplained, give conjunctive rules
(every path from a root). A lasso logistic fit gives few of the rules a weight,
and these are compiled to one Spark column: every document is scored by a
narrow scan without Python.

Fitted on a bounded sample of labelled rows (`sample_rows`); ids, labels,
language and source are no inputs. A null text counts as empty and gets a score
too. Without both classes in the sample, every score is the share of the
positive class. Repeated rows, null ids and further columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tradelake.llm.labelled import held_out, sample

SAMPLE_ROWS, TREES, DEPTH, BINS = 20_000, 30, 3, 32
SPACES = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """What the rules look at."""
    text = F.coalesce(text, F.lit(""))
    count = lambda kind: F.char_length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("double")
    words = F.array_remove(F.split(text, SPACES), "")
    w = F.transform(F.array(words), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"),
                                                       F.char_length(F.array_join(x, "")).alias("c")))[0]
    lines = F.transform(F.array(F.split(text, "\n")), lambda x: F.struct(
        F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0]
    return {"w": w, "l": lines, "capitals": count("A-Z"), "digits": count("0-9"), "symbols": count("#*$%&<>@~^=_{}"),
            "bars": count("|"), "bangs": count("!"), "commas": count(",;:"), "stops": count(".?"), "chars": F.char_length(text)}


def inputs(docs: DataFrame) -> DataFrame:
    """docs with one column `x`, an array of the inputs named in INPUTS."""
    s = docs.withColumn("s", F.struct(*(c.alias(k) for k, c in statistics(F.col("text")).items())))
    n = F.greatest(F.col("s.w.n"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("s.chars"), F.lit(1)).cast("double")
    columns = {
        "words": F.col("s.w.n"), "word_length": F.col("s.w.c") / n, "distinct_words": F.col("s.w.d") / n,
        "distinct_lines": F.col("s.l.d") / F.col("s.l.n"), "line_words": n / F.col("s.l.n"),
        "capitals": F.col("s.capitals") / chars, "digits": F.col("s.digits") / chars,
        "symbols": F.col("s.symbols") / n, "bars": F.col("s.bars") / n, "bangs": F.col("s.bangs") / n,
        "commas": F.col("s.commas") / n, "stops": F.col("s.stops") / n,
        "capitals_per_stop": F.col("s.capitals") / (F.col("s.stops") + 1),
    }
    if tuple(columns) != INPUTS:
        raise AssertionError("INPUTS and columns differ")
    return s.withColumn("x", F.array(*(c.cast("double") for c in columns.values()))).drop("s")


INPUTS = ("words", "word_length", "distinct_words", "distinct_lines", "line_words", "capitals", "digits", "symbols",
          "bars", "bangs", "commas", "stops", "capitals_per_stop")

#: A rule is a tuple of conditions (input, above?, threshold): x > t, or x <= t.
Rule = tuple[tuple[int, bool, float], ...]


def _split(x: np.ndarray, cuts: list[np.ndarray], r: np.ndarray, h: np.ndarray, least: int):
    """The input and threshold that lower the squared error most."""
    best = (1e-9, 0, 0.0)
    whole = r.sum() ** 2 / (h.sum() + 1)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        bin_ = np.searchsorted(c, x[:, j], "left")
        a, b, n = (np.cumsum(np.bincount(bin_, v, len(c) + 1))[:-1] for v in (r, h, np.ones(len(r))))
        gain = a**2 / (b + 1) + (r.sum() - a) ** 2 / (h.sum() - b + 1) - whole
        gain[(n < least) | (len(r) - n < least)] = 0
        if gain.max() > best[0]:
            best = (gain.max(), j, c[gain.argmax()])
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, each on half of the rows and inputs, as rules in a fixed order."""
    rng, margin, rules = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    for _ in range(trees):
        use = rng.random(x.shape[1]) < 0.5
        mine = [c if u else c[:0] for c, u in zip(cuts, use)]
        p = 1 / (1 + np.exp(-margin))
        nodes = [((), np.arange(len(y)))]
        for level in range(depth):
            below = []
            for rule, rows in nodes:
                half = rows[rng.random(len(rows)) < 0.5]
                gain, j, t = _split(x[half], mine, (y - p)[half], (p * (1 - p))[half], 10)
                if gain <= 1e-6:
                    continue
                over = x[rows, j] > t
                below += [((*rule, (j, True, float(t))), rows[over]), ((*rule, (j, False, float(t))), rows[~over])]
            for rule, rows in below:
                rules.setdefault(tuple(sorted(rule)))
                if level == depth - 1 and len(rows):
                    margin[rows] += 0.5 * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1)
            nodes = below
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute penalty, and the intercept, by proximal gradient steps."""
    scale = np.maximum(z.std(0), 1e-3)
    mean = z.mean(0)
    z = ((z - mean) / scale).astype(np.float32)
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w = v = np.zeros(z.shape[1], np.float32)
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        g = v - rate * (r @ z) / len(y)
        nw, nb = np.sign(g) * np.maximum(np.abs(g) - rate * penalty, 0), c - rate * r.mean()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, w, b, t = nw + (t - 1) / u * (nw - w), nb + (t - 1) / u * (nb - b), nw, nb, u
    return w / scale, float(b - (w / scale) @ mean)


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self, x: Column) -> Column:
        """The score as a column over the array of inputs."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for j, above, t in rule:
                met = met & ((x[j] > t) if above else (x[j] <= t))
            margin = margin + F.when(met, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def describe(self) -> list[str]:
        told = lambda c: f"{INPUTS[c[0]]} {'>' if c[1] else '<='} {c[2]:.4g}"
        return [f"{w:+.3f} if {' and '.join(map(told, rule))}" for rule, w in self.rules]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
          penalty: float = 1e-3) -> RuleModel:
    known = docs.select("doc_id", "text").join(F.broadcast(sample(labels, label, sample_rows)), "doc_id")
    got = inputs(known).select("y", "x", "doc_id").toArrow()
    y = got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel([], float(np.log(share / (1 - share))))
    x = np.array(got["x"].to_pylist())
    order = np.lexsort((*x.T, y))  # rows come in any order
    x, y = x[order], y[order]
    rules = grow(x, y)
    z = np.column_stack([holds(r, x) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    if not rules:
        return RuleModel([], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(z, y, penalty)
    kept = [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6]
    return RuleModel(kept, b)


def report(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, **options) -> DataFrame:
    model = train(docs, labels, **options)
    s = inputs(docs.select("doc_id", "text")).select("doc_id", model.column(F.col("x")).alias("score"))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
