"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import flat, slices
from .runtime import cut
from .shingles import BASE, mix, word_hashes

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "blank", "newline", "stop", "comma", "symbol", "other_bytes",
    "distinct_words", "top_word", "distinct_pairs", "top_pair", "distinct_lines", "line_bytes", "ends_with_stop", "symbol_words",
)
#: Most labelled rows that a model is fitted on; a larger set is sampled by a hash of the id.
MAX_TRAINING_ROWS = 20_000
#: Slots of the histogram of id hashes that finds the sample's cut-off: at most this many rows reach the driver.
HASH_SLOTS = 1 << 16
#: Most rules of a model, which bounds the compiled expression.
MAX_RULES = 40

_CLASS = np.zeros((8, 256), np.int32)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), (10,), b".!?", b",;:'\"-()")):
    _CLASS[_i, list(_set)] = 1
_CLASS[7, 33:127] = 1 - _CLASS[:7, 33:127].max(axis=0)  # any other printable ASCII character


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; an empty text's are 0."""
    n = len(at) - 1
    size = np.diff(at)
    counts = np.zeros((8, n))
    for i, member in enumerate(_CLASS):
        ends = np.concatenate([[0], np.cumsum(member[raw], dtype=np.int64)])
        counts[i] = ends[at[1:]] - ends[at[:-1]]
    words, bound = word_hashes(raw, at)
    pairs = mix((words[:-1] + BASE) * BASE ^ words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    out = np.zeros((n, len(STATISTICS)))
    whole = np.maximum(size, 1)
    w = np.diff(bound)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(w)
    out[:, 2] = (size - counts[3]) / np.maximum(w, 1)
    out[:, 3:11] = (counts / whole).T[:, [0, 1, 2, 3, 4, 5, 6, 7]]
    out[:, 11] = (size - counts[[0, 1, 2, 3, 5, 6, 7]].sum(axis=0)) / whole
    for i in range(n):
        text = raw[at[i] : at[i + 1]].tobytes()
        if not w[i]:
            continue
        for col, found in ((12, words[bound[i] : bound[i + 1]]), (14, pairs[bound[i] : bound[i + 1] - 1])):
            if len(found):
                sizes = np.unique(found, return_counts=True)[1]
                out[i, col], out[i, col + 1] = len(sizes) / len(found), sizes.max() / len(found)
        lines = [x for x in text.split(b"\n") if x]
        out[i, 16], out[i, 17] = len(set(lines)) / max(len(lines), 1), np.log1p(len(text) / max(len(lines), 1))
        out[i, 18] = text.rstrip()[-1:] in (b".", b"!", b"?")
        out[i, 19] = min(counts[7, i] / w[i], 10)
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and STATISTICS of each whole text, in one map over the scan; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 2 << 20):
            values = statistics(*flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=["__id", *STATISTICS])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"__id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


# -- fitting -------------------------------------------------------------------------------

#: (statistic, True for > and False for <=, threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, above, t in rule:
        hit &= (x[:, j] > t) if above else (x[:, j] <= t)
    return hit


def tree_paths(x: np.ndarray, residual: np.ndarray, depth: int, bins: list[np.ndarray], least: int) -> tuple[list[Rule], list[tuple[Rule, float]]]:
    """A least-squares tree on ``residual``: the path to every node, and (path, mean) of its leaves."""
    paths: list[Rule] = []
    leaves: list[tuple[Rule, float]] = []

    def grow(rows: np.ndarray, path: Rule, left: int) -> None:
        if path:
            paths.append(path)
        best = (1e-9, -1, 0.0)
        y = residual[rows]
        if left and len(rows) >= 2 * least:
            total, n = y.sum(), len(rows)
            for j, edges in enumerate(bins):
                if not len(edges):
                    continue
                where = np.searchsorted(edges, x[rows, j], side="left")
                low_n = np.cumsum(np.bincount(where, minlength=len(edges) + 1))[:-1]
                low = np.cumsum(np.bincount(where, y, minlength=len(edges) + 1))[:-1]
                ok = (low_n >= least) & (n - low_n >= least)
                if ok.any():
                    gain = np.where(ok, low**2 / np.maximum(low_n, 1) + (total - low) ** 2 / np.maximum(n - low_n, 1) - total**2 / n, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(edges[k]))
        if best[1] < 0:
            leaves.append((path, float(y.mean()) if len(y) else 0.0))
            return
        _, j, t = best
        above = x[rows, j] > t
        grow(rows[~above], (*path, (j, False, t)), left - 1)
        grow(rows[above], (*path, (j, True, t)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return paths, leaves


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400, start: tuple[np.ndarray, float] | None = None, step: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient descent, from ``start`` if given."""
    n, d = z.shape
    step = step or lasso_step(z)
    weight, base = start or (np.zeros(d), 0.0)
    ahead, ahead_base, t = weight, base, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead.astype(z.dtype) + ahead_base, -30, 30).astype(float)))
        moved = ahead - step * ((p - y).astype(z.dtype) @ z).astype(float) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_base = ahead_base - step * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_base = new + (t - 1) / t_new * (new - weight), new_base + (t - 1) / t_new * (new_base - base)
        weight, base, t = new, new_base, t_new
    return weight, base


def lasso_step(z: np.ndarray) -> float:
    """A step no longer than the inverse of the loss's curvature."""
    return 4.0 / max(float(np.linalg.eigvalsh(z.T @ z)[-1]) / len(z) + 1, 1e-9)


def lasso_path(z: np.ndarray, y: np.ndarray, most: int, check: np.ndarray, points: int = 16, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept at the penalty that predicts the rows of ``check`` best, with at most ``most`` weights.

    Penalties fall geometrically from the one that silences every rule.  The path is first
    followed on the other rows; the penalty with the least loss on ``check`` is taken, and the path
    to it is followed on all rows, no further than ``most`` weights.
    """
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    top = float(np.abs((y - y.mean()).astype(z.dtype) @ z).max()) / len(z)
    penalties = top * np.geomspace(1, 1e-3, points + 1)[1:]

    def follow(rows: np.ndarray, penalties: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        at, step = (np.zeros(z.shape[1]), float(np.log(prior / (1 - prior)))), lasso_step(z[rows])
        for penalty in penalties:
            at = lasso_logistic(z[rows], y[rows], penalty, rounds, at, step)
            if np.count_nonzero(at[0]) > most:
                return
            yield at

    losses = []
    for weight, base in follow(~check, penalties):
        total = np.clip(z[check] @ weight.astype(z.dtype) + base, -30, 30).astype(float)
        losses.append(np.log1p(np.exp(-np.where(y[check] > 0, total, -total))).mean())
    if not losses:
        return np.zeros(z.shape[1]), float(np.log(prior / (1 - prior)))
    chosen = int(np.argmin(losses))
    found = np.zeros(z.shape[1]), float(np.log(prior / (1 - prior)))
    for found in follow(np.ones(len(z), bool), penalties[: chosen + 1]):
        pass
    return found


@dataclass(frozen=True)
class RuleModel:
    """``intercept`` plus the weight of every rule that holds, through the logistic function."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def tests(self) -> list[tuple[int, bool, float]]:
        """The distinct threshold tests of all rules."""
        return sorted({test for rule, _ in self.rules for test in rule})

    def apply(self, stats: DataFrame, name: str) -> DataFrame:
        """``stats`` with the score as column ``name``.

        Every distinct threshold test becomes one boolean column in a projection of its own, rules
        are conjunctions of those, and their weights are added in a balanced tree, so the
        expression stays as small and as shallow as its at most MAX_RULES rules allow.
        """
        tests = {t: f"__test_{k}" for k, t in enumerate(self.tests())}
        shown = stats.withColumns({c: (F.col(STATISTICS[j]) > t) if above else (F.col(STATISTICS[j]) <= t) for (j, above, t), c in tests.items()}) if tests else stats
        terms = [F.lit(self.intercept)]
        for rule, weight in self.rules:
            terms.append(F.when(reduce(Column.__and__, [F.col(tests[t]) for t in rule]), F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
        return shown.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))).drop(*tests.values())

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, rate: float = 0.3, most: int = MAX_RULES, seed: int = 1) -> RuleModel:
    """Boost small trees, take the path to each of their nodes as a rule, and weigh the rules by lasso.

    The penalty is chosen on a fifth of the rows (see ``lasso_path``); at most ``most`` rules are
    left.  Rows are ordered by their values first, so the model depends on the set of rows
    alone.  One class gives its smoothed share as a constant score, no rows 0.5.
    """
    n = len(y)
    prior = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    if n < 20 or y.min() == y.max():
        return RuleModel((), base)
    by = np.lexsort((*x.T, y))
    x, y = x[by], y[by].astype(float)
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1], method="lower")) for c in x.T]
    rng = np.random.default_rng(seed)
    seen: dict[Rule, None] = {}
    total = np.full(n, base)
    for _ in range(trees):
        part = rng.permutation(n)[: max(20, n // 2)]
        p = 1 / (1 + np.exp(-total))
        paths, leaves = tree_paths(x[part], (y - p)[part] / 0.25, depth, bins, max(5, n // 1000))
        seen.update(dict.fromkeys(paths))
        for path, value in leaves:
            total[_holds(path, x)] += rate * value
    # rules that hold for the same rows count once; single precision keeps this the largest array, 4 bytes a row and rule
    distinct: dict[bytes, Rule] = {}
    for rule in seen:
        hit = _holds(rule, x)
        if 0 < hit.sum() < n:
            distinct.setdefault(np.packbits(hit).tobytes(), rule)
    rules = list(distinct.values())
    if not rules:
        return RuleModel((), base)
    z = np.empty((n, len(rules)), np.float32)
    for k, rule in enumerate(rules):
        z[:, k] = _holds(rule, x)
    share = z.mean(axis=0, dtype=float)
    spread = np.sqrt(share * (1 - share))
    z -= share.astype(np.float32)
    z /= spread.astype(np.float32)
    check = np.zeros(n, bool)
    for label in (0, 1):  # a fifth of each class, at least one row
        rows = np.flatnonzero(y == label)
        check[rng.permutation(rows)[: max(1, len(rows) // 5)]] = True
    weight, intercept = lasso_path(z, y, most, check)
    weight = weight / spread
    intercept -= float(weight @ share)
    kept = tuple((r, float(w)) for r, w in zip(rules, weight, strict=True) if w)
    return RuleModel(kept, intercept)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text is divisible by ``folds``; labels are never learnt from them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = 0.3, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per row: ``id_col``, held_out, score, predicted, row_tag.

    Statistics of every whole text are written once.  A model is fitted on at most ``max_rows``
    labelled rows outside the held-out fold (those with the least hash of the id) and compiled
    into column expressions, so scoring is a projection of the written statistics: text is
    read once and never shuffled.  Only the bounded training rows, and a histogram of HASH_SLOTS
    counts that finds them, reach the driver.

    Labels that are null, or whose id is null or not in ``docs``, are ignored; an id labelled
    more than once counts with its smallest label.  Null and empty texts are scored on
    statistics of 0.  predicted is 1 if score >= ``threshold``.
    """
    stats = cut(text_statistics(docs, id_col, text_col).withColumn("row_tag", F.monotonically_increasing_id()), "quality-stats")
    labelled = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    labelled = labelled.where(~held_out("__id")).groupBy("__id").agg(F.min("__y").alias("__y"))
    known = cut(stats.join(labelled, "__id").select(F.xxhash64("__id").alias("__h"), "__y", *STATISTICS), "quality-labelled")
    chosen = _least_hashes(known, max_rows).toArrow()
    x = np.column_stack([chosen.column(s).to_numpy() for s in STATISTICS]) if chosen.num_rows else np.zeros((0, len(STATISTICS)))
    y = chosen.column("__y").to_numpy() if chosen.num_rows else np.zeros(0)
    model = fit_rules(x, (y > 0).astype(float))
    scored = model.apply(stats, "__score").select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), F.col("__score").alias("score"), "row_tag")
    return scored.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "row_tag")


def _least_hashes(known: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the least ``__h``.

    A histogram of the hashes, pre-aggregated, finds the slot in which the last of them lies, so no
    more than ``most`` rows and that slot's are sorted by one task, however many rows there are.
    """
    slot = F.pmod(F.shiftrightunsigned("__h", 64 - (HASH_SLOTS.bit_length() - 1)), F.lit(HASH_SLOTS))
    sizes = known.groupBy(slot.alias("s")).agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(sizes.column("s").to_numpy())
    slots, ends = sizes.column("s").to_numpy()[order], np.cumsum(sizes.column("n").to_numpy()[order])
    last = int(slots[min(np.searchsorted(ends, most), len(slots) - 1)]) if len(slots) else 0
    return known.where(slot <= last).orderBy(slot, "__h", *STATISTICS).limit(most)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged; ``docs`` should read a written table."""
    tag = "__row_tag"
    while tag in docs.columns:
        tag += "_"
    good = classify(docs, labels, id_col, text_col, **options).where("predicted = 1").select(F.col("row_tag").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(good, tag, "left_semi").select(*docs.columns)
