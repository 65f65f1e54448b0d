"""Quality rules learned as a decision list.

Statistics of whole texts are made in one pass of array work. From a bounded
sample of labelled rows a decision list is learned by sequential covering: a
rule is grown on two thirds of the rows still uncovered, threshold by threshold,
for the best information gain on bad documents; it is pruned on the other third
from its end; it is kept if it is nearly always right there. Rows that it covers
leave, and the next rule is learned on the rest. The list becomes one ordered
Spark conditional expression.

`MOST_LABELLED` bounds the sample: the rows with the smallest seeded hashes of
their ids. Statistics and verdicts cover all documents.

The labelled rows are brought into the order of their ids before the seeded
permutation that splits them, so the list is a function of the tables, however
they are partitioned.

Defined results: a null or empty text has zero for every statistic and fails the
base rule; labels that are null or whose document is missing are not used; of
labels that repeat a document the lowest counts, and of labelled documents that
repeat an id the one with the smallest statistics teaches; rows that repeat an id
are judged each by its own text; with no labels, or labels of one kind only, the
list is empty and keeps what the base rule keeps; other columns pass through and
may carry any name.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

MOST_LABELLED = 20_000
SEED = 977
#: A rule stays if at least this share of what it covers in the pruning rows is bad, and it covers that many there.
LEAST_PRECISION, LEAST_COVER = 0.95, 4
MOST_RULES, MOST_CONDITIONS, THRESHOLDS = 24, 4, 48

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_digits", "n_distinct")
#: What the rules test: name, numerator, denominator.
RATIOS = (
    ("symbols per character", "n_symbols", "word_chars"),
    ("symbols per word", "n_symbols", "n_words"),
    ("upper-case share", "n_upper", "word_chars"),
    ("exclamation marks per word", "n_bangs", "n_words"),
    ("digit share", "n_digits", "word_chars"),
    ("repeated line share", "n_dup_lines", "n_lines"),
    ("repeated word share", "n_repeat_words", "n_words"),
    ("distinct word share", "n_distinct", "n_words"),
    ("characters per word", "word_chars", "n_words"),
    ("words per line", "n_words", "n_lines"),
    ("words", "n_words", None),
)


def _marks(letters: bytes) -> np.ndarray:
    made = np.zeros(256, bool)
    made[list(letters)] = True
    return made


_SYMBOL = _marks(b"#*$%&|<>")
_UPPER = _marks(bytes(range(0x41, 0x5B)))
_DIGIT = _marks(b"0123456789")
_BANG = _marks(b"!")


def _codes(values: pa.Array | np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for equal values."""
    made = (pa.array(values) if isinstance(values, np.ndarray) else values).dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(made.dictionary)


def _distinct(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each of n documents has."""
    return np.bincount(pa.array(codes * n + doc).dictionary_encode().dictionary.to_numpy() % n, minlength=n)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a column."""
    data, offsets = shared.text_bytes(column)
    n = len(offsets) - 1
    inside = ~shared.SPACE_BYTES[data]

    def counted(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    out = {"word_chars": counted(inside & ((data & 0xC0) != 0x80)), "n_symbols": counted(_SYMBOL[data]), "n_upper": counted(_UPPER[data]), "n_digits": counted(_DIGIT[data]), "n_bangs": counted(_BANG[data])}

    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, at, side="right") - 1
    before = np.concatenate([[0], np.cumsum(inside)])
    words, kinds = _codes(shared.bytes_array(data[inside], np.append(before[at], before[-1])))
    out["n_words"] = np.bincount(doc, minlength=n)
    out["n_distinct"] = _distinct(words, doc, n)

    covered = np.zeros(len(words) + 2, bool)
    if len(words) > 2:
        whole = doc[:-2] == doc[2:]
        pair, _ = _codes(words[:-1] * kinds + words[1:])
        triple, _ = _codes(pair[:-1] * kinds + words[2:])
        key, found = _codes(triple * n + doc[:-2])
        often = whole & (np.bincount(key[whole], minlength=found) > 1)[key]
        for k in range(3):
            covered[k : k + len(often)] |= often
    out["n_repeat_words"] = np.bincount(doc[covered[: len(words)]], minlength=n)

    breaks = data == 0x0A
    cut = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(breaks) + 1]))
    cut = cut[cut < len(data)]
    line_doc = np.searchsorted(offsets, cut, side="right") - 1
    ends = np.append(cut[1:], len(data))
    kept = np.concatenate([[0], np.cumsum(~breaks)])
    lines, _ = _codes(shared.bytes_array(data[~breaks], np.append(kept[cut], kept[-1])))
    full = before[ends] > before[cut]
    out["n_lines"] = np.bincount(line_doc[full], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(lines[full], line_doc[full], n)
    return out


def _measured(batches: Iterator[pa.RecordBatch], text: str, carried: list[str]) -> Iterator[pa.RecordBatch]:
    shared.serves("quality")
    for batch in shared.bounded(batches, text):
        found = measure(batch.column(text))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array(found[s].astype(np.int64)) for s in STATISTICS]], names=[*carried, *[f"_td_{s}" for s in STATISTICS]])


def with_statistics(docs: DataFrame, text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Columns `carried` (all of them unless told) as _in_0, _in_1, ... and the statistics as _td_<name>."""
    carried = docs.columns if carried is None else carried
    names = [f"_in_{i}" for i in range(len(carried))]
    rows = docs.select(*[shared.named(c).alias(a) for c, a in zip(carried, names, strict=True)], *([] if text_col in carried else [shared.named(text_col).alias("_td_text")]))
    text = names[carried.index(text_col)] if text_col in carried else "_td_text"
    schema = T.StructType([*[T.StructField(a, docs.schema[c].dataType) for c, a in zip(carried, names, strict=True)], *[T.StructField(f"_td_{s}", T.LongType()) for s in STATISTICS]])
    return shared.through(rows, lambda it: _measured(it, text, names), schema)


@dataclasses.dataclass(frozen=True)
class Condition:
    ratio: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.ratio] >= self.threshold if self.above else x[:, self.ratio] <= self.threshold

    def column(self, prefix: str = "_td_") -> Column:
        value = ratio_column(self.ratio, prefix)
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{RATIOS[self.ratio][0]} {'>=' if self.above else '<='} {self.threshold:g}"


@dataclasses.dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    bad: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} ({self.bad} bad of {self.covered})"


@dataclasses.dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def keeps(self, prefix: str = "_td_") -> Column:
        """One ordered conditional expression: false at the first rule that holds, true if none does."""
        made = None
        for rule in self.rules:
            test = rule.conditions[0].column(prefix)
            for c in rule.conditions[1:]:
                test = test & c.column(prefix)
            made = F.when(test, False) if made is None else made.when(test, False)
        return F.lit(True) if made is None else made.otherwise(True)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= rule.holds(x)
        return out


def ratio_column(k: int, prefix: str = "_td_") -> Column:
    _, top, under = RATIOS[k]
    value = F.col(prefix + top).cast("double")
    return value if under is None else F.when(F.col(prefix + under) > 0, value / F.col(prefix + under)).otherwise(F.lit(0.0))


def ratios(rows: pd.DataFrame, prefix: str = "_td_") -> np.ndarray:
    out = np.zeros((len(rows), len(RATIOS)))
    for k, (_, top, under) in enumerate(RATIOS):
        value = rows[prefix + top].to_numpy(float)
        below = np.ones(len(rows)) if under is None else rows[prefix + under].to_numpy(float)
        out[:, k] = np.divide(value, below, out=np.zeros(len(rows)), where=below > 0)
    return out


def _grown(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Adds the threshold with the best FOIL gain until no good row is covered or nothing is gained."""
    made: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(made) < MOST_CONDITIONS and inside.any() and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for k in range(x.shape[1]):
            values = x[inside, k]
            for threshold in np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS), method="nearest")):
                for above in (True, False):
                    hit = values >= threshold if above else values <= threshold
                    q = int(bad[inside][hit].sum())
                    if q and hit.sum() < len(values):
                        gain = q * (np.log2(q / hit.sum()) - base)
                        if gain > best[0]:
                            best = (gain, Condition(k, above, float(threshold)))
        if best[1] is None:
            break
        # A tighter threshold takes the place of an earlier one on the same side.
        made = [c for c in made if (c.ratio, c.above) != (best[1].ratio, best[1].above)] + [best[1]]
        inside &= best[1].holds(x)
    return made


def _pruned(conditions: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    def worth(some: list[Condition]) -> float:
        hit = np.logical_and.reduce([c.holds(x) for c in some])
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((conditions[: k + 1] for k in range(len(conditions))), key=lambda some: (worth(some), -len(some)))


def learn(rows: pd.DataFrame, label: str = "_td_label", prefix: str = "_td_") -> DecisionList:
    """A decision list from statistics and a label: 0 is bad, anything else good."""
    if not len(rows):
        return DecisionList(())
    x, bad = ratios(rows, prefix), rows[label].to_numpy() == 0
    order = np.random.default_rng(SEED).permutation(len(x))
    x, bad = x[order], bad[order]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and bad.any() and (~bad).any():
        third = np.arange(len(x)) % 3 == 0
        if not bad[~third].any() or not bad[third].any():
            break
        conditions = _grown(x[~third], bad[~third])
        if not conditions:
            break
        conditions = _pruned(conditions, x[third], bad[third])
        rule = Rule(tuple(conditions), 0, 0)
        hit = rule.holds(x[third])
        if hit.sum() < LEAST_COVER or bad[third][hit].mean() < LEAST_PRECISION:
            break
        hit = rule.holds(x)
        rules.append(Rule(tuple(conditions), int(hit.sum()), int(bad[hit].sum())))
        x, bad = x[~hit], bad[~hit]
    return DecisionList(tuple(rules))


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most MOST_LABELLED labels: _td_label_id, _td_label."""
    rows = labels.select(shared.named(id_col).cast("long").alias("_td_label_id"), shared.named(label_col).cast("int").alias("_td_label")).dropna()
    return rows.groupBy("_td_label_id").agg(F.min("_td_label").alias("_td_label")).orderBy(F.xxhash64("_td_label_id", F.lit(SEED)), "_td_label_id").limit(MOST_LABELLED)


def base_failed(prefix: str = "_td_") -> Column:
    return (F.col(prefix + "n_words") < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


def _taught(labelled: DataFrame) -> pd.DataFrame:
    """One row for each labelled id (_in_0), at most MOST_LABELLED, in the order of the ids."""
    told = F.struct(*[F.col(f"_td_{s}") for s in STATISTICS])
    rows = labelled.groupBy("_in_0", "_td_label").agg(F.min(told).alias("s")).select("_in_0", "_td_label", "s.*").toPandas()
    return rows.sort_values("_in_0", ignore_index=True)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    measured = shared.staged(with_statistics(docs.select(shared.named(id_col).cast("long").alias("doc_id"), shared.named(text_col).alias("text")), "text", ["doc_id"]), "statistics")
    rules = learn(_taught(measured.join(F.broadcast(labelled_sample(labels)), F.col("_in_0") == F.col("_td_label_id"))))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select(F.col("_in_0").alias("doc_id"), *[F.col(f"_td_{s}").alias(s) for s in shown], base_failed().alias("base_failed"), (~base_failed() & rules.keeps()).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns of the input; texts are not shuffled."""
    sample = F.broadcast(labelled_sample(labels))
    labelled = docs.select(shared.named(id_col).cast("long").alias("doc_id"), shared.named(text_col).alias("text")).join(sample, F.col("doc_id") == F.col("_td_label_id"))
    rules = learn(_taught(with_statistics(labelled, "text", ["doc_id", "_td_label"]).withColumnRenamed("_in_1", "_td_label")))
    passed = with_statistics(docs, text_col).where(~base_failed() & rules.keeps())
    return passed.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])
