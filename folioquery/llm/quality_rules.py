"""Quality rules: a learned decision list over text statistics, applied as ordered Spark conditional expressions.

All statistics are built-in column expressions over the whole text. Learning is sequential covering: rules are conjunctions
of thresholds, grown on one part of the labelled statistics by information gain, pruned on the
other, and added while they are precise; what a rule covers leaves the data. The labelled statistics
reach the driver only as counts of binned values, from at most about ``most_labels`` rows chosen by a
hash of doc_id (a bound on fitting alone; every row is judged).

Defined cases: a null or empty text has no words, so it fails the base rule; repeated rows are judged
alike; rows of ``labels`` whose quality is null, or that match no document, do not train; contradicting labels of a document
count each; without labels the list is empty and the base rule alone decides. Ties between conditions go
to the first statistic and lower threshold. Input columns of documents are not carried through, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

SPACES = "\\t\\n\\x0b\\f\\r "
_SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test, as shares or means that do not depend on the text's length.
FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "line_words", "log_words")


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _let(value: Column, body) -> Column:
    """Bind an array expression once: lambda variables are evaluated a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice: sort (hash, position), flag equal neighbours."""

    def positions(triples: Column) -> Column:
        def flagged(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            at = lambda i: F.get(ordered, i).getField("h")
            near = F.transform(ordered, lambda x, i: F.when(((i > 0) & (at(i - 1) == x["h"])) | ((i < last) & (at(i + 1) == x["h"])), x["p"]))
            return F.filter(near, lambda p: p.isNotNull())

        def covered(p: Column) -> Column:
            return F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2)))

        return _let(F.sort_array(triples), lambda s: _let(flagged(s), covered))

    def triples(w: Column) -> Column:
        n = F.size(w)
        zipped = F.arrays_zip(F.slice(w, F.lit(1), n - 2).alias("a"), F.slice(w, F.lit(2), n - 2).alias("b"), F.slice(w, F.lit(3), n - 2).alias("c"))
        return F.transform(zipped, lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("p")))

    return F.when(F.size(words) >= 3, _let(words, lambda w: positions(triples(w)))).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the base statistics of each row's whole text, then the features that rules test."""
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    trimmed = F.btrim(F.col("__t"), F.lit(_SPACE_CHARS))
    base = base.select("doc_id", "__t", F.when(trimmed != "", F.split(trimmed, f"[{SPACES}]+")).otherwise(F.array().cast("array<string>")).alias("__w"), F.split("__t", "\n").alias("__l"))
    lines = F.filter("__l", lambda x: F.btrim(x, F.lit(_SPACE_CHARS)) != "")
    text = F.col("__t")
    out = base.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        (F.length(text) - _removed(text, _SPACE_CHARS)).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).alias("n_repeat_words"),
        _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("__upper"),
        _removed(text, "0123456789").alias("__digits"),
        _removed(text, "!?").alias("__marks"),
        F.size(lines).cast("long").alias("__lines"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))).alias("dup_line_rate"),
        (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("__upper") / chars).alias("upper_rate"),
        (F.col("__digits") / chars).alias("digit_rate"),
        (F.col("__marks") / words).alias("mark_rate"),
        (F.col("n_words") / F.greatest(F.col("__lines"), F.lit(1))).alias("line_words"),
        F.log2(words.cast("double")).alias("log_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction; what it covers is of low quality."""

    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in self.conditions)


def _gain(bad: float, good: float, bad_in: float, good_in: float) -> float:
    """Information gain of narrowing (bad, good) to (bad_in, good_in), after Quinlan."""
    if not bad_in:
        return -1.0
    return bad_in * (math.log2(bad_in / (bad_in + good_in)) - math.log2(bad / (bad + good)))


def learn(cells: list[tuple[tuple[int, ...], int, int, int]], edges: dict[str, list[float]], least: int = 8, precision: float = 0.95, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Grow and prune rules on cells (bins, part, bad, good); part 0 grows, part 1 prunes.

    A condition on bins compares a bin number with a cut: bin k holds values in (edges[k-1], edges[k]].
    """
    names = list(edges)

    def inside(cell: tuple, conditions: list[tuple[int, bool, int]]) -> bool:
        return all((cell[0][f] > cut) == above for f, above, cut in conditions)

    def weigh(part: int | None, conditions: list, rows: list) -> tuple[int, int]:
        hit = [c for c in rows if (part is None or c[1] == part) and inside(c, conditions)]
        return sum(c[2] for c in hit), sum(c[3] for c in hit)

    left, rules = list(cells), []
    while len(rules) < most_rules:
        grow = [c for c in left if c[1] == 0]
        conditions: list[tuple[int, bool, int]] = []
        while len(conditions) < most_conditions:
            now = [c for c in grow if inside(c, conditions)]
            bad, good = sum(c[2] for c in now), sum(c[3] for c in now)
            if not bad or not good:
                break
            best, pick = 0.0, None
            for f, name in enumerate(names):
                bins = [[0, 0] for _ in range(len(edges[name]) + 1)]
                for c in now:
                    bins[c[0][f]][0] += c[2]
                    bins[c[0][f]][1] += c[3]
                low_bad = low_good = 0
                for cut in range(len(edges[name])):
                    low_bad, low_good = low_bad + bins[cut][0], low_good + bins[cut][1]
                    for above, b, g in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                        if b >= least and (gain := _gain(bad, good, b, g)) > best + 1e-9:
                            best, pick = gain, (f, above, cut)
            if pick is None:
                break
            conditions.append(pick)
        if not conditions:
            break

        def worth(some: list) -> float:  # on the pruning part, with a small prior for good
            b, g = weigh(1, some, left)
            return (b - g) / (b + g + 1)

        while len(conditions) > 1:
            fewer = max(([c for c in conditions if c is not gone] for gone in reversed(conditions)), key=worth)
            if worth(fewer) < worth(conditions):
                break
            conditions = fewer
        bad, good = weigh(None, conditions, left)
        bad_1, good_1 = weigh(1, conditions, left)
        if bad < least or bad < precision * (bad + good) or bad_1 < precision * (bad_1 + good_1):
            break
        rules.append(Rule(tuple(Condition(names[f], above, edges[names[f]][cut]) for f, above, cut in conditions), bad + good, bad / (bad + good)))
        left = [c for c in left if not inside(c, conditions)]
    return rules


def _bin(feature: str, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    value = F.col(feature)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, bins: int = 24, **limits) -> list[Rule]:
    """Learn rules for ``quality = 0`` from ``labels`` (doc_id, quality)."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), (F.col("quality") == 0).alias("__bad"))
    marked = marked.distinct()  # repeated labels count once
    total = marked.count()
    if not total:
        return []
    hashed = marked.withColumn("h", F.xxhash64("__id", "__bad", F.lit(5)))
    few = hashed.where(F.col("h") <= kit.hash_bound(2 * most_labels / total))
    chosen = few if total <= most_labels else (few if few.count() >= most_labels else hashed).orderBy("h").limit(most_labels)
    chosen = chosen.select("__id", "__bad")  # most_labels rows of an id and a flag at most: within the bound for a broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    stats = statistics(met.select(F.struct("doc_id", "__bad").alias("doc_id"), "text")).select("doc_id.*", *FEATURES).cache()
    try:
        steps = [i / bins for i in range(1, bins)]
        cuts = stats.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first()
        edges = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
        number = [_bin(f, edges[f]).alias(f"b{i}") for i, f in enumerate(FEATURES)]
        keys = [f"b{i}" for i in range(len(FEATURES))]
        part = F.expr("cast(pmod(xxhash64(doc_id, 11), 3) = 0 as int)").alias("part")
        cells = stats.select(*number, part, F.col("__bad")).groupBy(*keys, "part").agg(F.sum(F.col("__bad").cast("int")).alias("bad"), F.sum((~F.col("__bad")).cast("int")).alias("good"))
        rows = [(tuple(r[: len(keys)]), r["part"], r["bad"], r["good"]) for r in cells.orderBy(*keys, "part").collect()]
    finally:
        stats.unpersist()
    return learn(rows, edges, **limits)


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept, and ``rule``: the number of the first rule that fired (null: none)."""
    stats = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fired = F.lit(None).cast("int")
    if rules:
        fired = F.when(rules[0].column(), F.lit(1))
        for i, rule in enumerate(rules[1:], 2):
            fired = fired.when(rule.column(), F.lit(i))
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), fired.cast("int").alias("rule"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
