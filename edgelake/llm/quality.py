"""Quality rules: per-text counts, and a decision list learned from labelled ones.

Everything runs as DataFrame expressions. The learner sees a bounded sample of labelled rows as counts over binned
statistics; sequential covering grows a conjunction of thresholds by information gain on two thirds of it, prunes
it on the rest, and keeps it if it is precise there. The list becomes one ordered ``CASE WHEN``.

Defined results: null text has no words, so it fails the base rules; a text of one long word has one word; ids may
be null or repeated, each row is judged by itself; labels that are null or have no document teach nothing; without
labels the list is empty and the base rules decide alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.shared import Tables, small

WHITE = "[\\x20\\x09-\\x0D]+"
#: Labelled rows that the learner uses, about; they are chosen by a hash of the id.
SAMPLE = 20_000
#: Candidate thresholds of a statistic.
THRESHOLDS = 24
MOST_RULES, MOST_CONDITIONS = 12, 3
#: A rule stays if so many of the rows that it rejects, held out from growing, are labelled bad.
PRECISION = 0.97
LEAST_ROWS = 8
WINDOW = 8


def let(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of eight words that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(rows, lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
        gaps = let(places, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def counts_of(text: Column) -> Column:
    """All counts of a text as one struct, in one expression: wherever the optimizer moves it, each part runs once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return let(
        F.array_remove(F.split(text, WHITE), ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            without("#*$%&|<>").cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).alias("distinct_words"),
            F.length(F.regexp_replace(text, "\\P{Lu}+", "")).alias("capitals"),
            without("!").alias("exclamations"),
            without("|").alias("bars"),
        ),
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def statistics(c: Column) -> dict[str, Column]:
    """What the learned conditions compare with thresholds."""
    n, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    return {
        "words": c["n_words"].cast("double"),
        "word_length": c["word_chars"] / n,
        "symbols": c["n_symbols"] / chars,
        "repeated_lines": c["n_dup_lines"] / n,
        "repeated_words": c["n_repeat_words"] / n,
        "distinct_words": c["distinct_words"] / n,
        "capitals": c["capitals"] / chars,
        "exclamations": c["exclamations"] / chars,
        "bars": c["bars"] / chars,
    }


STATISTICS = ["words", "word_length", "symbols", "repeated_lines", "repeated_words", "distinct_words", "capitals", "exclamations", "bars"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, counts: Column) -> Column:
        value = statistics(counts)[self.statistic]
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn an ordered list of rules that reject documents labelled 0."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna().groupBy("_id").agg(F.min("_label").alias("_label"))
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    names = STATISTICS
    tables = Tables()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(small(tables.write(own, "own")), "_id")
    rows = rows.select("_id", "_label", counts_of(F.col("_text")).alias("c"))
    # null labels are rows that the base rules reject; they teach nothing
    rows = rows.select("_id", F.when(~base_failed(F.col("c")), F.col("_label") == 0).alias("bad"), *(v.alias(k) for k, v in statistics(F.col("c")).items()))
    rows = tables.write(rows, "labelled")
    at = [(i + 0.5) / THRESHOLDS for i in range(THRESHOLDS)]
    bad = [F.percentile_approx(F.when(F.col("bad"), F.col(k)), at).alias(f"bad_{k}") for k in names]
    good = [F.percentile_approx(F.when(~F.col("bad"), F.col(k)), [0.0, 0.001, 0.01, 0.99, 0.999, 1.0]).alias(f"good_{k}") for k in names]
    found = rows.agg(*bad, *good).first()
    cuts: dict[str, list[float]] = {}
    for k in names:
        b, g = found[f"bad_{k}"] or [], found[f"good_{k}"] or []
        # between the values of the good and the nearest of the bad, so that unseen good rows stay on their side
        near = [(max(g) + min(x for x in b if x > max(g))) / 2] if g and any(x > max(g) for x in b) else []
        near += [(min(g) + max(x for x in b if x < min(g))) / 2] if g and any(x < min(g) for x in b) else []
        cuts[k] = sorted({*b, *g, *near})
    bins = [sum((F.col(k) >= t).cast("int") for t in cuts[k]).alias(k) if cuts[k] else F.lit(0).alias(k) for k in names]
    counts = rows.where("bad is not null").select("bad", (F.pmod(F.xxhash64("_id"), F.lit(3)) < 2).alias("grow"), *bins).groupBy("bad", "grow", *names).count().collect()  # no more than the sample
    tables.drop(*tables.held)
    return cover([(r["grow"], r["bad"], tuple(r[k] for k in names), r["count"]) for r in counts], names, cuts)


def cover(counts: list[tuple[bool, bool, tuple[int, ...], int]], names: list[str], cuts: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over (for growing, bad, bins, rows). A condition is (statistic's index, above, bin)."""
    fits = lambda bins, rule: all((bins[i] >= b) if above else (bins[i] < b) for i, above, b in rule)

    def weigh(rows: list, rule: list) -> tuple[int, int]:
        hit = [r for r in rows if fits(r[2], rule)]
        return sum(r[3] for r in hit if r[1]), sum(r[3] for r in hit if not r[1])

    found: list[Rule] = []
    while len(found) < MOST_RULES:
        grow, prune, rule = [r for r in counts if r[0]], [r for r in counts if not r[0]], []
        if sum(r[3] for r in grow if r[1]) < LEAST_ROWS:
            break
        while len(rule) < MOST_CONDITIONS:
            inside = [r for r in grow if fits(r[2], rule)]
            p0, n0 = weigh(inside, [])
            if not n0 or not p0:
                break
            best = (0.0, None)
            for i, k in enumerate(names):
                size = len(cuts[k]) + 1
                p, n = [0] * size, [0] * size
                for _, bad, bins, rows in inside:
                    (p if bad else n)[bins[i]] += rows
                up_p = up_n = 0
                for b in range(size - 1, 0, -1):
                    up_p, up_n = up_p + p[b], up_n + n[b]
                    for above, pos, neg in ((True, up_p, up_n), (False, p0 - up_p, n0 - up_n)):
                        if pos >= LEAST_ROWS:
                            gain = pos * (math.log2(pos / (pos + neg)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (i, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
        # prune the last conditions while the held-out rows don't speak for them
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*weigh(prune, r))
        if not rule:
            break
        rule = max((rule[:size] for size in range(1, len(rule) + 1)), key=lambda r: round(worth(r), 6))  # of equal ones the shortest
        p, n = weigh(prune, rule)
        gp, gn = weigh(grow, rule)
        if p + gp < LEAST_ROWS or p + n == 0 or p < PRECISION * (p + n) or gp < PRECISION * (gp + gn):
            break
        found.append(tuple(Condition(names[i], above, float(cuts[names[i]][b - 1])) for i, above, b in rule))
        counts = [r for r in counts if not fits(r[2], rule)]
    return found


def verdict(rules: list[Rule], counts: Column) -> Column:
    """The list as one ordered conditional: true if a document stays."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column(counts)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def stays(text: Column, rules: list[Rule]) -> Column:
    """Whether a text passes the base rules and the list, as one expression."""
    return let(counts_of(text), lambda c: ~base_failed(c) & verdict(rules, c))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Add the five counts, base_failed and kept to every row."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    c = F.col("__counts")
    out = docs.drop(*own, "base_failed", "kept").withColumn("__counts", counts_of(F.col(text_col)))
    return out.withColumns({k: c[k] for k in own} | {"base_failed": base_failed(c), "kept": ~base_failed(c) & verdict(rules, c)}).drop("__counts")
