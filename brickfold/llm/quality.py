"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of every text feed a list of rules learnt by sequential covering: a rule is a conjunction of thresholds, grown
literal by literal on two thirds of the labelled rows for the best information gain, cut back on the other third, and kept if
it is precise there; the rows it covers are set aside and the next rule is grown. Growing needs only counts by statistic,
bin and label, which Spark takes over all labelled rows. The list becomes one conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAPS, text_of, written

WINDOW = 8
BINS = 32
RULES, LITERALS = 8, 3
PRECISION = 0.9
STATISTICS = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "line_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS))


def _repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text, the first included.

    Window hashes double in width: of words, pairs, fours, eights. Sorted with their places, equal ones stand next to each
    other; most texts have none, which the distinct count tells without sorting.
    """

    def widen(hashes: Column, step: int) -> Column:
        def paired(h: Column) -> Column:
            n = F.size(h) - step
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

        return let(hashes, paired)

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            n = F.size(s) - 1
            return F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))

        places = F.array_sort(F.array_distinct(F.flatten(let(placed, twins))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    eights = widen(widen(widen(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(eights, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """__id and the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the STATISTICS the rules use."""
    own = docs.select(F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    found = own.select(
        "__id",
        let(words_of(F.col("__text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
        )).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__text", F.lit(r"[0-9]")).alias("n_digits"),
    )
    n, chars = F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest(F.col("w.word_chars"), F.lit(1))
    return found.select(
        "__id", "w.n_words", "w.word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words",
        (F.col("w.word_chars") / n).alias("word_length"), (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("l.dup") / F.greatest(F.col("l.n"), F.lit(1))).alias("dup_line_share"), (F.col("w.n_repeat_words") / n).alias("repeat_share"),
        (F.col("w.n_distinct") / n).alias("distinct_share"), (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("w.n_words") / F.greatest(F.col("l.n"), F.lit(1))).alias("line_words"),
    )


@dataclass(frozen=True)
class Literal:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [x.column() for x in rule])


def learn_rules(rows: DataFrame, label_column: str, statistics: tuple[str, ...] = STATISTICS, rules: int = RULES, literals: int = LITERALS, precision: float = PRECISION) -> list[Rule]:
    """Rules for label 0 from all labelled ``rows`` (statistics, label 0/1, __prune); no rows or one label only: no rules."""
    cuts = rows.agg(*[F.percentile_approx(s, [i / BINS for i in range(1, BINS)], 5000).alias(s) for s in statistics]).first()
    edges = {s: sorted(set(cuts[s] or [])) for s in statistics}
    binned = written(rows.select(
        label_column, "__prune", *statistics,
        F.array(*[F.size(F.array_compact(F.array(*[F.when(F.col(s) > e, F.lit(1)) for e in edges[s]]).cast("array<int>"))) for s in statistics]).alias("__bins"),
    ), "labelled")
    found: list[Rule] = []
    left = F.lit(True)
    while len(found) < rules:
        rule: Rule = ()
        seen = None
        while len(rule) < literals:
            inside = binned.filter(left & (holds(rule) if rule else F.lit(True)) & ~F.col("__prune"))
            counts = inside.select(label_column, F.posexplode("__bins").alias("s", "b")).groupBy("s", "b", label_column).count().collect()
            table = {(r["s"], r["b"], r[label_column]): r["count"] for r in counts}
            bad, good = (sum(n for (s, _, y), n in table.items() if s == 0 and y == label) for label in (0, 1))
            seen = seen or (bad, good)
            if not bad or not good:
                break
            best, literal = 0.0, None
            base = log2(bad / (bad + good))
            for k, s in enumerate(statistics):
                low = [0, 0]
                for b, e in enumerate(edges[s]):
                    for y in (0, 1):
                        low[y] += table.get((k, b, y), 0)
                    for above, p, n in ((False, low[0], low[1]), (True, bad - low[0], good - low[1])):
                        gain = p * (log2(p / (p + n)) - base) if p else 0.0
                        if gain > best * (1 + 1e-12):
                            best, literal = gain, Literal(s, above, e)
            if literal is None:
                break
            rule += (literal,)
        if not rule:
            break
        # cut back: the beginning of the rule that is worth most on the rows it was not grown on
        starts = [rule[: i + 1] for i in range(len(rule))]
        row = binned.filter(left & F.col("__prune")).agg(*[F.sum((holds(r) & (F.col(label_column) == y)).cast("long")).alias(f"c{i}_{y}") for i, r in enumerate(starts) for y in (0, 1)]).first()
        worth = [((row[f"c{i}_0"] or 0), (row[f"c{i}_1"] or 0)) for i in range(len(starts))]
        sure = [i for i, (p, n) in enumerate(worth) if p >= 3 and p >= precision * (p + n)]
        if not sure:
            break
        rule = starts[max(sure, key=lambda i: (worth[i][0] - worth[i][1], -i))]
        found.append(rule)
        left = left & ~holds(rule)
    return found


def quality_report(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, rule (the number of the rule that rejects) of each row.

    NULL texts have no words and fail. An id labelled twice counts by its lowest label; NULL labels and ids are left out of
    learning. Repeated rows stay, other columns are not read. Without labels only the base rules reject.
    """
    rows = written(text_statistics(docs, id_column, text_column), "text_statistics")
    known = labels.select(F.col(id_column).alias("__k"), F.col(label_column).cast("int").alias("__label")).dropna().groupBy("__k").agg(F.min("__label").alias("__label"))
    labelled = rows.join(known, F.col("__id") == F.col("__k")).withColumn("__prune", F.pmod(F.xxhash64("__id"), F.lit(3)) == 0)
    rules = learn_rules(labelled, "__label")
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        number = F.when(holds(rule), F.lit(i + 1)).otherwise(number)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(
        F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & number.isNull()).alias("kept"), number.alias("rule"),
        F.lit("; ".join(" and ".join(map(str, r)) for r in rules)).alias("rules"),
    )
