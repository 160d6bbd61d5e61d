"""Quality rules: text statistics and a learned decision list, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "mark_share", "upper_share", "repeat_share", "dup_line_share")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, plus the statistics of the whole text and ratios of them.

    Other columns are dropped, so that no name can clash; a whole row is kept as one struct column.
    Words are maximal runs of characters other than space and tab to carriage return. A null or empty text has zeros.
    Three-word windows are compared as text within their row; nothing is shuffled.
    """
    docs = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = F.col("_text")
    count = lambda pattern: F.size(F.split(whole, pattern, -1)) - 1
    trimmed = F.btrim(whole, F.lit(BLANKS))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = docs.withColumns({
        "_w": F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)),
        "_l": F.when(F.instr(whole, "\n") > 0, lines),
        "n_symbols": count(r"[#*$%&|<>]").cast("long"),
        "_marks": count(r"[!?]"),
        "_upper": count(r"\p{Lu}"),
    }).drop("_text")
    windows = F.when(
        F.size("_w") >= 3,
        F.transform(
            F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda x, i: F.concat_ws(" ", x, F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    ).otherwise(F.expr("cast(array() as array<string>)"))
    counted = counted.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": F.when(F.col("_l").isNull(), 0).otherwise(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_t": windows,
    }).drop("_w", "_l")
    # Windows that occur again: sorted by text, equal to a neighbour; then their places in order.
    counted = counted.withColumn("_s", F.when(
        F.size(F.array_distinct("_t")) < F.size("_t"),
        F.sort_array(F.transform("_t", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )).drop("_t")
    again = F.filter("_s", lambda p, j: (
        F.coalesce(F.get("_s", j - 1)["x"] == p["x"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["x"] == p["x"], F.lit(False))
    ))
    counted = counted.withColumn("_p", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("_s")
    # A window covers three words; those up to the next such window belong to it.
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    counted = counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.withColumns({
        "mean_word_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "mark_share": share("_marks", "word_chars"), "upper_share": share("_upper", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_words"),
    }).drop("_marks", "_upper")


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature > threshold``, or ``<=``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, none keeps."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejects(self) -> Column:
        """The ordered conditional expression."""
        return F.coalesce(self.rule_number() >= 0, F.lit(False))

    def rule_number(self) -> Column:
        """Number of the first rule that holds, else -1."""
        out = None
        for k, rule in enumerate(self.rules):
            out = F.when(_all(rule), k) if out is None else out.when(_all(rule), k)
        return F.lit(-1) if out is None else out.otherwise(-1)

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))} then reject" for r in self.rules) + "\nelse keep"


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_decision_list(
    stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", features: tuple[str, ...] = FEATURES,
    sample_rows: int = 50_000, bins: int = 32, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9,
    min_covered: int = 5,
) -> DecisionList:
    """Sequential covering of the rejected class (label 0).

    About ``sample_rows`` labelled rows take part, chosen by a hash of their key; all below that number.
    Two thirds of them grow a rule: the condition with the best FOIL gain joins until no kept row is covered;
    one third prunes it: the last conditions go while that raises (p - n) / (p + n). A rule below
    ``min_precision`` on the pruning rows ends the list. Thresholds are quantiles of both classes. The driver sees
    only counts per feature, bin and class.

    Null keys and labels take no part; several labels of a key count as several rows; without labels or
    without one of the classes the list is empty.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) == 0).alias("_bad"))
    size = known.count()
    if not size:
        return DecisionList()
    if size > sample_rows:
        known = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / size))
    rows = stats.select(F.col(key).alias("_key"), *features).join(known, "_key")
    rows = cut_lineage(rows.withColumn("_prune", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(3)) == 0), "labelled")
    quantiles = rows.groupBy("_bad").agg(*[
        F.percentile_approx(f, [k / bins for k in range(1, bins)], 10_000).alias(f) for f in features
    ]).collect()
    if len(quantiles) < 2:
        return DecisionList()
    cuts = {f: sorted({float(v) for q in quantiles for v in q[f]}) for f in features}
    left, found = rows, DecisionList()
    for _ in range(max_rules):
        rule = _grow(left.where("not _prune"), cuts, max_conditions, min_covered)
        rule = _prune(left.where("_prune"), rule, min_precision, min_covered)
        if not rule:
            break
        found.rules.append(rule)
        left = left.where(~_all(rule))
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int, min_covered: int) -> tuple[Condition, ...]:
    from math import log2

    rule: tuple[Condition, ...] = ()
    while len(rule) < most:
        # Bin k of a feature lies above its first k thresholds.
        bins = F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), _bin(F.col(f), c).alias("b"))
            for f, c in cuts.items()
        ])).alias("at")
        counted = rows.where(_all(rule)).select("_bad", bins).groupBy("at.f", "at.b").agg(
            F.count_if("_bad").alias("p"), F.count_if(~F.col("_bad")).alias("n")
        ).collect()
        table = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
        for row in counted:
            table[row["f"]][row["b"]] = [row["p"], row["n"]]
        p0, n0 = (sum(x[k] for x in next(iter(table.values()))) for k in (0, 1))
        if p0 < min_covered or (rule and n0 == 0):
            break
        best = None
        for f, c in cuts.items():
            p = n = 0
            for k, threshold in enumerate(c):
                p, n = p + table[f][k][0], n + table[f][k][1]
                for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                    if q >= min_covered and m < n0:
                        gain = q * (log2(q / (q + m)) - log2(p0 / (p0 + n0)))
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, Condition(f, above, threshold))
        if best is None:
            break
        rule += (best[1],)
    return rule


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: value > t))


def _prune(rows: DataFrame, rule: tuple[Condition, ...], min_precision: float, min_covered: int) -> tuple[Condition, ...]:
    if not rule:
        return ()
    counts = rows.agg(*[
        F.count_if(_all(rule[:k]) & (F.col("_bad") if bad else ~F.col("_bad"))).alias(f"c{k}{int(bad)}")
        for k in range(1, len(rule) + 1) for bad in (True, False)
    ]).first()
    scored = []
    for k in range(1, len(rule) + 1):
        p, n = counts[f"c{k}1"], counts[f"c{k}0"]
        if p + n:
            scored.append(((p - n) / (p + n), -k, p, n))
    if not scored:
        return ()
    _, k, p, n = max(scored)
    return rule[:-k] if p / (p + n) >= min_precision and p >= max(1, min_covered // 3) else ()


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **learning
) -> tuple[DataFrame, DecisionList]:
    """Statistics, ``base_failed`` and ``kept`` of every row, without the text; and the list that decided.

    The statistics are written once to the shared folder: the list is learned from that table and applied to it.
    """
    stats = cut_lineage(text_statistics(docs, text=text, keep=keep), "statistics")
    learned = learn_decision_list(stats.where(~base_failed()), labels, **learning)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~learned.rejects()), learned
