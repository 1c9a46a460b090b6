"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one
bit per failed rule, so a policy (a named set of rules) is a bit test, and the effect of
any rule on any policy is a bitwise aggregate over the distinct failure masks.

No shuffle is needed to build the ledger or to apply a policy, and repeated windows are
found inside the row by sorting the windows of texts in which a window hash repeats.

Defined results: a null or blank text has no words and fails ``few_words``; nulls in other
columns pass through; repeated rows give repeated rows; an empty table gives an empty one;
extra columns are kept by ``apply_policy`` and ignored by ``ledger``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.llm.tables import free_name

SEPARATORS = r"[\x20\x09-\x0D]+"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_shouts",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` of the measurements is true. Its place in RULES is its bit."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


# The order fixes the bits: add new rules at the end only.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 30 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("upper_case", lambda m: 100 * m("n_upper") > 40 * m("word_chars")),
    Rule("shouting", lambda m: 100 * m("n_shouts") > 30 * m("n_words")),
)

BASE = ("few_words", "repeated_windows")

#: Versioned policies: a document is kept where none of the policy's rules fails.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "repeated_lines", "word_length", "upper_case", "shouting"),
}
CURRENT = "v2"


def mask_of(names: tuple[str, ...]) -> int:
    order = {rule.name: bit for bit, rule in enumerate(RULES)}
    return sum(1 << order[name] for name in names)


def _left(text: Column, taken: str) -> Column:
    """Code points of ``text`` once everything that matches ``taken`` is removed."""
    return F.length(F.regexp_replace(text, taken, ""))


def _covered_words(windows: Column) -> Column:
    """Words inside windows that occur twice: ``windows`` holds (window, start), sorted."""
    def as_before(j: Column) -> Column:
        return F.get(windows, j)["window"] == F.get(windows, j - 1)["window"]

    def both(j: Column) -> Column:
        starts = F.array(F.get(windows, j)["start"], F.get(windows, j - 1)["start"])
        return F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))

    again = F.filter(F.sequence(F.lit(1), F.size(windows) - 1), as_before)
    return F.size(F.array_distinct(F.flatten(F.transform(again, both))))


def measured(frame: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """``frame`` with a struct column ``into`` of all MEASURES, each a long; a null text counts as empty.

    The steps are projections and not one expression: an array used twice by a later
    projection is computed once and by generated code. The measurements leave through a
    generator of one row, which no filter can be pushed below: a filter on them would
    otherwise be evaluated on the texts, all measurements once more for each rule in it.
    Texts whose window hashes all differ hold no repeat. For the others the windows
    themselves are sorted, so that a hash collision changes nothing.
    """
    taken = [*frame.columns, into]
    names = {}
    for stem in ("t", "w", "lines", "hashes", "windows"):
        names[stem] = free_name(f"_{stem}", taken)
        taken.append(names[stem])
    t, w, lines, hashes, windows = (F.col(f"`{name}`") for name in names.values())
    out = frame.withColumn(names["t"], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumns({
        names["w"]: F.filter(F.split(t, SEPARATORS), lambda x: x != ""),
        names["lines"]: F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    places = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(
        names["hashes"], F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def window(i: Column) -> Column:
        return F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("window"), i.cast("int").alias("start"))

    out = out.withColumn(
        names["windows"],
        F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(places, window))),
    )
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _left(t, r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(windows.isNull(), 0).otherwise(_covered_words(windows)),
        "n_lines": F.size(lines),
        "n_upper": _left(t, r"\P{Lu}+"),
        "n_shouts": F.length(t) - F.length(F.replace(t, F.lit("!"))),
    }
    found = F.struct(*[values[name].cast("bigint").alias(name) for name in MEASURES])
    return out.select(*[F.col(f"`{c}`") for c in frame.columns], F.inline(F.array(F.struct(found.alias(into)))))


def failures(measure: Callable[[str], Column]) -> Column:
    """Long with bit k set where rule k fails."""
    bits = F.lit(0).cast("bigint")
    for bit, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(measure), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, all measurements, ``failures``."""
    picked = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = measured(picked).select("doc_id", "m.*")
    return rows.withColumn("failures", failures(lambda name: F.col(name)))


def passes(policy: str = CURRENT, bits: Column | str = "failures") -> Column:
    """True where no rule of the policy fails."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("bigint")) == 0


def apply_policy(documents: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that the policy keeps."""
    name = free_name("m", documents.columns)
    bits = free_name("failures", [*documents.columns, name])
    rows = measured(documents, text, name)
    rows = rows.withColumn(bits, failures(lambda m: F.col(f"`{name}`")[m]))
    return rows.where(passes(policy, F.col(f"`{bits}`"))).drop(name, bits)


def ablations(ledger_rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: documents kept, failing the rule, failing it alone, and kept without it.

    The ledger is first combined to one row per distinct failure mask (at most 2 ** rules
    rows, however many documents), so all policies share one small aggregate.
    """
    masks = ledger_rows.groupBy("failures").agg(F.count("*").alias("n"))
    cells = [
        F.struct(F.lit(p).alias("policy"), F.lit(rule.name).alias("rule"),
                 F.lit(mask_of(POLICIES[p])).cast("bigint").alias("mask"), F.lit(1 << bit).cast("bigint").alias("bit"))
        for p in policies for bit, rule in enumerate(RULES) if rule.name in POLICIES[p]
    ]
    rows = masks.select("failures", "n", F.explode(F.array(*cells)).alias("c")).select("failures", "n", "c.*")
    seen = F.col("failures").bitwiseAND(F.col("mask"))
    counted = {
        "n_kept": seen == 0,
        "n_failed": seen.bitwiseAND(F.col("bit")) != 0,
        "n_failed_alone": seen == F.col("bit"),
        "n_kept_without": (seen == 0) | (seen == F.col("bit")),
    }
    return rows.groupBy("policy", "rule").agg(
        *[F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name) for name, test in counted.items()]
    )
