"""Personal data by candidate gradient boosting.

Base patterns (e-mail, IPv4 address, payment card with a valid Luhn sum, international
phone number) are always redacted. Beyond them, high-recall generators propose overlapping
spans: obfuscated and bare-host e-mails, dotted and dashed numbers, digit groups. Boosted regression trees score each proposal from its format and its
context, a threshold calibrated for its kind keeps a wanted precision, and of overlapping
accepted spans the best-scored one stays.

The trees are fitted on the proposals of all documents. Proposals that agree with a validated
base span are the positives, and so do base spans written another way in their own context;
those that a validator rejects and those around no base span are the negatives. Half of the
documents, by a hash of doc_id, calibrates the thresholds. Equal proposals are counted; a level
of a tree is grown from sums per node, feature and cut, which alone reach the driver, and the
sums are whole numbers, so the model is the same at any partitioning. Applying it needs no shuffle.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive;
texts of any length are scanned whole in linear time; repeated rows are treated alike; with
no usable examples nothing is added to the base; an empty table gives no rows; extra columns
are ignored by ``spans`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coocatlas.llm.tables import staged
from coocatlas.llm.words import slices

#: Order of kinds where spans start together.
KINDS = ("email", "ip", "card", "phone")
#: The precision asked of added spans.
PRECISION = 0.98
#: Held-out positives a kind needs for a threshold of its own.
LEAST_POSITIVES = 20
#: Cuts per feature at most, and the units in which gradients are summed.
CUTS = 32
UNIT = 1 << 24
#: Up to so many distinct binned examples, a few MB of counts, the driver sums itself; beyond, each level is a job. The sums are the same.
LOCAL_EXAMPLES = 100_000

# The base patterns, written so that each scans in linear time. A number is
# only tried where a digit run begins, which finds the same leftmost matches.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KEY_WORDS = ("mail", "contact", "phone", "tel", "call", "fax", "card", "visa", "credit", "ip", "host", "addr", "server", "mobile")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mails: from each @, back over its local part and on over its domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARACTERS:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            out.append((begin, done))
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    return out


def valid_ip(value: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in value.split("."))


def valid_card(value: str) -> bool:
    digits = value.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def valid_phone(value: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in value) <= 15


def base_spans(text: str) -> list[Span]:
    """Validated base spans by start, then kind."""
    found: list[Span] = [(a, b, "email") for a, b in emails(text)]
    for pattern, valid, kind in ((IP, valid_ip, "ip"), (CARD, valid_card, "card"), (PHONE, valid_phone, "phone")):
        found.extend((m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(m.group()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# High-recall generators of further spans, by kind.
PROPOSALS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+"
                         r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,24}+){1,4}", re.I)),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{2,24}+){1,4}", re.I)),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9.-])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}+(?:[ ]?\.[ ]?|\[\.\])[0-9]{1,3}+(?:[ ]?\.[ ]?|\[\.\])[0-9]{1,3}+(?:[ ]?\.[ ]?|\[\.\])[0-9]{1,3}+(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}+(?:[ .\-_/][0-9]{4,7}+){2,3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}+(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.+])(?:\(?[0-9]{2,5}\)?[ .\-/]){1,4}[0-9]{3,8}+(?![0-9.])")),
    ("phone", re.compile(r"(?<![0-9])(?:00|\+)[ ]?[0-9][ ().0-9/-]{6,24}[0-9](?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.])[0-9]{7,12}+(?![0-9.])")),
)
#: A cheap test that a text holds anything a generator could match.
LIKELY = re.compile(r"[0-9]{3}|@|[ (\[{]at[ )\]}]|[0-9A-Fa-f]:[0-9A-Fa-f]", re.I)

FEATURES = (
    "kind", "generator", "length", "digits", "digit_share", "separators", "groups", "longest_group", "letters", "dots",
    "plus", "parens", "luhn", "parts_below_256", "leading_zero", "left_word", "right_word", "left_digit", "right_digit",
    "left_symbol", "right_symbol", "key_word", "line_digits", "hex_letters", "distinct_digits",
)


def proposals(text: str) -> list[tuple[int, int, str, int]]:
    if not LIKELY.search(text):
        return []
    return [(m.start(), m.end(), kind, g) for g, (kind, pattern) in enumerate(PROPOSALS) for m in pattern.finditer(text)]


def describe(text: str, start: int, end: int, kind: str, generator: int) -> list[float]:
    """FEATURES of a proposal from its own characters and 24 on each side."""
    value, left, right = text[start:end], text[max(0, start - 24):start], text[end:end + 24]
    digits = [c for c in value if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", value)
    before, after = left[-1:], right[:1]
    return [
        KINDS.index(kind), generator, len(value), len(digits), len(digits) / len(value),
        sum(c in " .-/()_[]" for c in value), len(groups), max(map(len, groups), default=0),
        sum(c.isalpha() for c in value), value.count("."), value.startswith("+") or value.startswith("00"), value.count("("),
        luhn("".join(digits)) if digits else -1, all(int(g[-6:]) < 256 for g in groups), any(g[0] == "0" for g in groups),
        before.isalpha(), after.isalpha(), before.isdigit(), after.isdigit(),
        before in "#$%&=\"'_/\\:@" if before else 0, after in "#$%&=\"'_/\\:@" if after else 0,
        any(k in left.lower() for k in KEY_WORDS), sum(c.isdigit() for c in left + right),
        sum(c in "abcdefABCDEF" for c in value), len(set(digits)),
    ]


@dataclass
class Boosted:
    """Gradient-boosted regression trees on a logistic loss, with a calibrated threshold per kind."""

    prior: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            out += np.array([node[4] for node in tree])[_leaves(x, tree)]
        return out


def _leaves(x: np.ndarray, tree: list[tuple]) -> np.ndarray:
    """The node of a tree at which each row ends."""
    feature, cut, left, right, _ = (np.array(c) for c in zip(*tree, strict=True))
    node = np.zeros(len(x), np.int64)
    while (inner := feature[node] >= 0).any():
        at = np.flatnonzero(inner)
        here = node[at]
        node[at] = np.where(x[at, feature[here]] <= cut[here], left[here], right[here])
    return node


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, len(FEATURES))


def _sums(model: Boosted, tree: list[tuple], open_: list[int], known: np.ndarray | None = None):
    """Sums of gradients, weights and rows per open node, feature and bin, in whole UNITs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree), -1)
        place[open_] = np.arange(len(open_))
        sums = np.zeros((3, len(open_) * len(FEATURES) * CUTS), np.int64)
        for batch in batches:
            bins, n = _bins(batch), batch.column("n").to_numpy()
            p = 1 / (1 + np.exp(-(model.scores(bins) if known is None else known)))
            at = place[_leaves(bins, tree)]
            inside = at >= 0
            g = np.rint((batch.column("y").to_numpy() - p) * UNIT).astype(np.int64) * n
            h = np.rint((p * (1 - p) + 1e-6) * UNIT).astype(np.int64) * n
            slots = ((at[inside, None] * len(FEATURES) + np.arange(len(FEATURES))) * CUTS + bins[inside]).ravel()
            for total, values in zip(sums, (g, h, n), strict=True):
                np.add.at(total, slots, np.repeat(values[inside], len(FEATURES)))
        slot = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(total[slot]) for total in sums)], names=["slot", "g", "h", "n"])

    return run


def fit_trees(
    examples: DataFrame, cuts: list[np.ndarray], share: float, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: int = 5
) -> tuple[Boosted, Boosted]:
    """Newton boosting over all ``examples`` (bins, y, n): the model for bins, and the same for values.

    More than LOCAL_EXAMPLES distinct ones stay distributed, with one job for each level of each tree,
    from which at most one row per open node, feature and bin reaches the driver.
    """
    some = examples.limit(LOCAL_EXAMPLES + 1).toArrow()
    local = some.combine_chunks().to_batches() if len(some) <= LOCAL_EXAMPLES else None
    del some
    share = np.clip(share, 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    binned, model = Boosted(prior), Boosted(prior)
    bins = _bins(local[0]) if local else None
    known = np.full(len(bins), prior) if local else None

    def summed(tree: list[tuple], open_: list[int]) -> pa.Table:
        if local:
            return pa.Table.from_batches(list(_sums(binned, tree, open_, known)(iter(local))))
        parts = examples.mapInArrow(_sums(binned, tree, open_), "slot long, g long, h long, n long")
        return parts.groupBy("slot").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()

    for _ in range(rounds):
        tree: list[tuple[int, float, int, int, float]] = [(-1, 0.0, 0, 0, 0.0)]
        open_ = [0]
        for _ in range(depth):
            found = summed(tree, open_)
            sums = np.zeros((3, len(open_) * len(FEATURES) * CUTS))
            for total, column in zip(sums, "ghn", strict=True):
                total[found["slot"].to_numpy()] = found[column].to_numpy()
            sums = sums.reshape(3, len(open_), len(FEATURES), CUTS)
            sums[:2] /= UNIT
            grown = []
            for k, at in enumerate(open_):
                g, h, n = sums[:, k, 0].sum(axis=1)
                tree[at] = (-1, 0.0, 0, 0, float(rate * g / (h + 1)))
                if n < 2 * least:
                    continue
                gs, hs, ns = np.cumsum(sums[:, k], axis=2)
                gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g ** 2 / (h + 1)
                gain[(ns < least) | (n - ns < least)] = -1
                f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, cut] > 1e-4:
                    sides = ((gs[f, cut], hs[f, cut]), (g - gs[f, cut], h - hs[f, cut]))
                    tree[at] = (int(f), float(cut), len(tree), len(tree) + 1, 0.0)
                    grown.extend((len(tree), len(tree) + 1))
                    tree.extend((-1, 0.0, 0, 0, float(rate * a / (b + 1))) for a, b in sides)
            open_ = grown
            if not open_:
                break
        binned.trees.append(tree)
        if local:
            known += np.array([node[4] for node in tree])[_leaves(bins, tree)]
        model.trees.append([(f, float(cuts[f][int(cut)]) if f >= 0 else 0.0, *rest) for f, cut, *rest in tree])
    return binned, model


def calibrate(scored: DataFrame, precision: float) -> dict[int, float]:
    """Per kind of ``scored`` (kind, score, y, n), the lowest score from which on the share of positives is ``precision``.

    A kind with too few examples to calibrate on takes the threshold of all kinds together (infinite if none).
    """
    both = scored.withColumn("kind", F.explode(F.array("kind", F.lit(-1)))).withColumn("good", F.col("n") * F.col("y"))
    ties = both.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    best_first = W.partitionBy("kind").orderBy(F.desc("score"))
    share = F.sum("good").over(best_first) / F.sum("n").over(best_first)
    rows = ties.withColumn("share", share).groupBy("kind").agg(
        F.min(F.when(F.col("share") >= precision, F.col("score"))).alias("least"), F.sum("good").alias("good")).collect()
    least = {row["kind"]: np.inf if row["least"] is None else float(row["least"]) for row in rows}
    enough = {row["kind"] for row in rows if row["good"] >= LEAST_POSITIVES}
    return {code: least[code if code in enough else -1] for code in range(len(KINDS))}


class Covered:
    """What a set of spans covers, as disjoint runs by start."""

    def __init__(self, spans: Iterable[tuple]):
        self.starts, self.ends = [], []
        for span in sorted(spans, key=lambda s: s[0]):
            if self.ends and span[0] < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], span[1])
            else:
                self.starts.append(span[0])
                self.ends.append(span[1])

    def meets(self, span: tuple) -> bool:
        """Whether the span shares a character with any of them."""
        at = bisect_left(self.starts, span[1]) - 1
        return at >= 0 and span[0] < self.ends[at]

    def add(self, span: tuple) -> None:
        """Take in a span that meets none."""
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[1])


def _chains(spans: list[tuple]) -> Iterator[list[int]]:
    """Places of the spans, in groups such that spans of different groups never meet."""
    order, end, chain = sorted(range(len(spans)), key=lambda k: spans[k][0]), -1, []
    for k in order:
        if chain and spans[k][0] >= end:
            yield chain
            chain = []
        chain.append(k)
        end = max(end, spans[k][1])
    if chain:
        yield chain


def rewrites(value: str, kind: str) -> list[str]:
    """Other common ways to write a validated span."""
    if kind == "email":
        return [value.replace("@", " at ").replace(".", " dot "), value.replace("@", "(at)"), value.replace("@", "[at]").replace(".", "[dot]")]
    if kind == "ip":
        return [value.replace(".", "[.]"), value.replace(".", " . ")]
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        return [digits, ".".join(digits[k:k + 4] for k in range(0, len(digits), 4))]
    return ["00" + value[1:], "+" + digits[:2] + "/" + digits[2:]]


def examples(text: str) -> list[tuple[list[float], int]]:
    """Labelled proposals of a text and of the text with each base span written another way.

    1: a proposal with the kind and bounds of a base or rewritten span. 0: one that meets no
    such span of its kind. Others, which cover part of one, are left out.
    """
    base = base_spans(text)
    out = []

    def label(source: str, known: list[Span]) -> None:
        covered = {kind: Covered(s for s in known if s[2] == kind) for kind in KINDS}
        bounds = set(known)
        for start, end, kind, generator in proposals(source):
            exact = (start, end, kind) in bounds
            if exact or not covered[kind].meets((start, end)):
                out.append((describe(source, start, end, kind, generator), int(exact)))

    label(text, base)
    for start, end, kind in base:
        left, right = text[max(0, start - 40):start], text[end:end + 40]
        for new in rewrites(text[start:end], kind):
            label(left + new + right, [*base_spans(left + new + right), (len(left), len(left) + len(new), kind)])
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows, labels, halves = [], [], []
        for text, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True):
            for x, y in examples(text or ""):
                rows.append([float(v) for v in x])
                labels.append(y)
                halves.append(half)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32()), pa.array(halves, pa.int32())],
            names=["x", "y", "half"])


def _binned(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            # a value is at most cut k where its bin is at most k
            bins = np.stack([np.searchsorted(options, x[:, f]) for f, options in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.tobytes() for row in bins], pa.binary()), pa.array(x[:, FEATURES.index("kind")].astype(np.int32)),
                 *(batch.column(c) for c in ("y", "half", "n"))], names=["bins", "kind", "y", "half", "n"])

    return run


def _scored(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), pa.array(model.scores(_bins(batch))), batch.column("y"), batch.column("n")],
                names=["kind", "score", "y", "n"])

    return run


def fit(documents: DataFrame, precision: float = PRECISION) -> Boosted:
    """Fit on the proposals of all ``documents`` (doc_id, text)."""
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    made = documents.select("text", half).mapInArrow(_examples, "x array<double>, y int, half int")
    counted = staged(made.groupBy("x", "y", "half").agg(F.count("*").alias("n")), "pii-examples")
    totals = {(r["half"], r["y"]): r["n"] for r in counted.groupBy("half", "y").agg(F.sum("n").alias("n")).collect()}
    wrong, right = totals.get((0, 0), 0), totals.get((0, 1), 0)
    if not (wrong and right and (totals.get((1, 0)) or totals.get((1, 1)))):
        return Boosted()
    # exact quantiles: a feature has as many values as a span of bounded length can give it
    shares = np.linspace(0, 1, CUTS + 1)[1:-1].tolist()
    quantiles = counted.where("half = 0").agg(
        *(F.percentile(F.col("x")[f], shares, F.col("n")).alias(f"q{f}") for f in range(len(FEATURES)))).first()
    cuts = [np.unique(values) for values in quantiles]
    binned = staged(
        counted.mapInArrow(_binned(cuts), "bins binary, kind int, y int, half int, n long")
        .groupBy("bins", "kind", "y", "half").agg(F.sum("n").alias("n")), "pii-bins")
    inner, model = fit_trees(binned.where("half = 0").select("bins", "y", "n"), cuts, right / (right + wrong))
    held = binned.where("half = 1").select("bins", "kind", "y", "n")
    found = calibrate(held.mapInArrow(_scored(inner), "kind int, score double, y int, n long"), precision)
    model.thresholds = {KINDS[code]: max(threshold, 0.0) for code, threshold in found.items()}
    return model


def find(text: str | None, model: Boosted) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and the accepted proposals that meet neither it nor a better one."""
    if not text:
        return [], []
    base = base_spans(text)
    kinds = {kind for kind, threshold in model.thresholds.items() if np.isfinite(threshold)}
    if not kinds:
        return base, base
    covered = Covered(base)
    proposed = [p for p in proposals(text) if p[2] in kinds and not covered.meets(p)]
    taken = list(base)
    if proposed:
        scores = model.scores(np.array([describe(text, *p) for p in proposed], float))
        passed = [k for k, p in enumerate(proposed) if scores[k] >= model.thresholds[p[2]]]
        for chain in _chains([proposed[k] for k in passed]):
            better = Covered(())
            for k in sorted((passed[c] for c in chain), key=lambda k: (-scores[k], proposed[k])):
                if not better.meets(proposed[k]):
                    better.add(proposed[k])
                    taken.append(proposed[k][:3])
    return base, sorted(taken, key=lambda s: (s[0], KINDS.index(s[2])))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.ArrayType(SPAN)


def _array(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in row] for row in rows],
                    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


def _spans(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [find(text, model) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _array([b for b, _ in found]), _array([s for _, s in found])],
                names=["doc_id", "base", "spans"])

    return run


def spans(documents: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every document."""
    model = model or fit(documents)
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    return documents.select("doc_id", "text").mapInArrow(_spans(model), schema)


def masked(text: str | None, model: Boosted) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, done = [], 0
    for start, end, kind in find(text, model)[1]:
        if start >= done:
            out.extend((text[done:start], f"[{kind.upper()}]"))
        done = max(done, end)
    return "".join([*out, text[done:]])


def _redact(model: Boosted, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            at = batch.schema.get_field_index(column)
            texts = pa.array([masked(t, model) for t in batch.column(column).to_pylist()], pa.string())
            arrays = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return run


def redact(documents: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``documents`` with the same columns and their texts masked."""
    model = model or fit(documents.select("doc_id", "text"))
    return documents.mapInArrow(_redact(model, "text"), documents.schema)
