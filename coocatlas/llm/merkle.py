"""Merkle manifest of a table: one hash tree per group, one tree over the groups' roots.

Rows become leaves in one native pass over the texts; from then on only digests move.
Leaves are numbered inside their group and cut into superblocks of 2 ** BITS. Going up,
each superblock is reduced to one node, and the nodes of the superblocks are again cut into
superblocks, so a tree of n leaves takes log(n) / BITS steps and no task holds more than one
superblock. Going down, the nodes of a superblock are cogrouped with the outer nodes on its
way to the root: each group then finishes its own levels, joins its proofs to the outer ones
and folds every presented leaf up to the root.

Defined results: a null field is ``-``; a null group is a group of its own and comes first;
leaves ascend by key, nulls first, equal keys by their digest, so repeated rows are repeated
leaves; a lone leaf is its group's root and a lone group's root is the root; an empty table
gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.llm.ordering import numbered
from coocatlas.llm.tables import narrow, staged

#: Leaves of a superblock, as a power of two.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """Length-prefixed text of a value, so that no two rows of fields read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(nodes: pd.DataFrame, bits: int) -> list[list[str]]:
    """The levels of one superblock, its own nodes first, its single top last.

    Numbers have no gaps, so the first superblock is short only where it is the only one, and
    is reduced until one node is left; any other one takes its ``bits`` levels, short or not.
    """
    levels, only = [nodes["digest"].tolist()], int(nodes["idx"].iloc[0]) < 1 << bits
    while len(levels[-1]) > 1 or (not only and len(levels) <= bits):
        below = levels[-1]
        levels.append([_hash("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def _steps(levels: list[list[str]], place: int) -> list[str]:
    """Per level below the top: the sibling, marked ``<`` if it is the left one, or nothing."""
    out = []
    for nodes in levels[:-1]:
        other = place ^ 1
        out.append(("<" if place & 1 else ">") + nodes[other] if other < len(nodes) else "")
        place >>= 1
    return out


def _fold(digest: str, steps: list[str]) -> str:
    for step in steps:
        digest = _hash(step[1:] + digest if step[:1] == "<" else digest + step[1:])
    return digest


def _top(nodes: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The one node a superblock is reduced to; none where the superblock is a root and nothing else."""
    nodes = nodes.sort_values("idx")
    block = int(nodes["idx"].iloc[0]) >> bits
    top = pd.DataFrame({
        "seq": [nodes["seq"].iloc[0]], "idx": [block], "digest": [_levels(nodes, bits)[-1][0]], "payload": None, "presented": None})
    return top if block or len(nodes) > 1 else top[:0]


def _descend(nodes: pd.DataFrame, above: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Steps of each node of one superblock: its own levels, then what the superblock was handed."""
    nodes = nodes.sort_values("idx")
    levels, outer = _levels(nodes, bits), list(above["steps"].iloc[0])
    return pd.DataFrame({
        "seq": nodes["seq"], "idx": nodes["idx"], "payload": nodes["payload"],
        "steps": [_steps(levels, place) + outer for place in range(len(nodes))],
        "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})


def _prove(nodes: pd.DataFrame, above: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The same for leaves, with the proof's digest and the root each presented leaf folds to."""
    nodes = nodes.sort_values("idx")
    found = _descend(nodes, above, bits)
    proofs = [_hash("".join(step[1:] for step in steps)) for steps in found["steps"]]
    shown = [p or d for p, d in zip(nodes["presented"], nodes["digest"], strict=True)]
    folded = [_fold(digest, steps) for digest, steps in zip(shown, found["steps"], strict=True)]
    return pd.DataFrame({
        "payload": nodes["payload"], "leaf": nodes["digest"], "subroot": found["subroot"], "root": found["root"],
        "proof_sha256": proofs, "folded_root": folded})


_NODE = "seq string, idx long, digest string, payload string, presented string"
_HANDED = "seq string, idx long, payload string, steps array<string>, subroot string, root string"
_PROVED = "payload string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


@dataclass
class Level:
    """Nodes of one level, and the roots: the nodes that are their sequence's only one."""

    nodes: DataFrame
    roots: DataFrame

    @staticmethod
    def of(nodes: DataFrame) -> tuple[Level, int]:
        """The level, and the nodes of its longest sequence."""
        ends = staged(nodes.groupBy("seq").agg(F.max("idx").alias("last"), F.max("digest").alias("digest")), "merkle-ends")
        last = ends.agg(F.max("last")).head()[0]
        return Level(nodes, ends.where("last = 0").select("seq", "digest")), 0 if last is None else last + 1


def _climb(nodes: DataFrame, bits: int) -> tuple[list[Level], DataFrame]:
    """Every ``bits``-th level, lowest first, and one root per sequence."""
    def top(rows: pd.DataFrame) -> pd.DataFrame:
        return _top(rows, bits)

    level, most = Level.of(nodes)
    levels = [level]
    while most > 1:
        blocks = levels[-1].nodes.groupBy("seq", F.shiftright("idx", bits))
        level, most = Level.of(staged(blocks.applyInPandas(top, _NODE), "merkle-level"))
        levels.append(level)
    return levels, reduce(DataFrame.unionByName, [level.roots for level in levels])


def _above(level: Level, handed: DataFrame, upper: DataFrame | None) -> DataFrame:
    """What the superblocks of ``level`` are handed: by the level above, or where a tree ends, from outside."""
    ends = handed.join(level.roots.select("seq"), "seq")
    rows = ends.select("seq", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
    if upper is not None:
        rows = rows.unionByName(upper.select("seq", F.col("idx").alias("block"), "steps", "subroot", "root"))
    return rows


def _hand_down(levels: list[Level], handed: DataFrame, bits: int) -> DataFrame:
    """What the superblocks of the lowest level are handed."""
    upper = None
    for level in reversed(levels[1:]):
        upper = _exchange(level, _above(level, handed, upper), _descend, _HANDED, bits)
    return _above(levels[0], handed, upper)


def _exchange(level: Level, above: DataFrame, finish: Callable, schema: str, bits: int) -> DataFrame:
    """Nodes and their required outer nodes meet by superblock."""
    def together(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return finish(nodes, outer, bits)

    # new names: both sides come from the same rows, and a cogroup of equal columns is ambiguous
    outer = above.select(
        F.col("seq").alias("of"), F.col("block").alias("part"), *[F.col(c).alias(c) for c in ("steps", "subroot", "root")])
    return level.nodes.groupBy("seq", F.shiftright("idx", bits)).cogroup(outer.groupBy("of", "part")).applyInPandas(together, schema)


def manifest(
    documents: DataFrame, presented: dict[str, Column] | None = None, where: Column | None = None,
    key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, bits: int = BITS,
) -> DataFrame:
    """One row per document: key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Where ``where`` is true, the leaf that is folded is made with the values of ``presented``
    in place of the stored ones: an audit of rows that may have been tampered with.
    """
    kept = narrow(documents, *dict.fromkeys([key, group, *fields]))
    stored = [F.col(f"`{f}`") for f in fields]
    shown = [(presented or {}).get(f, F.col(f"`{f}`")) for f in fields]
    seq = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")))
    leaves = staged(kept.select(
        seq.alias("seq"), F.col(f"`{key}`").alias("order"), F.col(f"`{key}`").cast("string").alias("payload"),
        leaf(stored).alias("digest"),
        (F.lit(None) if where is None else F.when(where, leaf(shown))).cast("string").alias("presented"),
    ), "merkle-leaves")
    levels, subroots = _climb(numbered(leaves, ["seq"], "order", "digest", name="idx"), bits)
    groups = subroots.select(
        F.lit("").alias("seq"), F.col("seq").alias("payload"), "digest", F.lit(None).cast("string").alias("presented"))
    group_levels, root = _climb(numbered(groups, ["seq"], "payload", name="idx"), bits)
    start = root.select(
        "seq", F.array().cast("array<string>").alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    placed = _exchange(group_levels[0], _hand_down(group_levels, start, bits), _descend, _HANDED, bits)
    handed = staged(
        placed.select(F.col("payload").alias("seq"), "steps", "root").join(
            subroots.select("seq", F.col("digest").alias("subroot")), "seq"), "merkle-groups")
    proved = _exchange(levels[0], _hand_down(levels, handed, bits), _prove, _PROVED, bits)
    return proved.select(
        F.col("payload").cast(kept.schema[key].dataType).alias(key), "leaf", "subroot", "root", "proof_sha256",
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
