"""Name search by regular expressions, for whole sets of requests at a time.

A match of most patterns must contain certain plain letters. They are read off the pattern,
and the rarest three-letter piece among them is looked up in an index of the pieces of all
names; only names that hold it are tested in full. The index is a table that is written once.
Letters are folded as the expression engine folds them without Unicode flags: A-Z only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3
#: Tasks that share the names for requests without any required piece.
SPREAD = 64
#: Quoted parts, flags other than i, and classes that begin with a bracket are not read at all.
UNREAD = re.compile(r"\\Q|\(\?[i-]*[a-hj-zA-Z]|\[\^?\]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def required_runs(pattern: str) -> list[str]:
    """Runs of ASCII characters, A-Z lower-cased, that every match of the pattern holds.

    Where in doubt a run ends: alternatives, groups, classes and optional characters add
    nothing, so the runs are always necessary, if not always all that are.
    """
    if UNREAD.search(pattern) or _splits(pattern):
        return []
    runs, run, at = [], "", 0

    def cut() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while at < len(pattern):
        c, step = pattern[at], 1
        if c == "\\":
            step = 2
            after = pattern[at + 1:at + 2]
            if after and not after.isalnum() and after.isascii():
                run += after
            else:
                cut()
                if after in ("p", "P", "x", "u", "k", "N", "c", "0") or after.isdigit():
                    return runs
        elif c == "[":
            cut()
            step = _class_end(pattern, at) - at
        elif c == "(":
            cut()
            step = _group_end(pattern, at) - at
        elif c in "*?{":
            run = run[:-1]
            cut()
            step = pattern.find("}", at) - at + 1 if c == "{" and "}" in pattern[at:] else 1
        elif c == "+" or c in "^$." or not c.isascii():
            cut()
        else:
            run += c.lower()
        at += max(step, 1)
    cut()
    return runs


def _class_end(pattern: str, at: int) -> int:
    """Place after the class that opens at ``at``; classes may nest."""
    depth, first = 0, True
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            depth, first = depth + 1, True
            if pattern[at + 1:at + 2] == "^":
                at += 1
            at += 1
            continue
        elif c == "]" and not first:
            depth -= 1
            if not depth:
                return at + 1
        first = False
        at += 1
    return at


def _group_end(pattern: str, at: int) -> int:
    """Place after the group that opens at ``at``."""
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = _class_end(pattern, at)
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1
    return at


def _splits(pattern: str) -> bool:
    """Whether the pattern has alternatives outside all groups and classes."""
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            return True
        at = _group_end(pattern, at) if c == "(" else _class_end(pattern, at) if c == "[" else at + (2 if c == "\\" else 1)
    return False


def folded(name: Column) -> Column:
    return F.translate(name, _UPPER, _LOWER)


def _pieces(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def name_pieces(names: DataFrame, key: str = "track_rowid", name: str = "track_name") -> DataFrame:
    """(piece, key): every distinct three-letter piece of every name."""
    return names.select(key, folded(F.col(name)).alias("_name")).select(
        F.explode(_pieces(F.col("_name"), PIECE)).alias("piece"), key)


def piece_counts(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("piece").agg(F.count("*").alias("n"))


def _asked_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [
            (request, run[i:i + PIECE])
            for request, pattern in zip(batch["request_id"], batch["query"], strict=True)
            for run in required_runs(pattern or "") for i in range(len(run) - PIECE + 1)
        ]
        yield pd.DataFrame(out, columns=["request_id", "piece"]).astype({"request_id": batch["request_id"].dtype, "piece": object})


def pattern_matches(
    requests: DataFrame, names: DataFrame, pieces: DataFrame | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """(request_id, names' columns) where the track name matches ``query`` and, if asked, the artist name ``artist``.

    ``requests`` has request_id (unique), query and artist, both regular expressions without
    regard to case. A null query, like a null name, matches nothing. ``pieces`` and ``counts``
    are the written index of the names; they are made from ``names`` if absent. A piece that no
    name holds answers its request by itself. Requests without a required piece are tested on
    all names, in SPREAD parts.
    """
    pieces = name_pieces(names) if pieces is None else pieces
    counts = piece_counts(pieces) if counts is None else counts
    asked = requests.where("query is not null").select("request_id", "query", "artist")
    kind = asked.schema["request_id"].dataType.simpleString()
    wanted = asked.select("request_id", "query").mapInPandas(_asked_pieces, f"request_id {kind}, piece string").distinct()
    rarest = wanted.join(counts, "piece", "left").groupBy("request_id").agg(
        F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
    placed = asked.join(rarest, "request_id", "left")
    narrowed = placed.where("piece is not null").join(pieces, "piece").join(names, "track_rowid").drop("piece")
    part = F.pmod(F.xxhash64("track_rowid"), F.lit(SPREAD))
    spread = placed.where("piece is null").drop("piece").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    whole = spread.join(names.withColumn("_part", part), "_part").drop("_part")

    def matches(text: Column, pattern: Column) -> Column:
        return F.coalesce(F.rlike(text, F.concat(F.lit("(?i)"), pattern)), F.lit(False))

    found = narrowed.unionByName(whole)
    by_artist = F.col("artist").isNull() | matches(F.col("artist_name"), F.col("artist"))
    return found.where(matches(F.col("track_name"), F.col("query")) & by_artist).select("request_id", *names.columns)
