"""Prefix trie of conversations that are rebuilt from another one's head and their own suffix.

Each turn is hashed once. A prefix of turns t_1 .. t_n has as fingerprint the sum of
h(t_i) * B^i modulo a prime, in three lanes. These compose: a head of one conversation and a
suffix of another one give the fingerprint of the rebuilt prefix out of the two stored
running sums and a power of B, so no rebuilt text is ever made. A node is a group of equal
(depth, fingerprint). In every group the parent's fingerprint and the digest of the referenced
last turn must be the same for all members; by induction over the depth this makes equal
fingerprints equal sequences, and a group in which they differ makes the build start over
with other bases.

Subtrees need no walk: a conversation *owns* the nodes of which it is the smallest member, a
run of depths down to its end. What a conversation adds over all its owned nodes counts for
every node it passes through; only its own nodes have to leave out those above them.

Turns are range-sorted, numbered and summed in chunks, joins on a conversation or a parent
are cut into chunks of ordinal numbers, and members that end in one node are joined to text in
chunks before one stream of them is hashed. So neither a conversation with most turns nor a
node with most members meets in one task; only the digest of one node's ends is sequential
by nature, over bounded pieces of text.

Defined results: turns are in order of ``turn``, nulls first, equal ones by the digest of role
and text; a null role or text is empty; rows without ``conv_id`` belong to no conversation and
are left out; repeated rows are repeated turns; an empty table gives no node; extra columns
are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.llm.ordering import CHUNK, numbered, running
from coocatlas.llm.tables import narrow, staged

PRIME = (1 << 31) - 1
LANES = range(3)
KEY = ["depth", "f0", "f1", "f2"]
#: Times a build may start over; two different prefixes of 10^12 share a fingerprint once in about 10^4 builds.
ATTEMPTS = 4


class NotVerified(Exception):
    """Different prefixes had the same fingerprint under every choice of bases."""


def _bases(attempt: int) -> list[int]:
    draw = random.Random(0x7413 + attempt)
    return [draw.randrange(1 << 20, PRIME) for _ in LANES]


def _powers(bases: list[int], exponent: Column) -> Column:
    """Struct p0 .. p2 of each base to a power, which may be negative."""
    @F.pandas_udf("p0 long, p1 long, p2 long")
    def power(exponents: pd.Series) -> pd.DataFrame:
        kinds = {e: [pow(b, e % (PRIME - 1), PRIME) for b in bases] for e in exponents.unique().tolist()}
        return pd.DataFrame([kinds[e] for e in exponents.tolist()], columns=["p0", "p1", "p2"])

    return power(exponent)


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, chars, c0, c1, t0 .. t2): turns in order, by digest and not by text."""
    kept = narrow(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256)
    turns = staged(kept.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.length(text).cast("bigint").alias("chars"),
        digest.alias("digest")), "trie-turns")
    rows = numbered(turns, ["conv_id"], "turn", "digest")
    return staged(rows.select(
        "conv_id", "nth", "chars", _number(F.col("digest"), 1, 15).alias("c0"), _number(F.col("digest"), 16, 15).alias("c1"),
        *[_number(F.col("digest"), 31 + 7 * k, 7).alias(f"t{k}") for k in LANES]), "trie-numbered")


def _chunks(last: Column) -> Column:
    """Numbers of all chunks up to the one that holds ``last``."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(last, F.lit(0)) / CHUNK)))


def _rebuilt(turns: DataFrame, base: Column, head: Column, bases: list[int]) -> tuple[DataFrame, DataFrame]:
    """Conversations, and one row per rebuilt prefix: its fingerprint, its parent's, and its last turn by reference."""
    raised = turns.withColumn("p", _powers(bases, F.col("nth")))
    terms = raised.withColumns({f"m{k}": F.col(f"t{k}") * F.col(f"p.p{k}") % PRIME for k in LANES}).drop("p")
    summed = running(staged(terms, "trie-terms"), "conv_id", "nth", {f"s{k}": F.col(f"m{k}") for k in LANES})
    own = staged(summed.select(
        "conv_id", "nth", "chars", "c0", "c1", *[F.col(f"m{k}") for k in LANES],
        *[(F.col(f"s{k}") % PRIME).alias(f"s{k}") for k in LANES]), "trie-own")

    counts = staged(own.groupBy("conv_id").agg(F.count("*").alias("n_own")).select(
        "conv_id", "n_own", base.alias("base"), F.greatest(head, F.lit(0)).cast("bigint").alias("head")), "trie-counts")
    longest = counts.agg(F.max("head")).head()[0] or 0
    early = own.where(F.col("nth") < longest)
    found = counts.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = counts.join(found, "base", "left").withColumn("shared", F.least("head", F.coalesce("n_base", F.lit(0))))
    sums = [F.col(f"s{k}").alias(f"d{k}") for k in LANES]
    convs = convs.withColumn("at", F.col("shared") - 1).join(
        early.select(F.col("conv_id").alias("base"), F.col("nth").alias("at"), *sums), ["base", "at"], "left")
    sums = [F.col(f"s{k}").alias(f"o{k}") for k in LANES]
    convs = convs.withColumn("at", F.col("head") - 1).join(
        early.select("conv_id", F.col("nth").alias("at"), *sums), ["conv_id", "at"], "left")
    convs = convs.withColumn("length", F.col("shared") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0)))
    convs = convs.withColumn("shift", _powers(bases, F.col("shared") - F.col("head")))
    lanes = [F.coalesce(f"{side}{k}", F.lit(0)).cast("bigint").alias(f"{side}{k}") for side in "do" for k in LANES]
    convs = staged(convs.select("conv_id", "base", "head", "shared", "n_own", "length", "shift.*", *lanes), "trie-convs")

    heads = early.withColumnRenamed("conv_id", "base").join(
        convs.select("conv_id", "base", "shared", "length"), "base").where("nth < shared")
    heads = heads.select(
        "conv_id", (F.col("nth") + 1).alias("depth"), "length", "chars", "c0", "c1", F.col("base").alias("ref_conv"),
        F.col("nth").alias("ref_turn"), *[F.col(f"s{k}").alias(f"f{k}") for k in LANES], *[F.col(f"m{k}").alias(f"e{k}") for k in LANES])
    # a chunk of a conversation's turns meets its own copy of the conversation's sums
    spread = convs.select("conv_id", "head", "shared", "length", "p0", "p1", "p2", *[f"{s}{k}" for s in "do" for k in LANES],
                          _chunks(F.col("n_own") - 1).alias("chunk")).where("n_own > head")
    tails = own.withColumn("chunk", F.floor(F.col("nth") / CHUNK)).join(spread, ["conv_id", "chunk"]).where("nth >= head")

    def moved(k: int, value: Column) -> Column:
        return F.pmod(value, F.lit(PRIME)) * F.col(f"p{k}") % PRIME

    tails = tails.select(
        "conv_id", (F.col("shared") + F.col("nth") - F.col("head") + 1).alias("depth"), "length", "chars", "c0", "c1",
        F.col("conv_id").alias("ref_conv"), F.col("nth").alias("ref_turn"),
        *[((F.col(f"d{k}") + moved(k, F.col(f"s{k}") - F.col(f"o{k}"))) % PRIME).alias(f"f{k}") for k in LANES],
        *[moved(k, F.col(f"m{k}")).alias(f"e{k}") for k in LANES])
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(None).cast("bigint")
    roots = convs.select(
        "conv_id", zero.alias("depth"), "length", *[zero.alias(c) for c in ("chars", "c0", "c1")],
        nothing.alias("ref_conv"), nothing.alias("ref_turn"), *[zero.alias(f"{s}{k}") for s in "fe" for k in LANES])
    rows = heads.unionByName(tails).unionByName(roots)
    rows = rows.withColumns({f"e{k}": F.pmod(F.col(f"f{k}") - F.col(f"e{k}"), F.lit(PRIME)) for k in LANES})
    return convs, staged(rows, "trie-prefixes")


_SAME = ("e0", "e1", "e2", "c0", "c1", "chars")


def _nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """One row per group of equal fingerprints, and whether all groups hold equal sequences."""
    same = [column for c in _SAME for column in (F.min(c).alias(c), F.max(c).alias(f"{c}_max"))]
    nodes = staged(prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same,
        F.min_by("ref_conv", "conv_id").alias("ref_conv"), F.min_by("ref_turn", "conv_id").alias("ref_turn")), "trie-nodes")
    apart = nodes.where(" or ".join(f"{c} <> {c}_max" for c in _SAME))
    return nodes.drop(*[f"{c}_max" for c in _SAME]), apart.isEmpty()


def _ends(prefixes: DataFrame) -> DataFrame:
    """Digest of the members that end in each node, where there are any."""
    last = numbered(prefixes.where("depth = length").select(*KEY, "conv_id"), KEY, "conv_id")
    pieces = last.groupBy(*KEY, F.floor(F.col("nth") / CHUNK).alias("piece")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("conv_id")).cast("array<string>").alias("ids"))
    pieces = staged(pieces.select(*KEY, "piece", "n", F.array_join("ids", ",").alias("ids")), "trie-ends")
    # a first piece that is not full is the only one
    whole = (F.col("piece") == 0) & (F.col("n") < CHUNK)
    single = pieces.where(whole).select(*KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k], pa.int64()) for k in key], pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *at, _, ids in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if at != key:
                    if key is not None:
                        yield done()
                    key, state = at, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield done()

    long = pieces.where(~whole).select(*KEY, "piece", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return single.unionByName(long.mapInArrow(hashed, single.schema))


def build(conversations: DataFrame, base: Column, head: Column) -> DataFrame:
    """All nodes of the trie over conversations rebuilt from ``head`` turns of conversation ``base`` and their own rest.

    Both are expressions of ``conv_id``. A node is named by its smallest member and its depth;
    ``ref_conv`` and ``ref_turn`` (from 0) say where its last turn is stored.
    """
    turns = turn_rows(conversations)
    for attempt in range(ATTEMPTS):
        convs, prefixes = _rebuilt(turns, base, head, _bases(attempt))
        nodes, verified = _nodes(prefixes)
        if verified:
            break
    else:
        raise NotVerified

    # children meet their parent in chunks of their number under it
    up = ["up", "e0", "e1", "e2"]
    kids = numbered(
        nodes.where("depth > 0").withColumn("up", F.col("depth") - 1).select(*KEY, *up), up, *KEY[1:])
    kids = staged(kids.withColumn("chunk", F.floor(F.col("nth") / CHUNK)), "trie-children")
    counts = kids.groupBy(*[F.col(u).alias(k) for u, k in zip(up, KEY, strict=True)]).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(counts, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    above = running(staged(nodes, "trie-counted"), "conv_id", "depth", {"down_to": F.col("saved")})
    nodes = staged(above, "trie-owned")
    parents = nodes.where("n_children > 0").select(
        *[F.col(k).alias(u) for u, k in zip(up, KEY, strict=True)], F.col("conv_id").alias("parent_conv_id"),
        _chunks(F.col("n_children") - 1).alias("chunk"))
    parents = kids.join(parents, [*up, "chunk"]).select(*KEY, "parent_conv_id")

    # what each conversation owns, spread over the chunks of its depths
    owned = nodes.groupBy("conv_id").agg(
        F.sum("saved").alias("total"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    owned = owned.join(convs.select("conv_id", "length"), "conv_id").select(
        "conv_id", "total", "leaf", _chunks(F.col("length")).alias("chunk"))
    passing = prefixes.select(*KEY, "conv_id", F.floor(F.col("depth") / CHUNK).alias("chunk")).join(owned, ["conv_id", "chunk"])
    subtree = passing.groupBy(*KEY).agg(F.sum("total").alias("through"), F.sum("leaf").alias("n_leaves"))

    out = nodes.join(subtree, KEY).join(parents, KEY, "left").join(_ends(prefixes), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("through") - F.col("down_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "ref_conv", "ref_turn")
