"""All guarantees of the serving tables from one scan of each table and one combining aggregate.

Every row of every table states facts about keys: a key occurs in this column of this table,
or a name is blank. A fact is (space, key, bit): the space is the entity (or constraint) the
key belongs to, the bit the column it was seen in. One aggregate per key joins the bits, so
that every inclusion between two columns is a test of two bits, and a second one, of one row
per task, counts the keys for which a test fails. Tasks combine their facts before the
shuffle, so a key that a third of all rows refer to is one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.operators.quality import NAME_COLUMNS
from coocatlas.schema import ALBUM, ARTIST, BY_NAME, ENTITIES, LABEL, Entity


@dataclass(frozen=True)
class Check:
    """A named test that must hold for all keys of a space; ``fails`` reads a key's joined facts."""

    name: str
    space: str
    fails: Column
    acceptable: bool = False


#: Columns a key may be seen in; the place in the list is the bit.
SEEN = (
    "own", "canonical", "searchable", "embedding", "parent_link", "child_link",
    *(f"of_{entity.table}" for entity in ENTITIES),
)
_BIT = {name: place for place, name in enumerate(SEEN)}


def _fact(space: str, number: Column | None = None, seen: str | None = None, word: Column | None = None,
          link: int | None = None, nrepr: Column | None = None, when: Column | None = None) -> Column:
    def or_null(value, kind: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    fact = F.struct(
        F.lit(space).alias("space"), or_null(number, "bigint").alias("number"), or_null(word, "string").alias("word"),
        or_null(None if seen is None else _BIT[seen], "int").alias("bit"), or_null(link, "int").alias("link"),
        or_null(nrepr, "int").alias("nrepr"))
    return fact if when is None else F.when(when, fact)


def _entity_facts(e: Entity) -> list[Column]:
    counted = F.col("nrepr") if e.repr_table else None
    facts = [
        _fact(e.name, F.col(e.key), "own", nrepr=counted),
        _fact(e.name, F.col(e.canonical_key), "canonical"),
        _fact(e.name, F.col(e.key), "searchable", when=F.col("searchable")),
        *[_fact(p, F.col(BY_NAME[p].key), f"of_{e.table}") for p in e.parents],
        *[_fact(f"blank {e.table}.{c}", when=F.col(c) == "") for c, owner, _ in NAME_COLUMNS if owner == e],
    ]
    return facts + ([_fact("label text", word=F.col("label"))] if e == LABEL else [])


def _link_facts(e: Entity) -> list[Column]:
    child = BY_NAME[e.repr_child]
    return [
        _fact(e.name, F.col(e.key), "parent_link", link=1),
        _fact(child.name, F.col(child.key), "child_link"),
        _fact(f"key {e.repr_table}", F.col(e.key), word=F.col("rank").cast("string")),
    ]


def facts(tables: dict[str, DataFrame]) -> DataFrame:
    """All facts of all tables, each table read once."""
    def stated(table: DataFrame, found: list[Column]) -> DataFrame:
        return table.select(F.inline(F.array_compact(F.array(*found))))

    out = [stated(tables[e.table], _entity_facts(e)) for e in ENTITIES]
    out += [stated(tables[e.embedding], [_fact(e.name, F.col(e.key), "embedding")]) for e in ENTITIES]
    out += [stated(tables[e.repr_table], _link_facts(e)) for e in (ALBUM, ARTIST, LABEL)]
    union = out[0]
    for frame in out[1:]:
        union = union.unionByName(frame)
    return union


def _has(seen: str) -> Column:
    return F.col("bits").bitwiseAND(F.lit(1 << _BIT[seen]).cast("bigint")) != 0


def _outside(left: str, right: str) -> Column:
    """Seen in the left column but not in the right one; a null matches nothing."""
    return _has(left) & (F.col("number").isNull() | ~_has(right))


def checks() -> list[Check]:
    """Every guarantee."""
    out = []
    repeated = F.col("n") > 1
    for column, e, tolerated in NAME_COLUMNS:
        out.append(Check(f"no blanks in {e.table}.{column}", f"blank {e.table}.{column}", F.lit(True), tolerated))
    for e in ENTITIES:
        for p in (BY_NAME[name] for name in e.parents):
            seen = f"of_{e.table}"
            out.append(Check(f"{e.table}.{p.key} in {p.table}.{p.key}", p.name, _outside(seen, "own")))
            out.append(Check(f"{p.table}.{p.key} in {e.table}.{p.key}", p.name, _outside("own", seen), e == ALBUM and p == ARTIST))
        out.append(Check(f"{e.embedding}.{e.key} in {e.table}.{e.key}", e.name, _outside("embedding", "own")))
        out.append(Check(f"{e.table}.{e.key} in {e.embedding}.{e.key}", e.name, _outside("own", "embedding")))
        out.append(Check(f"{e.table}.{e.key} is unique", e.name, F.col("n_own") > 1))
        out.append(Check(f"{e.table}.{e.canonical_key} exists", e.name, _outside("canonical", "own")))
    for e in (ALBUM, ARTIST, LABEL):
        child = BY_NAME[e.repr_child]
        links = F.when(F.col("number").isNotNull(), F.col("links")).otherwise(0)
        wrong = (F.col("least_nrepr") != links) | (F.col("most_nrepr") != links)
        out.append(Check(f"{e.repr_table}.{e.key} in {e.table}", e.name, _outside("parent_link", "own")))
        out.append(Check(f"{e.repr_table}.{child.key} in searchable {child.table}", child.name, _outside("child_link", "searchable")))
        out.append(Check(f"{e.table}.nrepr matches {e.repr_table}", e.name, F.coalesce(wrong, F.lit(False))))
        out.append(Check(f"{e.repr_table} key is unique", f"key {e.repr_table}", repeated))
    out.append(Check("labels.label is unique", "label text", repeated))
    return out


def guarantee_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, ok, acceptable, violations) for every guarantee of the serving tables.

    A violation is a key, or for blank names a row.
    """
    own = F.col("bit") == _BIT["own"]
    keys = facts(tables).groupBy("space", "number", "word").agg(
        F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0)).alias("bits"),
        F.count("*").alias("n"), F.count_if(own).alias("n_own"), F.coalesce(F.sum("link"), F.lit(0)).alias("links"),
        F.min("nrepr").alias("least_nrepr"), F.max("nrepr").alias("most_nrepr"),
    )
    found = checks()
    counted = keys.agg(*[
        F.coalesce(F.sum(F.when((F.col("space") == c.space) & c.fails, F.col("n") if c.space.startswith("blank ") else F.lit(1))), F.lit(0))
        .cast("bigint").alias(f"v{k}")
        for k, c in enumerate(found)
    ])
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("check"), (F.col(f"v{k}") == 0).alias("ok"), F.lit(c.acceptable).alias("acceptable"),
                 F.col(f"v{k}").alias("violations"))
        for k, c in enumerate(found)
    ])
    return counted.select(F.inline(rows))
