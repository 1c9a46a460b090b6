"""Read queries over the serving tables, for whole sets of requests at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coocatlas.functions.let import let
from coocatlas.functions.vectors import l2_normalize
from coocatlas.operators.patterns import pattern_matches
from coocatlas.operators.similarity import Index, exact_neighbours, search
from coocatlas.schema import entity
from coocatlas.sources.staging import checkpoint

# The fields of the exchanged records, in their order.
INFO_COLUMNS = {
    "track": (
        "track_name_norm", "artist_rowid", "artist_name", "artist_logcount", "album_rowid", "album_name",
        "album_name_norm", "album_logcount", "label_rowid", "label", "label_logcount", "lon", "lat", "album_lon",
        "album_lat", "artist_lon", "artist_lat", "label_lon", "label_lat", "logcount", "release_date",
    ),
    "album": (
        "album_name_norm", "artist_rowid", "artist_name", "artist_logcount", "label_rowid", "label", "label_logcount",
        "lon", "lat", "artist_lon", "artist_lat", "label_lon", "label_lat", "logcount", "nrepr", "total_tracks",
        "release_date", "album_type",
    ),
    "artist": ("artist_name", "lon", "lat", "logcount", "ntrack", "nalbum", "nrepr", "artist_genre"),
    "label": ("label", "lon", "lat", "logcount", "ntrack", "nalbum", "nartist", "nrepr"),
}
CHILD_COLUMNS = {
    "track": ("track_name_norm", "artist_name", "lon", "lat", "logcount"),
    "album": ("album_name_norm", "artist_name", "lon", "lat", "logcount"),
    "artist": ("artist_name", "lon", "lat", "logcount"),
}
RECOMMEND_COLUMNS = {
    **CHILD_COLUMNS,
    "artist": ("artist_name", "lon", "lat", "logcount", "artist_genre"),
    "label": ("label", "lon", "lat", "logcount"),
}
DIVERSIFIABLE = ("track", "album")


def _in_range(name: str, value: float, low: float, high: float | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))


def by_key(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids`` (rowid)."""
    return table.join(ids.select(F.col("rowid").alias(key)), key, "left_semi")


def info(table: DataFrame, name: str, requests: DataFrame) -> DataFrame:
    """The info record of each requested id; an unknown id gives no row."""
    e = entity(name)
    return by_key(table, e.key, requests).select(
        F.lit(name).alias("entity_type"), F.col(e.key).cast("bigint").alias("rowid"), *INFO_COLUMNS[name]
    )


def representatives(links: DataFrame, children: DataFrame, name: str, requests: DataFrame, limit: int = 3) -> DataFrame:
    """(parent_rowid, rank, child record) for the first ``limit`` children of each requested parent."""
    _in_range("limit", limit, 1, 3)
    e = entity(name)
    child = entity(e.repr_child)
    record = children.select(
        child.key, F.lit(child.name).alias("entity_type"), F.col(child.key).cast("bigint").alias("rowid"),
        *CHILD_COLUMNS[child.name],
    )
    return (
        by_key(links.where(F.col("rank") < limit), e.key, requests)
        .select(F.col(e.key).cast("bigint").alias("parent_rowid"), "rank", child.key)
        .join(record, child.key)
        .drop(child.key)
    )


def panel(tables: dict[str, DataFrame], name: str, requests: DataFrame, repr_limit: int = 3) -> DataFrame:
    """Info record with the ranked children nested as ``reprs``; no children gives an empty array."""
    _in_range("repr_limit", repr_limit, 1, 3)
    e = entity(name)
    records = info(tables[e.table], name, requests)
    if e.repr_child is None:
        return records.withColumn("reprs", F.expr("CAST(array() AS ARRAY<STRING>)"))
    child = entity(e.repr_child)
    nested = representatives(tables[e.repr_table], tables[child.table], name, requests, repr_limit)
    fields = ("entity_type", "rowid", *CHILD_COLUMNS[child.name])
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("child"))))
    reprs = nested.groupBy(F.col("parent_rowid").alias("rowid")).agg(ranked["child"].alias("reprs"))
    return records.join(reprs, "rowid", "left").withColumn("reprs", F.coalesce("reprs", F.array()))


def fetch_depth(limit: int, diversifiable: bool, popfloor: Column) -> Column:
    """Number of neighbours fetched before filtering: twenty-fold when a filter may drop some."""
    wide = F.lit(diversifiable) | (popfloor > 0)
    return F.when(wide, 20 * limit + 1).otherwise(limit + 1)


def recommend(
    table: DataFrame, vectors: DataFrame, name: str, requests: DataFrame, limit: int = 10, diverse: bool = True,
    popfloor: float = 0, index: Index | None = None, nprobe: int = 16,
) -> DataFrame:
    """Ranked recommendations (seed_rowid, position, record, simscore) per requested seed.

    ``requests`` has rowid and may have its own popfloor column. Neighbours come from
    the recable rows, by exact search or from a prepared index over them. The fetch
    depth applies before the seed itself, unpopular rows and repeated artists are
    dropped, so a result may be shorter than ``limit``. A repeated request gives its
    rows once. Seeds without a vector give no rows here; ``recommend_status`` tells them apart from seeds without results.
    """
    _in_range("limit", limit, 1, 50)
    _in_range("popfloor", popfloor, 0)
    e = entity(name)
    diversifiable = diverse and name in DIVERSIFIABLE
    floor = F.col("popfloor").cast("double") if "popfloor" in requests.columns else F.lit(float(popfloor))
    asked = requests.select(F.col("rowid").cast("bigint").alias("query_id"), floor.alias("popfloor")).distinct()
    depth = fetch_depth(limit, diversifiable, F.col("popfloor"))
    k = 20 * limit + 1 if diversifiable or popfloor > 0 or "popfloor" in requests.columns else limit + 1

    unit = l2_normalize(vectors)
    seeds = unit.join(asked.select(F.col("query_id").alias(e.key)).distinct(), e.key, "left_semi")
    if index is None:
        base = unit.join(table.where("recable").select(e.key), e.key, "left_semi")
        neighbours = exact_neighbours(seeds, base, k, e.key, e.key)
    else:
        neighbours = search(index, seeds, k, e.key, nprobe)

    columns = RECOMMEND_COLUMNS[name]
    facts = table.select(
        F.col(e.key).cast("bigint").alias("neighbor_id"), *columns,
        *([F.col("artist_rowid").alias("_artist")] if diversifiable else []),
    )
    kept = (
        neighbours.where(F.col("neighbor_id") != F.col("query_id"))
        .join(asked, "query_id")
        .where(F.col("rank") <= depth)
        .join(facts, "neighbor_id")
        .where(F.col("logcount") > F.col("popfloor"))
    )
    if diversifiable:
        first = F.row_number().over(W.partitionBy("query_id", "popfloor", "_artist").orderBy("rank"))
        kept = kept.withColumn("_first", first).where("_first = 1")
    position = F.row_number().over(W.partitionBy("query_id", "popfloor").orderBy("rank"))
    return (
        kept.withColumn("position", position)
        .where(F.col("position") <= limit)
        .select(
            F.col("query_id").alias("seed_rowid"), "popfloor", (F.col("position") - 1).alias("position"),
            F.lit(name).alias("entity_type"), F.col("neighbor_id").alias("rowid"), *columns,
            F.col("score").alias("simscore"),
        )
    )


def recommend_status(requests: DataFrame, vectors: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """(rowid, status, n): missing without a vector, empty without results, otherwise ok."""
    known = vectors.select(F.col(entity(name).key).cast("bigint").alias("rowid"), F.lit(True).alias("_known"))
    counts = results.groupBy(F.col("seed_rowid").alias("rowid")).agg(F.count("*").alias("n"))
    joined = requests.select(F.col("rowid").cast("bigint")).distinct().join(known, "rowid", "left").join(
        counts, "rowid", "left"
    )
    status = F.when(F.col("_known").isNull(), "missing").when(F.col("n").isNull(), "empty").otherwise("ok")
    return joined.select("rowid", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def match_names(names: DataFrame, pattern: str, artist: str | None = None) -> DataFrame:
    """Tracks whose name, and optionally artist, match a case-insensitive regular expression."""
    found = names.where(F.coalesce(F.col("track_name").rlike(f"(?i){pattern}"), F.lit(False)))
    if artist is not None:
        found = found.where(F.coalesce(F.col("artist_name").rlike(f"(?i){artist}"), F.lit(False)))
    return found


def _grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct substrings of the given lengths."""

    def of(t: Column, n: int) -> Column:
        last = F.length(t) - n + 1
        spans = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
        return F.transform(spans, lambda i: F.substring(t, i, F.lit(n)))

    return let(text, lambda t: F.array_distinct(F.flatten(F.array(*[of(t, n) for n in sizes]))))


def contains_matches(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request_id, track_rowid, ...) where the name holds the requested text, and the artist the requested one.

    Every request probes a substring index with the rarest of its own three-letter
    pieces and the hits are then compared in full, so no request meets every name.
    Shorter requests use shorter pieces.
    """
    indexed = names.withColumn("_name", F.lower("track_name"))
    postings = indexed.select("track_rowid", F.explode(_grams(F.col("_name"))).alias("gram"))
    asked = requests.select("request_id", F.lower("query").alias("_query"), F.lower("artist").alias("_artist"))
    size = F.least(F.length("_query"), F.lit(3))
    pieces = asked.withColumn("gram", F.explode(_grams(F.col("_query")))).where(F.length("gram") == size)
    frequency = postings.join(pieces.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count("*").alias("df")
    )
    rarest = (
        pieces.join(frequency, "gram", "left")
        .groupBy("request_id", "_query", "_artist")
        .agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("gram"))
    )
    hits = rarest.join(postings, "gram").join(indexed, "track_rowid")
    in_name = F.col("_name").contains(F.col("_query"))
    by_artist = F.col("_artist").isNull() | F.lower("artist_name").contains(F.col("_artist"))
    return hits.where(in_name & by_artist).drop("gram", "_name", "_query", "_artist")


def find_neighbours(
    requests: DataFrame, names: DataFrame, vectors: DataFrame, k: int = 10, diverse: bool = True, patterns: bool = False,
    pieces: DataFrame | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Neighbours (request_id, position, ...) of the most popular track matching each text request.

    ``requests`` has (request_id, query, artist), artist nullable; ``names`` has
    track_rowid, track_name, artist_name and track_popularity. Texts are plain, or with
    ``patterns`` regular expressions, which may use a written index of the names' pieces.
    50 k + 1 neighbours are fetched; the match itself is dropped and, if diverse, one track
    per artist name kept.
    """
    known = names.join(vectors.select("track_rowid"), "track_rowid", "left_semi")
    matches = pattern_matches(requests, known, pieces, counts) if patterns else contains_matches(requests, known)
    order = F.struct(-F.coalesce("track_popularity", F.lit(-1)), F.col("track_rowid"))
    # one row per request, read several times below
    seeds = checkpoint(matches.groupBy("request_id").agg(F.min_by("track_rowid", order).alias("seed_rowid")))
    unit = l2_normalize(vectors)
    asked = unit.join(seeds.select(F.col("seed_rowid").alias("track_rowid")), "track_rowid", "left_semi")
    near = exact_neighbours(asked, unit, 50 * k + 1, "track_rowid", "track_rowid")
    found = (
        near.join(seeds, F.col("query_id") == F.col("seed_rowid"))
        .where(F.col("neighbor_id") != F.col("seed_rowid"))
        .join(known.withColumnRenamed("track_rowid", "neighbor_id"), "neighbor_id")
    )
    if diverse:
        first = F.row_number().over(W.partitionBy("request_id", "artist_name").orderBy("rank"))
        found = found.withColumn("_first", first).where("_first = 1")
    position = F.row_number().over(W.partitionBy("request_id").orderBy("rank"))
    return (
        found.withColumn("position", position)
        .where(F.col("position") <= k)
        .select(
            "request_id", "seed_rowid", (F.col("position") - 1).alias("position"),
            F.col("neighbor_id").alias("track_rowid"), "track_name", "artist_name", "track_popularity",
            F.col("score").alias("similarity"),
        )
    )
