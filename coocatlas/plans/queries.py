"""The registered queries: each operator applied to the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coocatlas import schema
from coocatlas.functions import numeric, text, vectors
from coocatlas.operators import catalog, entities, geo, guarantees, ids, pairs, patterns, quality, reprs, search, serve, similarity, vocab
from coocatlas.plans.build import Atlas, Settings
from coocatlas.schema import ALBUM, ARTIST, BY_NAME, ENTITIES, LABEL, TRACK
from coocatlas.sources import binding, exports
from coocatlas.sources.staging import Staging, written

Query = Callable[[SparkSession, str], DataFrame]

CHUNK_SIZE = 500
SLICE = 700
WINDOW = 2
SUB_THRESHOLD = 1e-4
NEGATIVES = 3
SEED = 666
GROUP_MIN = 3
N_QUERY = 50
K = 10
LISTS, PROBED = 4, 2
BINS = 50
BASE_ZOOMS = {"track": 9, "album": 8, "artist": 7, "label": 6}
MAX_ZOOM = 10
PICK_ZOOM, PICK_RADIUS = 4, 16.0
SHOWN_ZOOM, HIT_RADIUS = 6, 11.0

_QUERIES: dict[str, Query] = {}
_ATLASES: dict[tuple[str, str], Atlas] = {}


def atlas(spark: SparkSession, sf_dir: str) -> Atlas:
    """The build over one data folder; its staged tables are shared by the queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ATLASES:
        # positions that SQL can compute; fitted ones have their own query
        settings = Settings(projection="components")
        _ATLASES[key] = Atlas(binding.bind(spark, sf_dir), Staging(spark, sf_dir), settings, sf_dir=sf_dir)
    return _ATLASES[key]


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def query(function: Callable[[Atlas], DataFrame]) -> Callable[[Atlas], DataFrame]:
    _QUERIES[function.__name__] = lambda spark, sf_dir: function(atlas(spark, sf_dir))
    return function


def per_entity(names: tuple[str, ...]):
    """Register one query per entity, called <function>_<entity>."""

    def register(function: Callable[[Atlas, str], DataFrame]):
        for name in names:
            _QUERIES[f"{function.__name__}_{name}"] = lambda spark, sf_dir, n=name: function(atlas(spark, sf_dir), n)
        return function

    return register


ALL = tuple(e.name for e in ENTITIES)
PARENTS = ("album", "artist", "label")


def _r(*columns: str, digits: int = 4) -> list:
    return [F.round(F.col(c).cast("double"), digits).alias(c) for c in columns]


def _every(a: Atlas, name: str) -> DataFrame:
    """A request for every row of an entity."""
    e = BY_NAME[name]
    return a.tables[e.table].select(F.col(e.key).cast("bigint").alias("rowid"))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns rounded for comparison."""
    return df.select(
        *[F.round(F.col(n).cast("double"), digits).alias(n) if t in ("float", "double") else F.col(n) for n, t in df.dtypes]
    )


def _long(df: DataFrame, key: str, digits: int = 5) -> DataFrame:
    """Vectors as (key, i, value) rows."""
    flat = df.select(key, F.posexplode("embedding").alias("i", "value"))
    return flat.select(key, "i", *_r("value", digits=digits))


# Vocabulary and chunks


@query
def interaction_scan(a: Atlas) -> DataFrame:
    return vocab.usable_interactions(a.sources.interactions)


@query
def vocab_min_count(a: Atlas) -> DataFrame:
    return vocab.build_vocab(vocab.playlist_counts(a.sources.interactions), a.settings.min_count)


@query
def vocab_stats(a: Atlas) -> DataFrame:
    return _rounded(vocab.vocab_stats(a.vocab), 6)


@query
def vocab_rethreshold(a: Atlas) -> DataFrame:
    return vocab.build_vocab(a.vocab, 2 * a.settings.min_count)


@query
def playlist_slice_skip(a: Atlas) -> DataFrame:
    return vocab.playlist_slice(a.sources.playlists, SLICE)


@query
def playlist_slice_last(a: Atlas) -> DataFrame:
    return vocab.playlist_slice(a.sources.playlists, -SLICE)


@query
def chunk_rows(a: Atlas) -> DataFrame:
    return vocab.assign_chunks(a.sources.playlists, a.sources.interactions, CHUNK_SIZE)


@query
def chunk_export(a: Atlas) -> DataFrame:
    """Written chunks read back: rows and playlists per chunk."""
    path = a.staging.path("chunks")
    vocab.export_chunks(chunk_rows(a), path, overwrite=True)
    written = a.staging.spark.read.parquet(path)
    return written.groupBy(F.col("chunk_id").cast("int")).agg(
        F.count("*").alias("n"), F.countDistinct("playlist_rowid").alias("playlists")
    )


@query
def export_chunk_rows(a: Atlas) -> DataFrame:
    """All chunk rows, committed in one folder per chunk and read back in full."""
    path, target = a.staging.path("export_chunks"), T.StructType([T.StructField("chunk_id", T.IntegerType()), *schema.CHUNK_ROWS])
    exports.write_export(chunk_rows(a).hint("rebalance", F.col("chunk_id")), path, target, partition_by=("chunk_id",))
    return exports.read_export(a.staging.spark, path)


@query
def export_commit(a: Atlas) -> DataFrame:
    """The commit row of the exported vocabulary."""
    commit = a.export("vocab", a.staging.path("export_commit"))
    return commit.select("kind", F.array_join("columns", ",").alias("columns"), "rows", (F.col("bytes") > 0).alias("has_bytes"))


def _exported(a: Atlas, name: str) -> DataFrame:
    """A table written by the build's own export and read back with its file list checked."""
    path = a.staging.path(f"export_{name}")
    a.export(name, path)
    return exports.read_export(a.staging.spark, path)


@query
def export_enriched(a: Atlas) -> DataFrame:
    return _exported(a, "enriched")


@query
def export_search_documents(a: Atlas) -> DataFrame:
    return _rounded(_exported(a, "search_documents"))


@per_entity(ALL)
def export_embedding(a: Atlas, name: str) -> DataFrame:
    return _long(_exported(a, BY_NAME[name].embedding), BY_NAME[name].key)


@per_entity(ALL)
def export_geojson(a: Atlas, name: str) -> DataFrame:
    """Feature lines read back from their files, by key and position."""
    key = BY_NAME[name].key
    shape = f"geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<{key}: BIGINT, logcount: DOUBLE>"
    parsed = _exported(a, f"geojson_{name}").select(F.from_json("value", shape).alias("f"))
    return _rounded(parsed.select(
        F.col(f"f.properties.{key}").alias("rowid"), F.col("f.geometry.coordinates")[0].alias("lon"),
        F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.properties.logcount").alias("logcount")))


@query
def chunk_manifest(a: Atlas) -> DataFrame:
    return vocab.chunk_manifest(a.sources.playlists, CHUNK_SIZE, -SLICE)


@query
def chunked_counts(a: Atlas) -> DataFrame:
    return vocab.chunked_counts(chunk_rows(a))


@query
def chunk_split(a: Atlas) -> DataFrame:
    return ids.split_chunks(chunk_rows(a), 0.2, SEED, portable=True)


@query
def primary_artists(a: Atlas) -> DataFrame:
    return vocab.primary_artists(a.sources.track_artists)


@query
def primary_genres(a: Atlas) -> DataFrame:
    return vocab.primary_genres(a.sources.artist_genres)


@query
def label_dictionary(a: Atlas) -> DataFrame:
    return ids.dictionary(a.sources.albums, "label", "label_rowid")


@query
def enriched_vocab(a: Atlas) -> DataFrame:
    s = a.sources
    return vocab.enrich_vocab(a.vocab, s.tracks, s.albums, s.track_artists)


@query
def key_coverage(a: Atlas) -> DataFrame:
    first = a.sources.interactions.where("position = 1")
    return quality.key_coverage(a.vocab, first, "track_rowid")


@query
def coverage_counts(a: Atlas) -> DataFrame:
    return quality.coverage_counts(a.vocab, a.enriched)


# Entities


@query
def valid_tracks(a: Atlas) -> DataFrame:
    return entities.valid_tracks(a.enriched, a.sources.checkpoint)


@query
def group_threshold(a: Atlas) -> DataFrame:
    return entities.valid_group_tracks(a.valid, "artist_rowid", GROUP_MIN).select("track_rowid", "artist_rowid")


@query
def popularity_track(a: Atlas) -> DataFrame:
    return _rounded(entities.track_popularity(a.valid))


@per_entity(PARENTS)
def popularity(a: Atlas, name: str) -> DataFrame:
    distinct = {
        "album": {}, "artist": {"nalbum": "album_rowid"}, "label": {"nalbum": "album_rowid", "nartist": "artist_rowid"},
    }[name]
    return _rounded(entities.group_popularity(a.valid, BY_NAME[name].key, GROUP_MIN, distinct))


@per_entity(PARENTS)
def pooled_vectors(a: Atlas, name: str) -> DataFrame:
    key = BY_NAME[name].key
    return _long(entities.pool_vectors(a.valid, a.sources.checkpoint, key, GROUP_MIN), key)


@query
def track_metadata(a: Atlas) -> DataFrame:
    s = a.sources
    return entities.track_metadata(a.valid, s.tracks, s.albums, s.artists, s.track_artists, s.artist_genres)


@per_entity(ALL)
def lookup(a: Atlas, name: str) -> DataFrame:
    return _rounded(a.lookups[name])


@query
def ordered_embeddings(a: Atlas) -> DataFrame:
    """Recable vectors in id order, after checking that none is missing."""
    wanted = catalog.recable_ids(a.tables["tracks"], TRACK)
    found = a.embeddings["track"].join(wanted, "track_rowid", "left_semi")
    quality.require_coverage(wanted, found, "track_rowid")
    first = F.round(F.col("embedding")[0].cast("double"), 5)
    return ids.dense_index(found, "track_rowid", name="place").select("place", "track_rowid", first.alias("e0"))


@query
def wide_vectors(a: Atlas) -> DataFrame:
    return _rounded(vectors.to_wide(a.vectors["track"], 64), 5)


@query
def wide_vectors_regathered(a: Atlas) -> DataFrame:
    return _long(vectors.from_wide(vectors.to_wide(a.vectors["track"], 64)), "track_rowid")


# Training data


def _remapped(a: Atlas) -> DataFrame:
    return pairs.remap(vocab.usable_interactions(a.sources.interactions), a.vocab)


def _trained(a: Atlas) -> DataFrame:
    """Vocabulary rows that have a vector, under their vocabulary ids."""
    return a.vocab.join(a.sources.checkpoint.select("track_rowid"), "track_rowid", "left_semi")


@query
def vocab_remap(a: Atlas) -> DataFrame:
    return _remapped(a).select("playlist_rowid", "position", "track_rowid", "track_id")


@query
def keep_probabilities(a: Atlas) -> DataFrame:
    return _rounded(pairs.keep_probabilities(a.vocab, SUB_THRESHOLD), 6)


@query
def subsampled_rows(a: Atlas) -> DataFrame:
    kept = pairs.subsample(_remapped(a), a.vocab, SUB_THRESHOLD, SEED, portable=True)
    return kept.select("playlist_rowid", "position", "track_rowid", "track_id")


@query
def skipgram_pairs(a: Atlas) -> DataFrame:
    return pairs.skipgram_pairs(_remapped(a), WINDOW)


@query
def shuffled_pairs(a: Atlas) -> DataFrame:
    return ids.seeded_shuffle(skipgram_pairs(a), SEED, 1, "playlist_rowid", "pos", "k").select("center", "context")


@query
def noise_weights(a: Atlas) -> DataFrame:
    return _rounded(pairs.noise_cdf(a.vocab), 7)


@query
def negative_samples(a: Atlas) -> DataFrame:
    drawn = pairs.draw_negatives(
        skipgram_pairs(a), ["playlist_rowid", "pos", "k"], a.vocab, NEGATIVES, SEED, portable=True
    )
    return drawn.select("playlist_rowid", "pos", "k", "draw", "negative")


@query
def sgns_loss(a: Atlas) -> DataFrame:
    """Loss of the given vectors as input table and of their reversal as output table."""
    trained = _trained(a)
    rows = pairs.remap(vocab.usable_interactions(a.sources.interactions), trained)
    made = pairs.skipgram_pairs(rows, WINDOW)
    negatives = pairs.draw_negatives(made, ["playlist_rowid", "pos", "k"], trained, NEGATIVES, SEED, portable=True)
    inward = a.sources.checkpoint.join(trained, "track_rowid").select("track_id", "embedding")
    outward = inward.select("track_id", F.reverse("embedding").alias("embedding"))
    return _rounded(pairs.sgns_loss(made, negatives, inward, outward), 6)


@query
def shifted_pmi(a: Atlas) -> DataFrame:
    return _rounded(pairs.shifted_pmi(skipgram_pairs(a), NEGATIVES), 6)


@query
def fitted_vectors(a: Atlas) -> DataFrame:
    inward, outward = pairs.fit_vectors(skipgram_pairs(a), dim=16, iterations=4)
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    return inward.select("track_id", F.lit("in").alias("side"), F.size("embedding").alias("dim"), finite.alias("finite")).unionByName(
        outward.select("track_id", F.lit("out").alias("side"), F.size("embedding").alias("dim"), finite.alias("finite")))


@query
def trained_recommendations(a: Atlas) -> DataFrame:
    """From playlists to recommendations: fitted vectors, pooled by artist, indexed, searched."""
    inward, _ = pairs.fit_vectors(skipgram_pairs(a), dim=16, iterations=4)
    # read by each step of the index and by the search: joined and pooled only once
    trained = written(a.vocab.join(inward, "track_id").select("track_rowid", "embedding"))
    pooled = written(entities.pool_vectors(entities.valid_tracks(a.enriched, trained), trained, "artist_rowid", 1))
    artists = a.tables["artists"]
    listed = pooled.join(catalog.recable_ids(artists, ARTIST), "artist_rowid", "left_semi")
    index = similarity.train_index(listed, "artist_rowid", nlist=8)
    found = serve.recommend(artists, pooled, "artist", _every(a, "artist"), limit=5, index=index, nprobe=4)
    return found.select("seed_rowid", "position", "rowid")


# Serving tables


@query
def normalized_titles(a: Atlas) -> DataFrame:
    return a.sources.tracks.select("track_rowid", text.normalize_title(F.col("name")).alias("title"))


@query
def album_canonical(a: Atlas) -> DataFrame:
    return catalog.canonical_albums(a.flagged["albums"]).select("album_rowid", "album_canonical_rowid")


@query
def track_canonical(a: Atlas) -> DataFrame:
    found = catalog.canonical_tracks(a.flagged["tracks"], a.flagged["albums"])
    return found.select("track_rowid", "track_canonical_rowid")


@per_entity(ALL)
def serving(a: Atlas, name: str) -> DataFrame:
    return _rounded(a.tables[BY_NAME[name].table])


@query
def flag_totals(a: Atlas) -> DataFrame:
    return catalog.flag_totals(a.tables)


@per_entity(ALL)
def recable_ids(a: Atlas, name: str) -> DataFrame:
    return catalog.recable_ids(a.tables[BY_NAME[name].table], BY_NAME[name])


@query
def required_columns(a: Atlas) -> DataFrame:
    parts = [
        quality.blank_counts(a.flagged[table], list(columns)).select(F.lit(table).alias("entity"), "column", "blanks")
        for table, columns in (("albums", catalog.REQUIRED_ALBUM), ("tracks", catalog.REQUIRED_TRACK))
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def guarantee_report(a: Atlas) -> DataFrame:
    return guarantees.guarantee_report(a.tables)


@query
def album_repr_tracks(a: Atlas) -> DataFrame:
    return _rounded(reprs.album_tracks(a.flagged["tracks"], a.settings.repr_limit))


@query
def album_scores(a: Atlas) -> DataFrame:
    return _rounded(reprs.album_scores(a.flagged["tracks"], a.flagged["albums"]))


@query
def artist_repr_albums(a: Atlas) -> DataFrame:
    return _rounded(reprs.artist_albums(a.flagged["tracks"], a.flagged["albums"], a.settings.repr_limit))


@query
def damped_scores(a: Atlas) -> DataFrame:
    return _rounded(reprs.damped_scores(a.flagged["tracks"].where("searchable")))


@query
def label_repr_artists(a: Atlas) -> DataFrame:
    return _rounded(reprs.label_artists(a.flagged["tracks"], a.flagged["artists"], a.settings.repr_limit))


@query
def repr_counts(a: Atlas) -> DataFrame:
    parts = [
        reprs.with_nrepr(a.flagged[e.table], a.links[e.repr_table], e).select(
            F.lit(e.name).alias("entity"), F.col(e.key).cast("bigint").alias("rowid"), "nrepr"
        )
        for e in (ALBUM, ARTIST, LABEL)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def repr_coverage(a: Atlas) -> DataFrame:
    return reprs.repr_coverage(a.tables)


# Read queries


@per_entity(ALL)
def info(a: Atlas, name: str) -> DataFrame:
    return _rounded(serve.info(a.tables[BY_NAME[name].table], name, _every(a, name)))


@per_entity(PARENTS)
def representatives(a: Atlas, name: str) -> DataFrame:
    e = BY_NAME[name]
    child = BY_NAME[e.repr_child]
    return _rounded(serve.representatives(a.tables[e.repr_table], a.tables[child.table], name, _every(a, name), 2))


@per_entity(ALL)
def panel(a: Atlas, name: str) -> DataFrame:
    """Panels with the nested children written as ranked "id:name" text."""
    found = serve.panel(a.tables, name, _every(a, name))
    if name == "track":
        listed = F.lit("")
    else:
        title = BY_NAME[BY_NAME[name].repr_child].title
        listed = F.array_join(F.transform("reprs", lambda r: F.concat_ws(":", r["rowid"], r[title])), "|")
    return _rounded(found.withColumn("children", listed).drop("reprs"))


def _seeds_with_floor(a: Atlas, name: str) -> DataFrame:
    e = BY_NAME[name]
    return a.tables[e.table].select(
        F.col(e.key).cast("bigint").alias("rowid"), numeric.default_popfloor(F.col("logcount")).alias("popfloor")
    )


@per_entity(ALL)
def recommend(a: Atlas, name: str) -> DataFrame:
    e = BY_NAME[name]
    return _rounded(
        serve.recommend(a.tables[e.table], a.tables[e.embedding], name, _seeds_with_floor(a, name), limit=5)
    )


@per_entity(ALL)
def recommend_indexed(a: Atlas, name: str) -> DataFrame:
    """Recommendations from the written index, each seed visiting two of its four lists."""
    e = BY_NAME[name]
    found = serve.recommend(
        a.tables[e.table], a.tables[e.embedding], name, _seeds_with_floor(a, name), limit=5,
        index=a.index(name, nlist=LISTS, trained=False), nprobe=PROBED,
    )
    return _rounded(found)


@query
def recommend_not_diverse(a: Atlas) -> DataFrame:
    found = serve.recommend(
        a.tables["tracks"], a.tables["track_embedding"], "track", _every(a, "track"), limit=3, diverse=False, popfloor=1.25
    )
    return _rounded(found.select("seed_rowid", "position", "rowid", "simscore"))


@query
def recommend_status(a: Atlas) -> DataFrame:
    """Status of a request for every part, with or without a vector."""
    asked = a.sources.tracks.select(F.col("track_rowid").alias("rowid"))
    found = serve.recommend(a.tables["tracks"], a.tables["track_embedding"], "track", asked, limit=3, popfloor=1.4)
    return serve.recommend_status(asked, a.tables["track_embedding"], found, "track")


@query
def name_search(a: Atlas) -> DataFrame:
    return serve.match_names(a.metadata, "RED (widget|r.*g)", "r#0+[1-5]").select(
        "track_rowid", "track_name", "artist_name"
    )


def _text_requests(a: Atlas) -> DataFrame:
    """One request per distinct part name, under the lowest part id that has it."""
    return (
        binding.read(a.staging.spark, a.sf_dir, "part")
        .groupBy("p_name")
        .agg(F.min("p_partkey").alias("request_id"))
    )


@query
def find_neighbours(a: Atlas) -> DataFrame:
    asked = _text_requests(a).select(
        "request_id",
        F.upper(F.expr("substring(p_name, 1, length(p_name) - 1)")).alias("query"),
        F.when(F.col("request_id") % 2 == 1, (F.col("request_id") % 10).cast("string")).alias("artist"),
    )
    return _rounded(serve.find_neighbours(asked, a.metadata, a.embeddings["track"], k=5))


def _pattern_requests(a: Atlas) -> DataFrame:
    """Patterns of four kinds made of the part names: begun, with a gap, with too few letters, with alternatives."""
    name, kind = F.col("p_name"), F.col("request_id") % 4
    query = (
        F.when(kind == 0, F.concat(F.lit("^"), F.upper(name)))
        .when(kind == 1, F.expr("concat(substring(p_name, 1, 3), '.+', right(p_name, 4), '( |$)')"))
        .when(kind == 2, F.expr("concat('^', substring(p_name, 1, 2), '.*', right(p_name, 2), '$')"))
        .otherwise(F.concat(F.lit("("), name, F.lit("|zzz)")))
    )
    artist = F.when(F.col("request_id") % 3 == 1, F.lit("R#0+[1-5]"))
    return _text_requests(a).select("request_id", query.alias("query"), artist.alias("artist"))


@query
def name_search_requests(a: Atlas) -> DataFrame:
    """Tracks that match each of many patterns, by the written index of name pieces."""
    return patterns.pattern_matches(_pattern_requests(a), a.metadata, *a.name_pieces).select("request_id", "track_rowid")


@query
def find_neighbours_pattern(a: Atlas) -> DataFrame:
    found = serve.find_neighbours(
        _pattern_requests(a), a.metadata, a.embeddings["track"], 5, True, True, *a.name_pieces)
    return _rounded(found)


@query
def search_documents(a: Atlas) -> DataFrame:
    return _rounded(search.search_documents(a.tables))


def _search_requests(a: Atlas) -> DataFrame:
    """Part names as typed: whole, cut short, with an artist word, or with a letter missing."""
    name = F.col("p_name")
    cut = F.expr("substring(p_name, 1, length(p_name) - 2)")
    missing = F.replace(F.replace(F.replace(name, F.lit("widget"), F.lit("wdget")), F.lit("anvil"), F.lit("anvl")),
                        F.lit("small"), F.lit("smalll"))
    typed = (
        F.when(F.col("request_id") % 4 == 0, name)
        .when(F.col("request_id") % 4 == 1, cut)
        .when(F.col("request_id") % 4 == 2, F.concat(name, F.lit(" suplier")))
        .otherwise(missing)
    )
    return _text_requests(a).select("request_id", typed.alias("text"))


@query
def search_scores(a: Atlas) -> DataFrame:
    return search.score_matches(_search_requests(a), a.search_index)


@query
def search_rarest_words(a: Atlas) -> DataFrame:
    """Per request the word whose postings are read, and how many documents that makes candidates at most."""
    phrases = search.leading_phrases(_search_requests(a)).where("whole")
    terms = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    both = terms.withColumn("is_last", F.explode(F.array(F.lit(True), F.lit(False))))
    index = a.search_index
    expansion = search.expand_terms(both, index.spellings, index.prefixes)
    rarest = search.rarest_terms(phrases.select("phrase", "whole").distinct(), expansion, index.frequencies)
    return phrases.join(rarest, ["phrase", "whole"]).select("request_id", "term", "docs")


@query
def search_hits(a: Atlas) -> DataFrame:
    return _rounded(search.search(_search_requests(a), a.search_index, 10))


@query
def search_hits_rarest_first(a: Atlas) -> DataFrame:
    """The same by the rarest words, as when the requests' words have many hits."""
    return _rounded(search.search(_search_requests(a), a.search_index, 10, direct=0))


# Similarity


@per_entity(ALL)
def unit_vectors(a: Atlas, name: str) -> DataFrame:
    return _long(a.tables[BY_NAME[name].embedding], BY_NAME[name].key)


def _split(a: Atlas) -> tuple[DataFrame, DataFrame]:
    return ids.split_off(vectors.l2_normalize(a.sources.checkpoint), "track_rowid", N_QUERY, SEED, portable=True)


@query
def query_base_split(a: Atlas) -> DataFrame:
    queries, base = _split(a)
    return queries.select("track_rowid", F.lit("query").alias("part")).unionByName(
        base.select("track_rowid", F.lit("base").alias("part"))
    )


@query
def exact_knn(a: Atlas) -> DataFrame:
    queries, base = _split(a)
    return _rounded(similarity.exact_neighbours(queries, base, K, "track_rowid", "track_rowid"))


@query
def exact_knn_lists(a: Atlas) -> DataFrame:
    """Exact neighbours the way large sides are searched: lists that cannot hold one are skipped."""
    queries, base = _split(a)
    index = similarity.train_index(base, "track_rowid", nlist=16)
    return _rounded(similarity.search_exact(index, queries, K, "track_rowid"))


@query
def list_search_all(a: Atlas) -> DataFrame:
    """Inverted-list search visiting every list, which must equal exact search."""
    queries, base = _split(a)
    index = similarity.train_index(base, "track_rowid", nlist=8)
    return _rounded(similarity.search(index, queries, K, "track_rowid", nprobe=8))


def _sampled_index(a: Atlas, base: DataFrame, nlist: int, bands: int = 1) -> similarity.Index:
    centroids = similarity.sampled_centroids(base, "track_rowid", nlist, SEED, portable=True)
    return similarity.build_index(base, "track_rowid", centroids, bands)


@query
def list_search(a: Atlas) -> DataFrame:
    """Approximate search: each query visits four of sixteen lists around sampled vectors."""
    queries, base = _split(a)
    return _rounded(similarity.search(_sampled_index(a, base, 16), queries, K, "track_rowid", nprobe=4))


@query
def list_search_trained(a: Atlas) -> DataFrame:
    """The same with centroids trained on the vectors."""
    queries, base = _split(a)
    index = similarity.train_index(base, "track_rowid", nlist=16)
    return _rounded(similarity.search(index, queries, K, "track_rowid", nprobe=4))


@query
def list_recall(a: Atlas) -> DataFrame:
    """Recall of sampled lists against exact search, by the number of lists visited."""
    found = similarity.recall_by_nprobe(
        a.sources.checkpoint, "track_rowid", N_QUERY, K, (1, 4, 16), SEED, nlist=32, trained=False, portable=True)
    return _rounded(found)


@query
def exact_knn_lengths(a: Atlas) -> DataFrame:
    """Exact neighbours among vectors of many lengths: lists cut into bands, visited by their bound."""
    queries, base = _split(a)
    factor = F.pow(F.lit(2.0), -(F.col("track_rowid") % 13) / 3)
    longer = base.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * factor))
    index = _sampled_index(a, longer, 8, bands=similarity.BANDS)
    return _rounded(similarity.search_exact(index, queries, K, "track_rowid", nprobe=2))


@query
def list_counts(a: Atlas) -> DataFrame:
    parts = [
        a.tables[e.table].where("recable").agg(F.count("*").alias("n")).select(
            F.lit(e.name).alias("entity"), "n", numeric.list_count(F.col("n")).alias("nlist"),
            numeric.train_size(F.col("n")).alias("train"),
        )
        for e in ENTITIES
    ]
    return reduce(DataFrame.unionByName, parts)


# Map


@query
def projections_union(a: Atlas) -> DataFrame:
    return _rounded(geo.union_projections(a.projections), 5)


@query
def geo_lonlat(a: Atlas) -> DataFrame:
    half = a.settings.half_width
    points = geo.union_projections(a.projections)
    return _rounded(geo.to_lonlat(points, -half, half, a.settings.padding))


@query
def density_bins(a: Atlas) -> DataFrame:
    return geo.density_bins(a.projections["track"], BINS)


@query
def coordinate_summary(a: Atlas) -> DataFrame:
    return _rounded(geo.coordinate_summary(a.projections["track"]), 6)


def _named_points(a: Atlas) -> DataFrame:
    return geo.named_points(a.projections["track"], entities.track_popularity(a.valid), a.metadata)


@query
def named_points(a: Atlas) -> DataFrame:
    return _rounded(_named_points(a))


@query
def highlights(a: Atlas) -> DataFrame:
    """The most popular point of every (primary artist, track name), asked for in capitals."""
    s = a.sources
    wanted = (
        s.tracks.join(vocab.primary_artists(s.track_artists), "track_rowid")
        .join(s.artists.select("artist_rowid", F.col("name").alias("artist")), "artist_rowid")
        .select(F.upper("artist").alias("artist"), F.upper("name").alias("track"))
        .distinct()
    )
    return _rounded(geo.highlights(_named_points(a), wanted))


@query
def top_by_popularity(a: Atlas) -> DataFrame:
    popular = entities.track_popularity(a.valid)
    return _rounded(ids.take_first(popular, 100, F.desc("logcount"), "track_rowid"))


@query
def pca_projection(a: Atlas) -> DataFrame:
    """Positions of all entities on the two principal axes of all tracks."""
    return geo.union_projections(geo.project_2d(a.vectors))


@query
def pca_summary(a: Atlas) -> DataFrame:
    """What principal axes must satisfy: centred, uncorrelated, no component and no other axis varies more than the first."""
    points = geo.project_2d(a.vectors)["track"].agg(
        F.count("*").alias("n"), F.round(F.abs(F.avg("umap_x")), 4).alias("mean_x"), F.round(F.abs(F.avg("umap_y")), 4).alias("mean_y"),
        F.round(F.abs(F.covar_pop("umap_x", "umap_y")), 5).alias("covariance"), F.var_pop("umap_x").alias("vx"), F.var_pop("umap_y").alias("vy"))
    cells = a.vectors["track"].select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v"))
    parts = cells.agg(F.max("v").alias("most"), F.sum("v").alias("total"))
    return points.crossJoin(F.broadcast(parts)).select(
        "n", "mean_x", "mean_y", "covariance", (F.col("vx") >= F.col("vy")).alias("first_is_widest"),
        (F.col("vx") >= F.col("most")).alias("wider_than_components"),
        (F.col("vx") + F.col("vy") < F.col("total")).alias("within_total"), F.round("total", 4).alias("total_variance"))


@per_entity(ALL)
def geojson(a: Atlas, name: str) -> DataFrame:
    """Feature lines parsed back into their values."""
    key = BY_NAME[name].key
    lines = geo.feature_json(a.tables[BY_NAME[name].table], name)
    shape = (
        "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, "
        f"properties STRUCT<{key}: BIGINT, logcount: DOUBLE>"
    )
    parsed = lines.select("rowid", F.from_json("line", shape).alias("f"))
    return _rounded(
        parsed.select(
            "rowid", F.col("f.type").alias("type"), F.col("f.geometry.type").alias("shape"),
            F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
            F.col(f"f.properties.{key}").alias("key"), F.col("f.properties.logcount").alias("logcount"),
        )
    )


def _placed(a: Atlas) -> DataFrame:
    parts = [
        a.tables[e.table].select(
            F.lit(e.name).alias("entity"), F.col(e.key).cast("bigint").alias("rowid"), "lon", "lat", "logcount"
        )
        for e in ENTITIES
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def tile_points(a: Atlas) -> DataFrame:
    return geo.tile_points(_placed(a), BASE_ZOOMS, MAX_ZOOM, SEED, portable=True)


@query
def tile_sizes(a: Atlas) -> DataFrame:
    return geo.tile_sizes(tile_points(a))


@query
def tile_size_stats(a: Atlas) -> DataFrame:
    return _rounded(geo.tile_size_stats(tile_sizes(a)))


@query
def pick_features(a: Atlas) -> DataFrame:
    """The most popular feature under a click on every artist's position."""
    clicks = a.tables["artists"].select(F.col("artist_rowid").alias("click_id"), "lon", "lat")
    return _rounded(geo.pick_features(clicks, _placed(a), PICK_ZOOM, PICK_RADIUS))


@query
def pick_features_shown(a: Atlas) -> DataFrame:
    """The same among the features that thinning leaves on the tiles, with the map's own hit radius."""
    clicks = a.tables["artists"].select(F.col("artist_rowid").alias("click_id"), "lon", "lat")
    shown = geo.shown_at(_placed(a), tile_points(a), SHOWN_ZOOM)
    return _rounded(geo.pick_features(clicks, shown, SHOWN_ZOOM, HIT_RADIUS))


# Expressions


@query
def display_texts(a: Atlas) -> DataFrame:
    return a.tables["tracks"].select(
        "track_rowid",
        text.playlist_count_text(F.col("artist_logcount") * 3).alias("artist_text"),
        text.human_count(F.col("track_rowid") * 12345).alias("human"),
        numeric.default_popfloor(F.col("artist_logcount") + 1).alias("popfloor"),
        text.display_track_name(F.when(F.col("track_rowid") % 5 > 0, F.col("track_name_norm")).otherwise("")).alias("shown"),
        numeric.type_priority(F.when(F.col("track_rowid") % 3 == 0, "Album").when(F.col("track_rowid") % 3 == 1, "EP"))
        .alias("priority"),
    )


@query
def search_ids(a: Atlas) -> DataFrame:
    made = search.search_documents(a.tables).select(
        "id", text.fold_key(F.concat(F.lit("  "), F.coalesce("artist_name", "label"), F.lit(" Straße "))).alias("folded")
    )
    parsed = made.withColumn("e", text.parse_search_id(F.col("id")))
    return parsed.select("id", "e.entity_type", "e.rowid", "folded")


@query
def build_tables(a: Atlas) -> DataFrame:
    """A whole build into a fresh folder: rows of every table it writes."""
    staging = Staging(a.staging.spark, a.sf_dir, fresh=True)
    built = Atlas(a.sources, staging, a.settings, sf_dir=a.sf_dir)
    built.validate()
    parts = [frame.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, frame in built.tables.items()]
    return reduce(DataFrame.unionByName, parts)
