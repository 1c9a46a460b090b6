"""From source tables to serving tables, staged table by table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType

from coocatlas import schema
from coocatlas.functions.vectors import l2_normalize
from coocatlas.operators import catalog, entities, geo, patterns, reprs, vocab
from coocatlas.operators.catalog import Thresholds
from coocatlas.operators.guarantees import guarantee_report
from coocatlas.operators.quality import conform, require_columns, require_coverage, require_guarantees
from coocatlas.operators.search import SearchIndex, search_documents, search_index
from coocatlas.operators.similarity import SEED, Index, build_index, empty_index, list_count_for, open_index, sampled_centroids, train_centroids
from coocatlas.schema import ALBUM, ARTIST, ENTITIES, LABEL, TRACK, Entity, entity
from coocatlas.sources.binding import Sources
from coocatlas.sources.exports import write_export
from coocatlas.sources.staging import Staging


@dataclass(frozen=True)
class Settings:
    """Parameters of a build."""

    min_count: int = 12
    min_tracks: int = 1
    half_width: float = 22.5
    padding: float = 0.1
    repr_limit: int = 3
    #: Where no positions are given: "axes" fits two principal axes, "components" takes the first two numbers.
    projection: str = "axes"
    thresholds: Thresholds = field(default_factory=lambda: Thresholds(1.2, 10, 3, 12, 1.3))


class Atlas:
    """One build of all tables. Each property is a table written once and then read back."""

    def __init__(
        self, sources: Sources, staging: Staging, settings: Settings = Settings(),
        projections: dict[str, DataFrame] | None = None, sf_dir: str | None = None,
    ):
        self.sources = sources
        given = sorted((name, frame.semanticHash()) for name, frame in (projections or {}).items())
        self.staging = staging.under(repr(settings), repr(given))
        self.settings = settings
        self.sf_dir = sf_dir
        self._projections = projections

    def _stage(self, name: str, build) -> DataFrame:
        return self.staging.table(name, build)

    @cached_property
    def vocab(self) -> DataFrame:
        counts = vocab.playlist_counts(self.sources.interactions)
        return self._stage("vocab", lambda: vocab.build_vocab(counts, self.settings.min_count))

    @cached_property
    def enriched(self) -> DataFrame:
        s = self.sources
        return self._stage("enriched", lambda: vocab.enrich_vocab(self.vocab, s.tracks, s.albums, s.track_artists))

    @cached_property
    def valid(self) -> DataFrame:
        return self._stage("valid", lambda: entities.valid_tracks(self.enriched, self.sources.checkpoint))

    @cached_property
    def metadata(self) -> DataFrame:
        s = self.sources
        return self._stage(
            "metadata",
            lambda: entities.track_metadata(
                self.valid, s.tracks, s.albums, s.artists, s.track_artists, s.artist_genres
            ),
        )

    @cached_property
    def lookups(self) -> dict[str, DataFrame]:
        n = self.settings.min_tracks
        return {
            "track": entities.track_lookup(self.valid, self.metadata),
            "artist": entities.artist_lookup(self.valid, self.metadata, n),
            "album": entities.album_lookup(self.enriched, self.valid, self.metadata, n),
            "label": entities.label_lookup(self.enriched, self.valid, self.metadata, n),
        }

    @cached_property
    def vectors(self) -> dict[str, DataFrame]:
        """Track vectors and the mean vectors of the other entities."""
        valid, trained = self.valid, self.sources.checkpoint
        pooled = self.staging.together({
            f"vectors_{e.name}": lambda e=e: entities.pool_vectors(valid, trained, e.key, self.settings.min_tracks)
            for e in (ALBUM, ARTIST, LABEL)
        })
        return {
            "track": entities.track_vectors(valid, trained),
            **{e.name: pooled[f"vectors_{e.name}"] for e in (ALBUM, ARTIST, LABEL)},
        }

    @cached_property
    def embeddings(self) -> dict[str, DataFrame]:
        """Unit vectors per entity, written with their declared schema."""
        vectors = self.vectors

        def unit(e: Entity) -> DataFrame:
            schema = vectors[e.name].select(e.key).schema.add("embedding", ArrayType(FloatType()))
            return conform(l2_normalize(vectors[e.name]), schema)

        staged = self.staging.together({e.embedding: lambda e=e: unit(e) for e in ENTITIES})
        return {e.name: staged[e.embedding] for e in ENTITIES}

    def index(self, name: str, nlist: int | None = None, trained: bool = True) -> Index:
        """Written similarity index over the recable rows of an entity, built on first use.

        The number of lists follows the number of rows unless given; without rows there are none. Centroids are trained, or
        else a seeded sample of the vectors, the same however the rows are laid out.
        """
        e = entity(name)
        stage = f"index_{name}_{nlist or 'auto'}_{'trained' if trained else 'sampled'}"
        if not self.staging.written(f"{stage}/cells"):
            listed = self.tables[e.embedding].join(catalog.recable_ids(self.tables[e.table], e), e.key, "left_semi")
            n = listed.count()
            if not n:
                return empty_index(self.tables[e.embedding], e.key)
            count = min(n, nlist or list_count_for(n))
            if trained:
                centroids = train_centroids(listed, e.key, n, count, SEED, iterations=10)
            else:
                centroids = sampled_centroids(listed, e.key, count, SEED, portable=True)
            build_index(listed, e.key, centroids, path=self.staging.path(stage))
        return open_index(self.staging.spark, self.staging.path(stage))

    @cached_property
    def projections(self) -> dict[str, DataFrame]:
        """2-D positions per entity: as given, or by two principal axes of all tracks, or the first two components."""
        if self._projections is not None:
            return self._projections
        if self.settings.projection == "axes":
            fitted = geo.project_2d(self.vectors)
            staged = self.staging.together({f"projection_{name}": lambda f=frame: f for name, frame in fitted.items()})
            return {name: staged[f"projection_{name}"] for name in fitted}
        return {
            e.name: self.vectors[e.name].selectExpr(e.key, "embedding[0] AS umap_x", "embedding[1] AS umap_y")
            for e in ENTITIES
        }

    @cached_property
    def lonlat(self) -> DataFrame:
        half = self.settings.half_width
        return self._stage(
            "lonlat",
            lambda: geo.to_lonlat(geo.union_projections(self.projections), -half, half, self.settings.padding),
        )

    @cached_property
    def flagged(self) -> dict[str, DataFrame]:
        """Entity tables with canonical keys and flags, before representatives are counted."""
        look, limits = self.lookups, self.settings.thresholds
        placed = {e.name: geo.entity_geo(self.lonlat, e.name) for e in ENTITIES}
        parents = self.staging.together({
            "flagged_labels": lambda: catalog.with_flags(
                catalog.build_labels(look["label"], placed["label"]), LABEL, limits
            ),
            "flagged_artists": lambda: catalog.with_flags(
                catalog.build_artists(look["artist"], placed["artist"]), ARTIST, limits
            ),
        })
        labels, artists = parents["flagged_labels"], parents["flagged_artists"]
        albums = self._stage(
            "flagged_albums",
            lambda: catalog.with_flags(
                catalog.canonical_albums(catalog.build_albums(look["album"], placed["album"], artists, labels)),
                ALBUM, limits,
            ),
        )
        tracks = self._stage(
            "flagged_tracks",
            lambda: catalog.with_flags(
                catalog.canonical_tracks(
                    catalog.build_tracks(look["track"], placed["track"], artists, albums, labels), albums
                ),
                TRACK, limits,
            ),
        )
        return {"labels": labels, "artists": artists, "albums": albums, "tracks": tracks}

    @cached_property
    def links(self) -> dict[str, DataFrame]:
        """The three tables of ranked representatives."""
        t, n = self.flagged, self.settings.repr_limit
        return self.staging.together({
            "album_repr_tracks": lambda: reprs.album_tracks(t["tracks"], n),
            "artist_repr_albums": lambda: reprs.artist_albums(t["tracks"], t["albums"], n),
            "label_repr_artists": lambda: reprs.label_artists(t["tracks"], t["artists"], n),
        })

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """All serving tables by name: four entities, four embedding tables, three link tables."""
        flagged, links = self.flagged, self.links
        done = dict(links)
        done |= self.staging.together({
            e.table: lambda e=e: reprs.with_nrepr(flagged[e.table], links[e.repr_table], e) for e in (ALBUM, ARTIST, LABEL)
        })
        done["tracks"] = self.flagged["tracks"]
        for e in ENTITIES:
            done[e.embedding] = self.embeddings[e.name]
        return done

    @cached_property
    def search_index(self) -> SearchIndex:
        return search_index(search_documents(self.tables), self.staging)

    def export(self, name: str, path: str) -> DataFrame:
        """Write and commit one of the exchanged tables under ``path``; its commit row is returned.

        ``vocab`` and ``enriched`` in their declared schemas, ``search_documents`` as JSON,
        ``geojson_<entity>`` as lines in key order, and any serving table by its name.
        """
        if name in ("vocab", "enriched"):
            target = {"vocab": schema.VOCAB, "enriched": schema.ENRICHED_VOCAB}[name]
            return write_export(getattr(self, name), path, target)
        if name == "search_documents":
            return write_export(self.search_index.documents, path, kind="json")
        if name.startswith("geojson_"):
            e = entity(name.removeprefix("geojson_"))
            return write_export(geo.sorted_lines(geo.feature_json(self.tables[e.table], e.name)), path, kind="text")
        if name not in self.tables:
            raise ValueError(f"unknown export {name!r}")
        return write_export(self.tables[name], path)

    @cached_property
    def name_pieces(self) -> tuple[DataFrame, DataFrame]:
        """Written index of the track names' pieces, and how many names hold each piece."""
        pieces = self._stage("name_pieces", lambda: patterns.name_pieces(self.metadata))
        return pieces, self._stage("name_piece_counts", lambda: patterns.piece_counts(pieces))

    def validate(self) -> None:
        """Fail if enrichment lost or repeated a track, a required column is null or blank, or a guarantee does not hold."""
        require_coverage(self.vocab, self.enriched, "track_rowid")
        require_columns(self.flagged["albums"], list(catalog.REQUIRED_ALBUM), "albums")
        require_columns(self.flagged["tracks"], list(catalog.REQUIRED_TRACK), "tracks")
        require_guarantees(guarantee_report(self.tables))
