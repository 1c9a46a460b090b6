"""Entity descriptors and the fixed schemas of the exchanged tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Entity:
    """One of the four catalogue entities, as used by the generic operators."""

    name: str
    table: str
    embedding: str
    title: str
    parents: tuple[str, ...] = ()
    repr_table: str | None = None
    repr_child: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}_rowid"

    @property
    def canonical_key(self) -> str:
        return f"{self.name}_canonical_rowid"


TRACK = Entity("track", "tracks", "track_embedding", "track_name_norm", ("album", "artist", "label"))
ALBUM = Entity(
    "album", "albums", "album_embedding", "album_name_norm", ("artist", "label"), "album_repr_tracks", "track"
)
ARTIST = Entity("artist", "artists", "artist_embedding", "artist_name", (), "artist_repr_albums", "album")
LABEL = Entity("label", "labels", "label_embedding", "label", (), "label_repr_artists", "artist")

ENTITIES = (TRACK, ALBUM, ARTIST, LABEL)
BY_NAME = {entity.name: entity for entity in ENTITIES}


def entity(name: str) -> Entity:
    """Look an entity up by name; an unknown name is an error, not an empty result."""
    try:
        return BY_NAME[name]
    except KeyError:
        raise ValueError(f"unknown entity {name!r}, expected one of {', '.join(BY_NAME)}") from None


_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "FLOAT": T.FloatType(),
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema of "name TYPE, ..." without needing a session."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


INTERACTIONS = _struct(
    "playlist_rowid BIGINT, track_rowid BIGINT, position SMALLINT, added_at BIGINT, "
    "added_by_id STRING, is_episode BOOLEAN, is_local BOOLEAN"
)
CHUNK_ROWS = _struct(
    "playlist_rowid BIGINT, track_rowid BIGINT, position SMALLINT, added_at BIGINT, added_by_id STRING"
)
VOCAB = _struct("track_rowid BIGINT, track_id INT, playlist_count INT")
ENRICHED_VOCAB = _struct(
    "track_rowid BIGINT, track_id INT, playlist_count INT, artist_rowid BIGINT, "
    "album_rowid BIGINT, label_rowid INT, id_isrc STRING"
)
TRACK_LOOKUP = _struct(
    "track_rowid BIGINT, track_name STRING, artist_rowid BIGINT, artist_name STRING, album_rowid BIGINT, "
    "album_name STRING, track_popularity SMALLINT, release_date STRING, id_isrc STRING, label STRING, "
    "label_rowid INT, logcount FLOAT"
)
ARTIST_LOOKUP = _struct(
    "artist_rowid BIGINT, artist_name STRING, artist_genre STRING, logcount FLOAT, ntrack INT, nalbum INT"
)
ALBUM_LOOKUP = _struct(
    "album_rowid BIGINT, album_name STRING, artist_rowid BIGINT, label_rowid INT, label STRING, "
    "artist_name STRING, album_type STRING, release_date STRING, release_date_precision STRING, "
    "logcount FLOAT, total_tracks INT"
)
LABEL_LOOKUP = _struct("label_rowid INT, label STRING, logcount FLOAT, ntrack INT, nalbum INT, nartist INT")
