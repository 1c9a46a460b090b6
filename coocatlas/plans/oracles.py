"""DuckDB SQL for the registered queries, written against the given tables only.

Shared steps are named subqueries; a query pulls in the ones it mentions.
"""

from __future__ import annotations

import re

from coocatlas.operators import catalog
from coocatlas.operators.quality import NAME_COLUMNS
from coocatlas.operators.serve import CHILD_COLUMNS, INFO_COLUMNS, RECOMMEND_COLUMNS
from coocatlas.plans import queries as q
from coocatlas.plans.build import Settings
from coocatlas.schema import ALBUM, ARTIST, BY_NAME, ENTITIES, LABEL
from coocatlas.sources import binding

S = Settings()
LIMITS = S.thresholds


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _title(x: str) -> str:
    clean = rf"regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '\.{{3,}}', '..', 'g')"
    shape = r"'^(.+?)(\s+-\s*[^()]*|\s*\[.*\]\s*|\s*\([^()]*\)\s*)$'"
    marked = f"regexp_matches(lower(regexp_extract({clean}, {shape}, 2)), 'remaster|edition|version|deluxe|expanded|anniversary')"
    return f"CASE WHEN {marked} THEN rtrim(regexp_extract({clean}, {shape}, 1)) ELSE {clean} END"


def _uniform(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656.0)"


def _round(columns, digits: int = 4, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}::DOUBLE, {digits}) AS {c}" for c in columns)


STEPS: dict[str, str] = {}

STEPS["m_playlists"] = "SELECT o_orderkey AS playlist_rowid FROM orders"
STEPS["m_inter"] = """SELECT l_orderkey AS playlist_rowid, l_partkey AS track_rowid, l_linenumber::SMALLINT AS position,
  epoch(l_shipdate)::BIGINT AS added_at, l_suppkey::VARCHAR AS added_by_id, l_returnflag = 'R' AS is_episode,
  l_tax = 0 AS is_local FROM lineitem"""
STEPS["m_usable"] = "SELECT * FROM m_inter WHERE NOT is_episode AND NOT is_local AND track_rowid IS NOT NULL"
_slot = f"(list_position({_list(binding.PART_TYPES)}, p_type) - 1)"
_brand = "split_part(p_brand, '#', 2)::BIGINT"
STEPS["m_tracks"] = f"""SELECT p_partkey AS track_rowid,
  p_name || ({_list(binding.TRACK_SUFFIXES)})[(p_partkey % 4 + 1)::INT] AS name, nullif(p_size, 50) AS popularity,
  'ZZ' || lpad(p_partkey::VARCHAR, 10, '0') AS external_id_isrc, {_brand} * 10 + {_slot} AS album_rowid FROM part"""
STEPS["m_albums"] = f"""SELECT {_brand} * 10 + {_slot} AS album_rowid,
  'Selection ' || ({_brand} % 3)::VARCHAR || ({_list(binding.ALBUM_SUFFIXES)})[({_slot} + 1)::INT] AS name,
  CASE WHEN p_brand = '{binding.UNLABELLED_BRAND}' THEN '' ELSE p_brand END AS label,
  ({_list(binding.ALBUM_TYPES)})[({_slot} + 1)::INT] AS album_type, total_tracks,
  (1990 + {_brand})::VARCHAR AS release_date, 'year' AS release_date_precision
  FROM (SELECT p_brand, p_type, count(*)::INT AS total_tracks FROM part GROUP BY ALL)"""
STEPS["m_artists"] = "SELECT s_suppkey AS artist_rowid, s_name AS name FROM supplier"
STEPS["m_genres"] = """SELECT s_suppkey AS artist_rowid, u.ordinal, u.genre FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
  LATERAL (SELECT 0 AS ordinal, n_name AS genre UNION ALL SELECT 1, r_name) u WHERE s_acctbal >= 0"""
STEPS["m_ckpt"] = "SELECT vec_id AS track_rowid, embedding FROM embeddings"
STEPS["m_counts"] = "SELECT track_rowid, count(DISTINCT playlist_rowid)::INT AS playlist_count FROM m_usable GROUP BY 1"
STEPS["m_t0"] = f"""SELECT track_rowid, (row_number() OVER (ORDER BY track_rowid) - 1)::INT AS track_id, playlist_count
  FROM m_counts WHERE playlist_count >= {S.min_count}"""
STEPS["m_pa"] = """SELECT track_rowid, artist_rowid FROM (SELECT l_partkey AS track_rowid, l_suppkey AS artist_rowid,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1"""
STEPS["m_pg"] = """SELECT artist_rowid, genre AS artist_genre FROM (SELECT *,
  row_number() OVER (PARTITION BY artist_rowid ORDER BY ordinal, genre) AS n FROM m_genres) WHERE n = 1"""
STEPS["m_t0meta"] = """SELECT v.*, t.album_rowid, t.external_id_isrc AS id_isrc, a.label, p.artist_rowid
  FROM m_t0 v JOIN m_tracks t USING (track_rowid) JOIN m_albums a USING (album_rowid) JOIN m_pa p USING (track_rowid)"""
STEPS["m_label_ids"] = """SELECT label, row_number() OVER (ORDER BY label)::INT AS label_rowid
  FROM (SELECT DISTINCT label FROM m_t0meta WHERE label IS NOT NULL AND label <> '')"""
STEPS["m_t1"] = """SELECT track_rowid, track_id, playlist_count, artist_rowid, album_rowid, label_rowid, id_isrc
  FROM m_t0meta LEFT JOIN m_label_ids USING (label)"""
STEPS["m_valid"] = "SELECT * FROM m_t1 WHERE label_rowid IS NOT NULL AND track_rowid IN (SELECT track_rowid FROM m_ckpt)"
STEPS["m_meta"] = """SELECT v.track_rowid, t.name AS track_name, coalesce(t.popularity, 0)::SMALLINT AS track_popularity,
  t.external_id_isrc AS id_isrc, p.artist_rowid, g.artist_genre, ar.name AS artist_name, t.album_rowid,
  al.name AS album_name, al.label, al.total_tracks, al.album_type, al.release_date, al.release_date_precision
  FROM m_valid v JOIN m_tracks t USING (track_rowid) JOIN m_pa p USING (track_rowid)
  JOIN m_albums al ON al.album_rowid = t.album_rowid JOIN m_artists ar ON ar.artist_rowid = p.artist_rowid
  LEFT JOIN m_pg g ON g.artist_rowid = p.artist_rowid"""
STEPS["m_lk_track"] = """SELECT m.track_rowid, track_name, m.artist_rowid, artist_name, m.album_rowid, album_name,
  track_popularity, release_date, m.id_isrc, label, label_rowid, log10(playlist_count)::FLOAT AS logcount
  FROM m_meta m JOIN m_valid v ON v.track_rowid = m.track_rowid"""


def _first(columns, order: str = "track_rowid") -> str:
    return ", ".join(f"arg_min({c}, {order}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)


STEPS["m_lk_artist"] = f"""SELECT artist_rowid, artist_name, artist_genre, logcount, ntrack, nalbum FROM
  (SELECT artist_rowid, log10(sum(playlist_count))::FLOAT AS logcount, count(*)::INT AS ntrack,
   count(DISTINCT album_rowid)::INT AS nalbum FROM m_valid GROUP BY 1 HAVING count(*) >= {S.min_tracks})
  JOIN (SELECT artist_rowid, {_first(["artist_name", "artist_genre"])} FROM m_meta GROUP BY 1) USING (artist_rowid)"""
STEPS["m_lk_album"] = f"""SELECT album_rowid, album_name, artist_rowid, label_rowid, label, artist_name, album_type,
  release_date, release_date_precision, logcount, total_tracks FROM
  (SELECT album_rowid, log10(sum(playlist_count))::FLOAT AS logcount FROM m_valid GROUP BY 1
   HAVING count(*) >= {S.min_tracks})
  JOIN (SELECT album_rowid, {_first(["album_name", "artist_rowid", "artist_name", "label_rowid", "label", "album_type",
                                     "release_date", "release_date_precision", "total_tracks"])}
   FROM (SELECT m.*, t.label_rowid FROM m_meta m LEFT JOIN m_t1 t ON t.track_rowid = m.track_rowid) GROUP BY 1)
  USING (album_rowid)"""
STEPS["m_lk_label"] = f"""SELECT label_rowid, label, logcount, ntrack, nalbum, nartist FROM
  (SELECT label_rowid, log10(sum(playlist_count))::FLOAT AS logcount, count(*)::INT AS ntrack,
   count(DISTINCT album_rowid)::INT AS nalbum, count(DISTINCT artist_rowid)::INT AS nartist FROM m_valid GROUP BY 1
   HAVING count(*) >= {S.min_tracks})
  JOIN (SELECT t.label_rowid, {_first(["label"], "m.track_rowid")} FROM m_t1 t
   JOIN m_meta m ON m.track_rowid = t.track_rowid GROUP BY 1) USING (label_rowid)"""
STEPS["m_cells"] = """SELECT track_rowid, i, v FROM (SELECT track_rowid, generate_subscripts(embedding, 1) - 1 AS i,
  unnest(embedding) AS v FROM m_ckpt)"""
STEPS["m_vec_track"] = "SELECT track_rowid, i, v::FLOAT AS v FROM m_cells WHERE track_rowid IN (SELECT track_rowid FROM m_valid)"
for _e in (ALBUM, ARTIST, LABEL):
    STEPS[f"m_vec_{_e.name}"] = f"""SELECT {_e.key}, i, avg(v::DOUBLE)::FLOAT AS v, count(*) AS members
  FROM m_cells JOIN m_valid USING (track_rowid) GROUP BY 1, 2 HAVING count(*) >= {S.min_tracks}"""
for _e in ENTITIES:
    STEPS[f"m_unit_{_e.name}"] = f"""SELECT {_e.key}, i,
  (v::DOUBLE / greatest(sqrt(sum(v::DOUBLE * v::DOUBLE) OVER (PARTITION BY {_e.key})), 1e-12))::FLOAT AS v
  FROM m_vec_{_e.name}"""
    STEPS[f"m_list_{_e.name}"] = f"SELECT {_e.key} AS id, list(v::DOUBLE ORDER BY i) AS v FROM m_unit_{_e.name} GROUP BY 1"
    STEPS[f"m_xy_{_e.name}"] = f"""SELECT '{_e.name}' AS entity, {_e.key}::BIGINT AS rowid,
  max(v) FILTER (WHERE i = 0) AS umap_x, max(v) FILTER (WHERE i = 1) AS umap_y FROM m_vec_{_e.name} GROUP BY 2"""
STEPS["m_xy"] = " UNION ALL ".join(f"SELECT * FROM m_xy_{e.name}" for e in ENTITIES)
STEPS["m_box"] = f"""SELECT min(umap_x)::DOUBLE - {S.padding} AS x0, max(umap_x)::DOUBLE + {S.padding} AS x1,
  min(umap_y)::DOUBLE - {S.padding} AS y0, max(umap_y)::DOUBLE + {S.padding} AS y1 FROM m_xy"""
STEPS["m_geo"] = f"""SELECT entity, rowid,
  round_even((umap_x::DOUBLE - x0) / (x1 - x0) * {-2 * S.half_width} + {S.half_width}, 6)::FLOAT AS lon,
  round_even((umap_y::DOUBLE - y0) / (y1 - y0) * {2 * S.half_width} - {S.half_width}, 6)::FLOAT AS lat FROM m_xy, m_box"""


def _placed(name: str) -> str:
    e = BY_NAME[name]
    return f"""(SELECT l.* REPLACE (l.logcount::DOUBLE AS logcount), g.lon::DOUBLE AS lon, g.lat::DOUBLE AS lat
   FROM m_lk_{name} l JOIN m_geo g ON g.entity = '{name}' AND g.rowid = l.{e.key})"""


def _flags(metric: str, least: float, entity, extra: str = "true") -> str:
    visible = f"coalesce({entity.canonical_key} = {entity.key} AND {metric} >= {least}, false)"
    return f"{visible} AS searchable, {visible} AND {extra} AS recable"


STEPS["m_labels_f"] = f"""SELECT *, {_flags("nartist", LIMITS.label_nartist, LABEL)} FROM
  (SELECT *, label_rowid AS label_canonical_rowid FROM {_placed("label")})"""
STEPS["m_artists_f"] = f"""SELECT *, {_flags("ntrack", LIMITS.artist_ntrack, ARTIST)} FROM
  (SELECT *, artist_rowid AS artist_canonical_rowid FROM {_placed("artist")})"""
_parent = lambda alias, name: ", ".join(f"{alias}.{c} AS {name}_{c}" for c in ("lon", "lat", "logcount"))
STEPS["m_albums_b"] = f"""SELECT l.*, {_parent("ar", "artist")}, {_parent("la", "label")},
  {_title("l.album_name")} AS album_name_norm FROM {_placed("album")} l
  LEFT JOIN m_artists_f ar ON ar.artist_rowid = l.artist_rowid LEFT JOIN m_labels_f la ON la.label_rowid = l.label_rowid"""
STEPS["m_albums_f"] = f"""SELECT *, {_flags("total_tracks", LIMITS.album_total_tracks, ALBUM)} FROM
  (SELECT *, min(album_rowid) OVER (PARTITION BY artist_rowid, coalesce(album_type, ''), lower(album_name_norm))
   AS album_canonical_rowid FROM m_albums_b)"""
STEPS["m_tracks_b"] = f"""SELECT l.*, {_parent("ar", "artist")}, {_parent("al", "album")}, {_parent("la", "label")},
  al.album_name_norm, al.album_canonical_rowid, {_title("l.track_name")} AS track_name_norm FROM {_placed("track")} l
  LEFT JOIN m_artists_f ar ON ar.artist_rowid = l.artist_rowid LEFT JOIN m_albums_f al ON al.album_rowid = l.album_rowid
  LEFT JOIN m_labels_f la ON la.label_rowid = l.label_rowid"""
_track_flags = _flags("logcount", LIMITS.track_logcount, BY_NAME["track"], f"logcount >= {LIMITS.recable_track_logcount}")
STEPS["m_tracks_f"] = f"""SELECT *, {_track_flags} FROM (SELECT *, min(track_rowid) OVER
   (PARTITION BY album_canonical_rowid, lower(track_name_norm)) AS track_canonical_rowid FROM m_tracks_b)"""
STEPS["m_album_repr"] = f"""SELECT album_rowid, (n - 1)::INT AS rank, track_rowid, logcount AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY album_rowid ORDER BY logcount DESC, track_rowid) AS n
   FROM m_tracks_f WHERE searchable) WHERE n <= {S.repr_limit}"""
STEPS["m_album_scores"] = """SELECT album_canonical_rowid, median(logcount) AS score FROM m_tracks_f WHERE searchable GROUP BY 1"""
STEPS["m_artist_cand"] = """SELECT a.artist_rowid, a.album_rowid, a.logcount, s.score,
  CASE lower(coalesce(album_type, '')) WHEN 'album' THEN 0 WHEN 'ep' THEN 1 ELSE 2 END AS priority
  FROM m_albums_f a JOIN m_album_scores s ON s.album_canonical_rowid = a.album_rowid WHERE a.searchable"""
STEPS["m_artist_repr"] = f"""SELECT artist_rowid, (n - 1)::INT AS rank, album_rowid, score FROM
  (SELECT *, row_number() OVER (PARTITION BY artist_rowid ORDER BY score DESC, logcount DESC, album_rowid) AS n FROM
   (SELECT *, min(priority) OVER (PARTITION BY artist_rowid) AS best FROM m_artist_cand) WHERE priority = best)
  WHERE n <= {S.repr_limit}"""


def _damped(where: str) -> str:
    return f"""SELECT label_rowid, artist_rowid, round(sum(logcount) / sqrt(count(*)), 9) AS score
  FROM m_tracks_f WHERE {where} GROUP BY 1, 2"""


STEPS["m_label_repr"] = f"""SELECT label_rowid, (n - 1)::INT AS rank, artist_rowid, score FROM
  (SELECT *, row_number() OVER (PARTITION BY label_rowid ORDER BY score DESC, artist_rowid) AS n FROM
   ({_damped("searchable AND artist_rowid IN (SELECT artist_rowid FROM m_artists_f WHERE searchable)")}))
  WHERE n <= {S.repr_limit}"""
REPR = {"album": "m_album_repr", "artist": "m_artist_repr", "label": "m_label_repr"}
TABLE = {"track": "m_tracks_f", "album": "m_albums_t", "artist": "m_artists_t", "label": "m_labels_t"}
for _e in (ALBUM, ARTIST, LABEL):
    STEPS[TABLE[_e.name]] = f"""SELECT f.*, coalesce(r.n, 0)::INT AS nrepr FROM m_{_e.table}_f f LEFT JOIN
  (SELECT {_e.key}, count(*) AS n FROM {REPR[_e.name]} GROUP BY 1) r USING ({_e.key})"""
STEPS["m_placed"] = " UNION ALL ".join(
    f"SELECT '{e.name}' AS entity, {e.key}::BIGINT AS rowid, lon, lat, logcount FROM {TABLE[e.name]}" for e in ENTITIES
)

# training data
STEPS["m_remap"] = """SELECT u.playlist_rowid, u.position, u.track_rowid, v.track_id, v.playlist_count
  FROM m_usable u JOIN m_t0 v USING (track_rowid)"""
STEPS["m_trained"] = "SELECT * FROM m_t0 WHERE track_rowid IN (SELECT track_rowid FROM m_ckpt)"
STEPS["m_remap_trained"] = """SELECT u.playlist_rowid, u.position, u.track_rowid, v.track_id
  FROM m_usable u JOIN m_trained v USING (track_rowid)"""


def _pairs(rows: str) -> str:
    return f"""SELECT c.playlist_rowid, c.pos::INT AS pos, c.k::INT AS k, c.track_id AS center, x.track_id AS context FROM
  (SELECT *, unnest(generate_series(-((ew + 1) // 2), ew // 2)) AS k FROM
   (SELECT *, least({2 * q.WINDOW}, n - 1) AS ew FROM {rows} WHERE n >= 2)) c
  JOIN {rows} x ON x.playlist_rowid = c.playlist_rowid AND x.pos = ((c.pos + c.k) % c.n + c.n) % c.n WHERE c.k <> 0"""


def _placed_rows(rows: str) -> str:
    return f"""SELECT playlist_rowid, track_id, count(*) OVER (PARTITION BY playlist_rowid) AS n,
  row_number() OVER (PARTITION BY playlist_rowid ORDER BY position, track_rowid) - 1 AS pos FROM {rows}"""


def _cdf(vocab: str) -> str:
    return f"""SELECT track_id, w / total AS weight, (upto - w) / total AS low, upto / total AS high FROM
  (SELECT track_id, w, sum(w) OVER (ORDER BY track_id) AS upto, sum(w) OVER () AS total FROM
   (SELECT track_id, pow(playlist_count, 0.75) AS w FROM {vocab}))"""


def _negatives(pairs: str, cdf: str) -> str:
    return f"""SELECT d.playlist_rowid, d.pos, d.k, d.center, d.draw, c.track_id AS negative FROM
  (SELECT *, {_uniform(f"'{q.SEED}'", "playlist_rowid", "pos", "k", "draw")} AS u FROM
   (SELECT *, unnest(range(1, {q.NEGATIVES + 1}))::INT AS draw FROM {pairs})) d
  ASOF JOIN {cdf} c ON d.u >= c.low"""


STEPS["m_pair_rows"] = _placed_rows("m_remap")
STEPS["m_pairs"] = _pairs("m_pair_rows")
STEPS["m_cdf"] = _cdf("m_t0")
STEPS["m_negatives"] = _negatives("m_pairs", "m_cdf")
STEPS["m_pair_rows_trained"] = _placed_rows("m_remap_trained")
STEPS["m_pairs_trained"] = _pairs("m_pair_rows_trained")
STEPS["m_cdf_trained"] = _cdf("m_trained")
STEPS["m_negatives_trained"] = _negatives("m_pairs_trained", "m_cdf_trained")
STEPS["m_indexed"] = """SELECT playlist_rowid, row_number() OVER (ORDER BY playlist_rowid) - 1 AS idx,
  count(*) OVER () AS n FROM m_playlists"""
STEPS["m_chunks"] = f"""SELECT (idx // {q.CHUNK_SIZE})::INT AS chunk_id, u.playlist_rowid, track_rowid, position, added_at,
  added_by_id FROM m_usable u JOIN m_indexed USING (playlist_rowid)"""

# similarity
STEPS["m_ckpt_unit"] = """SELECT track_rowid AS id, list_transform(embedding, lambda x: (x::DOUBLE / greatest(
  sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))::FLOAT::DOUBLE) AS v FROM m_ckpt"""
STEPS["m_drawn"] = f"""SELECT *, row_number() OVER (ORDER BY {_uniform(f"'{q.SEED}'", "id")}, id) <= {q.N_QUERY} AS is_query
  FROM m_ckpt_unit"""
_score = "round(list_inner_product(a.v, b.v), 9)"
STEPS["m_knn"] = f"""SELECT query_id, neighbor_id, score, rank::INT AS rank FROM (SELECT a.id AS query_id, b.id AS neighbor_id,
  {_score} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {_score} DESC, b.id) AS rank
  FROM m_drawn a JOIN m_drawn b ON a.is_query AND NOT b.is_query) WHERE rank <= {q.K}"""


STEPS["m_knn_base"] = "SELECT id, v FROM m_drawn WHERE NOT is_query"


def _drawn_lists(base: str, nlist: int) -> str:
    return f"""SELECT c.id AS cid, c.v AS c, row_number() OVER (ORDER BY c.id) - 1 AS list_id
  FROM (SELECT * FROM {base} ORDER BY {_uniform("'666'", "id")}, id LIMIT {nlist}) c"""


def _assigned(base: str, cents: str) -> str:
    return f"""SELECT id, v, list_id FROM (SELECT b.id, b.v, list_id, row_number() OVER (PARTITION BY b.id
   ORDER BY round(list_inner_product(b.v, c), 9) DESC, list_id) AS n FROM {base} b, {cents}) WHERE n = 1"""


def _searched(queries: str, cents: str, lists: str, nprobe: int) -> str:
    """Ranked neighbours of every query within the lists it visits."""
    return f"""SELECT query_id, neighbor_id, score, rank::INT AS rank FROM (SELECT a.id AS query_id, b.id AS neighbor_id,
  {_score} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {_score} DESC, b.id) AS rank
  FROM (SELECT q.id, q.v, list_id, row_number() OVER (PARTITION BY q.id
   ORDER BY round(list_inner_product(q.v, c), 9) DESC, list_id) AS n FROM {queries} q, {cents}) a
  JOIN {lists} b ON a.list_id = b.list_id AND a.n <= {nprobe})"""


STEPS["m_knn_queries"] = "SELECT id, v FROM m_drawn WHERE is_query"
for _k in (16, 32):
    STEPS[f"m_cents_{_k}"] = _drawn_lists("m_knn_base", _k)
    STEPS[f"m_lists_{_k}"] = _assigned("m_knn_base", f"m_cents_{_k}")
for _e in ENTITIES:
    STEPS[f"m_recable_{_e.name}"] = f"""SELECT * FROM m_list_{_e.name} WHERE id IN
  (SELECT {_e.key} FROM {TABLE[_e.name]} WHERE recable)"""
    STEPS[f"m_cents_{_e.name}"] = _drawn_lists(f"m_recable_{_e.name}", 4)
    STEPS[f"m_lists_{_e.name}"] = _assigned(f"m_recable_{_e.name}", f"m_cents_{_e.name}")
    STEPS[f"m_listed_{_e.name}"] = _searched(f"m_list_{_e.name}", f"m_cents_{_e.name}", f"m_lists_{_e.name}", 2)


def _near(name: str) -> str:
    e = BY_NAME[name]
    return f"""SELECT query_id, neighbor_id, score, rank FROM (SELECT a.id AS query_id, b.id AS neighbor_id, {_score} AS score,
  row_number() OVER (PARTITION BY a.id ORDER BY {_score} DESC, b.id) AS rank FROM m_list_{name} a, m_list_{name} b
  WHERE b.id IN (SELECT {e.key} FROM {TABLE[name]} WHERE recable))"""


for _e in ENTITIES:
    STEPS[f"m_near_{_e.name}"] = _near(_e.name)
STEPS["m_floors"] = " UNION ALL ".join(
    f"SELECT '{e.name}' AS entity, {e.key}::BIGINT AS rowid, greatest(floor(logcount - 2 + 0.5), 0) AS popfloor FROM {TABLE[e.name]}"
    for e in ENTITIES
)

# text requests
STEPS["m_asked_names"] = "SELECT p_name, min(p_partkey) AS request_id FROM part GROUP BY 1"
STEPS["m_docs"] = """SELECT 'track_' || track_rowid AS id, NULL::VARCHAR AS label, artist_name, NULL::VARCHAR AS album_name_norm,
  track_name_norm, logcount, lon, lat FROM m_tracks_f WHERE searchable
  UNION ALL SELECT 'album_' || album_rowid, NULL, artist_name, album_name_norm, NULL, logcount, lon, lat
  FROM m_albums_f WHERE searchable
  UNION ALL SELECT 'artist_' || artist_rowid, NULL, artist_name, NULL, NULL, logcount, lon, lat
  FROM m_artists_f WHERE searchable
  UNION ALL SELECT 'label_' || label_rowid, label, NULL, NULL, NULL, logcount, lon, lat FROM m_labels_f WHERE searchable"""
STEPS["m_typed"] = """SELECT request_id, CASE request_id % 4 WHEN 0 THEN p_name
  WHEN 1 THEN substr(p_name, 1, length(p_name) - 2) WHEN 2 THEN p_name || ' suplier'
  ELSE replace(replace(replace(p_name, 'widget', 'wdget'), 'anvil', 'anvl'), 'small', 'smalll') END AS text
  FROM m_asked_names"""
_split = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
STEPS["m_occ"] = f"""SELECT id, field, place, word FROM (SELECT id, field, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place
  FROM (SELECT id, field, {_split.format("t")} AS w FROM (
   SELECT id, 0 AS field, label AS t FROM m_docs UNION ALL SELECT id, 1, artist_name FROM m_docs
   UNION ALL SELECT id, 2, album_name_norm FROM m_docs UNION ALL SELECT id, 3, track_name_norm FROM m_docs)
  WHERE t IS NOT NULL)) WHERE word <> ''"""
STEPS["m_qwords"] = f"""SELECT request_id, term, slot, slot = n - 1 AS is_last FROM (SELECT request_id, unnest(w) AS term,
  generate_subscripts(w, 1) - 1 AS slot, len(w) AS n FROM (SELECT request_id, {_split.format("text")} AS w FROM m_typed))"""
STEPS["m_expand"] = """SELECT term, is_last, word, CASE WHEN is_last AND starts_with(word, term) THEN 0
   ELSE levenshtein(term, word) END AS typos, term = word AS exact
  FROM (SELECT DISTINCT term, is_last FROM m_qwords), (SELECT DISTINCT word FROM m_occ)
  WHERE levenshtein(term, word) <= CASE WHEN length(term) >= 9 THEN 2 WHEN length(term) >= 5 THEN 1 ELSE 0 END
   OR (is_last AND starts_with(word, term))"""
STEPS["m_hits"] = """SELECT q.request_id, o.id, q.slot, o.field, o.place, e.typos, e.exact FROM m_qwords q
  JOIN m_expand e ON e.term = q.term AND e.is_last = q.is_last JOIN m_occ o ON o.word = e.word"""
STEPS["m_slots"] = """SELECT request_id, id, slot, min(typos) AS typos, bool_or(exact) AS exact,
  row_number() OVER (PARTITION BY request_id, id ORDER BY slot) - 1 = slot AS leads FROM m_hits GROUP BY 1, 2, 3"""
STEPS["m_matched"] = """SELECT request_id, id, count(*) AS matched, sum(typos) AS typos, sum(exact::INT) AS exact
  FROM m_slots WHERE leads GROUP BY 1, 2"""
STEPS["m_span"] = """SELECT request_id, id, sum(gap) AS span FROM (SELECT l.request_id, l.id, l.slot, min(CASE
   WHEN l.field = r.field THEN least(abs(r.place - l.place) + (r.place < l.place)::INT, 8) ELSE 8 END) AS gap
  FROM m_hits l JOIN m_hits r ON r.request_id = l.request_id AND r.id = l.id AND r.slot = l.slot + 1
  JOIN m_matched m ON m.request_id = l.request_id AND m.id = l.id AND r.slot < m.matched GROUP BY 1, 2, 3) GROUP BY 1, 2"""
STEPS["m_field"] = """SELECT h.request_id, h.id, min(h.field) AS field FROM m_hits h
  JOIN m_matched m ON m.request_id = h.request_id AND m.id = h.id AND h.slot < m.matched GROUP BY 1, 2"""
STEPS["m_scores"] = """SELECT request_id, id, matched::INT AS matched, typos::INT AS typos, coalesce(span, 0)::INT AS span,
  field::INT AS field, exact::INT AS exact FROM m_matched LEFT JOIN m_span USING (request_id, id)
  JOIN m_field USING (request_id, id)"""
STEPS["m_ranked"] = """SELECT * FROM (SELECT s.request_id, d.*, row_number() OVER (PARTITION BY request_id ORDER BY matched DESC,
  typos, span, d.logcount DESC, field, exact DESC, d.id) AS rank FROM m_scores s JOIN m_docs d USING (id)) WHERE rank <= 10"""

# tiles
STEPS["m_world"] = """SELECT *, (lon + 180.0) / 360.0 AS wx,
  0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi()) AS wy FROM m_placed"""
_case = lambda values: "CASE entity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
STEPS["m_tiles"] = f"""SELECT layer, z::INT AS z, least(greatest(floor(wx * pow(2, z)), 0), pow(2, z) - 1)::INT AS x,
  least(greatest(floor(wy * pow(2, z)), 0), pow(2, z) - 1)::INT AS y, rowid FROM
  (SELECT entity AS layer, *, unnest(range(5, {q.MAX_ZOOM + 1})) AS z, {_case(q.BASE_ZOOMS)} AS base,
   {_case({"track": 1.8, "label": 2.05, "album": 2.27, "artist": 2.36})} AS rate,
   {_uniform(f"'{q.SEED}'", "entity", "rowid")} AS u FROM m_world) WHERE z >= base OR u < pow(rate, z - base)"""
STEPS["m_tile_sizes"] = """SELECT z AS zoom_level, x AS tile_column, (pow(2, z)::BIGINT - 1 - y)::INT AS tile_row,
  count(*) AS size FROM m_tiles GROUP BY z, x, y"""


ORACLES: dict[str, str] = {}

ORACLES["interaction_scan"] = "SELECT * FROM m_usable"
ORACLES["vocab_min_count"] = "SELECT * FROM m_t0"
ORACLES["vocab_stats"] = """SELECT count(*) AS vocab_size, sum(playlist_count)::BIGINT AS total_count,
  min(playlist_count) AS min_count, round(quantile_cont(playlist_count, 0.5), 6) AS median,
  round(quantile_cont(playlist_count, 0.95), 6) AS p95, round(quantile_cont(playlist_count, 0.99), 6) AS p99,
  round(avg(playlist_count), 6) AS mean, max(playlist_count) AS max_count FROM m_t0"""
ORACLES["vocab_rethreshold"] = f"""SELECT track_rowid, (row_number() OVER (ORDER BY track_rowid) - 1)::INT AS track_id,
  playlist_count FROM m_t0 WHERE playlist_count >= {2 * S.min_count}"""
ORACLES["playlist_slice_skip"] = f"SELECT playlist_rowid, idx - {q.SLICE} AS idx FROM m_indexed WHERE idx >= {q.SLICE}"
ORACLES["playlist_slice_last"] = f"SELECT playlist_rowid, idx - (n - {q.SLICE}) AS idx FROM m_indexed WHERE idx >= n - {q.SLICE}"
ORACLES["chunk_rows"] = "SELECT * FROM m_chunks"
ORACLES["export_chunk_rows"] = "SELECT * FROM m_chunks"
ORACLES["export_commit"] = """SELECT 'parquet' AS kind, 'track_rowid,track_id,playlist_count' AS columns,
  (SELECT count(*) FROM m_t0) AS "rows", true AS has_bytes"""
ORACLES["export_enriched"] = "SELECT * FROM m_t1"
ORACLES["chunk_export"] = "SELECT chunk_id, count(*) AS n, count(DISTINCT playlist_rowid) AS playlists FROM m_chunks GROUP BY 1"
ORACLES["chunk_manifest"] = f"""SELECT ceil(total_playlists / {q.CHUNK_SIZE})::BIGINT AS total_chunks,
  {q.CHUNK_SIZE} AS playlists_per_chunk, total_playlists, -{q.SLICE} AS "offset",
  'playlist_rowid,track_rowid,position,added_at,added_by_id' AS columns,
  'is_episode=0, is_local=0, track_rowid IS NOT NULL' AS filters
  FROM (SELECT least(count(*), {q.SLICE}) AS total_playlists FROM m_playlists)"""
ORACLES["chunked_counts"] = """SELECT track_rowid, sum(n)::INT AS playlist_count FROM
  (SELECT chunk_id, track_rowid, count(DISTINCT playlist_rowid) AS n FROM m_chunks GROUP BY 1, 2) GROUP BY 1"""
ORACLES["chunk_split"] = f"""SELECT chunk_id, r > n - greatest(1, floor(n * 0.2)) AS is_valid FROM (SELECT chunk_id,
  row_number() OVER (ORDER BY {_uniform(f"'{q.SEED}'", "chunk_id")}, chunk_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT chunk_id FROM m_chunks))"""
ORACLES["primary_artists"] = "SELECT * FROM m_pa"
ORACLES["primary_genres"] = "SELECT * FROM m_pg"
ORACLES["label_dictionary"] = """SELECT label, row_number() OVER (ORDER BY label)::INT AS label_rowid
  FROM (SELECT DISTINCT label FROM m_albums WHERE label <> '')"""
ORACLES["enriched_vocab"] = "SELECT * FROM m_t1"
ORACLES["key_coverage"] = """WITH f AS (SELECT track_rowid FROM m_inter WHERE position = 1)
  SELECT 'duplicate' AS problem, track_rowid FROM f GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'missing', track_rowid FROM m_t0 WHERE track_rowid NOT IN (FROM f)
  UNION ALL SELECT DISTINCT 'extra', track_rowid FROM f WHERE track_rowid NOT IN (SELECT track_rowid FROM m_t0)"""
ORACLES["coverage_counts"] = """SELECT left_rows, right_rows, left_rows = right_rows AS ok FROM
  (SELECT count(*) AS left_rows FROM m_t0), (SELECT count(*) AS right_rows FROM m_t1)"""
ORACLES["valid_tracks"] = "SELECT * FROM m_valid"
ORACLES["group_threshold"] = f"""SELECT track_rowid, artist_rowid FROM
  (SELECT *, count(*) OVER (PARTITION BY artist_rowid) AS n FROM m_valid) WHERE n >= {q.GROUP_MIN}"""
ORACLES["popularity_track"] = "SELECT track_rowid, round(log10(playlist_count)::FLOAT::DOUBLE, 4) AS logcount FROM m_valid"
_distinct = {
    "album": "", "artist": ", count(DISTINCT album_rowid)::INT AS nalbum",
    "label": ", count(DISTINCT album_rowid)::INT AS nalbum, count(DISTINCT artist_rowid)::INT AS nartist",
}
for _n in q.PARENTS:
    _e = BY_NAME[_n]
    ORACLES[f"popularity_{_n}"] = f"""SELECT {_e.key}, round(log10(sum(playlist_count))::FLOAT::DOUBLE, 4) AS logcount,
  count(*)::INT AS ntrack{_distinct[_n]} FROM m_valid GROUP BY 1 HAVING count(*) >= {q.GROUP_MIN}"""
    ORACLES[f"pooled_vectors_{_n}"] = f"""SELECT {_e.key}, i::INT AS i, round(v::DOUBLE, 5) AS value
  FROM m_vec_{_n} WHERE members >= {q.GROUP_MIN}"""
ORACLES["track_metadata"] = "SELECT * FROM m_meta"
for _e in ENTITIES:
    ORACLES[f"lookup_{_e.name}"] = f"SELECT * REPLACE (round(logcount::DOUBLE, 4) AS logcount) FROM m_lk_{_e.name}"
    ORACLES[f"unit_vectors_{_e.name}"] = f"SELECT {_e.key}, i::INT AS i, round(v::DOUBLE, 5) AS value FROM m_unit_{_e.name}"
    ORACLES[f"recable_ids_{_e.name}"] = f"SELECT {_e.key} FROM {TABLE[_e.name]} WHERE recable"
ORACLES["ordered_embeddings"] = """SELECT row_number() OVER (ORDER BY track_rowid) - 1 AS place, track_rowid,
  round(v::DOUBLE, 5) AS e0 FROM m_unit_track JOIN m_tracks_f USING (track_rowid) WHERE i = 0 AND recable"""
ORACLES["wide_vectors"] = (
    "SELECT track_rowid, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 5) AS e{i}" for i in range(64))
    + " FROM m_ckpt WHERE track_rowid IN (SELECT track_rowid FROM m_valid)"
)
ORACLES["wide_vectors_regathered"] = "SELECT track_rowid, i::INT AS i, round(v::DOUBLE, 5) AS value FROM m_vec_track"
ORACLES["vocab_remap"] = "SELECT playlist_rowid, position, track_rowid, track_id FROM m_remap"
_keep = f"least(1.0, sqrt({q.SUB_THRESHOLD} / (playlist_count / (SELECT sum(playlist_count)::DOUBLE FROM m_t0))))"
ORACLES["keep_probabilities"] = f"SELECT track_rowid, track_id, round({_keep}, 6) AS keep FROM m_t0"
_row_draw = _uniform(f"'{q.SEED}'", "0", "playlist_rowid", "position", "track_rowid")
ORACLES["subsampled_rows"] = f"SELECT playlist_rowid, position, track_rowid, track_id FROM m_remap WHERE {_row_draw} < {_keep}"
ORACLES["skipgram_pairs"] = "SELECT * FROM m_pairs"
ORACLES["shuffled_pairs"] = "SELECT center, context FROM m_pairs"
ORACLES["noise_weights"] = "SELECT track_id, " + _round(["weight", "low", "high"], 7) + " FROM m_cdf"
ORACLES["negative_samples"] = "SELECT playlist_rowid, pos, k, draw, negative FROM m_negatives"
_vec = "(SELECT track_id, embedding::DOUBLE[] AS v FROM m_ckpt JOIN m_trained USING (track_rowid))"
_out = "(SELECT track_id, list_reverse(embedding::DOUBLE[]) AS v FROM m_ckpt JOIN m_trained USING (track_rowid))"
_ls = lambda x: f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"
ORACLES["sgns_loss"] = f"""SELECT count(*) AS pairs, round(-(sum({_ls("s")}) + (SELECT sum({_ls("-s")}) FROM
   (SELECT list_inner_product(c.v, o.v) AS s FROM m_negatives_trained n JOIN {_vec} c ON c.track_id = n.center
    JOIN {_out} o ON o.track_id = n.negative))) / count(*), 6) AS loss FROM
  (SELECT list_inner_product(c.v, o.v) AS s FROM m_pairs_trained p JOIN {_vec} c ON c.track_id = p.center
   JOIN {_out} o ON o.track_id = p.context)"""
ORACLES["shifted_pmi"] = f"""SELECT center, context, round(pmi, 6) AS pmi FROM (SELECT center, context,
  ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY center) * sum(n) OVER (PARTITION BY context))) - ln({q.NEGATIVES}) AS pmi
  FROM (SELECT center, context, count(*)::DOUBLE AS n FROM m_pairs GROUP BY 1, 2)) WHERE pmi > 0"""
ORACLES["fitted_vectors"] = """SELECT DISTINCT center AS track_id, 'in' AS side, 16 AS dim, true AS finite FROM m_pairs
  UNION ALL SELECT DISTINCT context, 'out', 16, true FROM m_pairs"""
ORACLES["normalized_titles"] = f"SELECT track_rowid, {_title('name')} AS title FROM m_tracks"
ORACLES["album_canonical"] = "SELECT album_rowid, album_canonical_rowid FROM m_albums_f"
ORACLES["track_canonical"] = "SELECT track_rowid, track_canonical_rowid FROM m_tracks_f"

_FLOATS = {"logcount", "lon", "lat", "score"} | {
    f"{p}_{c}" for p in ("artist", "album", "label") for c in ("lon", "lat", "logcount")
}


def _columns(names, alias: str = "") -> str:
    return ", ".join(f"round({alias}{c}::DOUBLE, 4) AS {c}" if c in _FLOATS else f"{alias}{c}" for c in names)


_serving = {
    "track": catalog.TRACK_COLUMNS, "album": catalog.ALBUM_COLUMNS, "artist": catalog.ARTIST_COLUMNS,
    "label": catalog.LABEL_COLUMNS,
}
for _e in ENTITIES:
    _n = _e.name
    _extra = ("searchable", "recable") + (("nrepr",) if _n != "track" else ())
    ORACLES[f"serving_{_n}"] = f"SELECT {_columns(_serving[_n] + _extra)} FROM {TABLE[_n]}"
    ORACLES[f"info_{_n}"] = f"SELECT '{_n}' AS entity_type, {_e.key}::BIGINT AS rowid, {_columns(INFO_COLUMNS[_n])} FROM {TABLE[_n]}"
    _key = f"{_e.key}::BIGINT AS rowid"
    ORACLES[f"geojson_{_n}"] = f"""SELECT {_key}, 'Feature' AS type, 'Point' AS shape, {_columns(["lon", "lat"])},
  {_e.key}::BIGINT AS key, {_columns(["logcount"])} FROM {TABLE[_n]}"""
    _diverse = _n in ("track", "album")
    _depth = "101" if _diverse else "CASE WHEN f.popfloor > 0 THEN 101 ELSE 6 END"
    _artist = "row_number() OVER (PARTITION BY query_id, t.artist_rowid ORDER BY rank)" if _diverse else "1"
    for _query, _found in (("recommend", "m_near"), ("recommend_indexed", "m_listed")):
        ORACLES[f"{_query}_{_n}"] = f"""SELECT query_id AS seed_rowid, popfloor, (place - 1)::INT AS position,
  '{_n}' AS entity_type, neighbor_id AS rowid, {_columns(RECOMMEND_COLUMNS[_n])}, round(score, 4) AS simscore FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM
   (SELECT k.*, f.popfloor, t.*, {_artist} AS a FROM {_found}_{_n} k
    JOIN m_floors f ON f.entity = '{_n}' AND f.rowid = k.query_id JOIN {TABLE[_n]} t ON t.{_e.key} = k.neighbor_id
    WHERE k.rank <= {_depth} AND neighbor_id <> query_id AND t.logcount > f.popfloor) WHERE a = 1) WHERE place <= 5"""
for _n in q.PARENTS:
    _e, _c = BY_NAME[_n], BY_NAME[BY_NAME[_n].repr_child]
    ORACLES[f"representatives_{_n}"] = f"""SELECT r.{_e.key}::BIGINT AS parent_rowid, rank, '{_c.name}' AS entity_type,
  c.{_c.key}::BIGINT AS rowid, {_columns(CHILD_COLUMNS[_c.name], "c.")} FROM {REPR[_n]} r
  JOIN {TABLE[_c.name]} c ON c.{_c.key} = r.{_c.key} WHERE rank < 2"""
    ORACLES[f"panel_{_n}"] = f"""SELECT '{_n}' AS entity_type, p.{_e.key}::BIGINT AS rowid, {_columns(INFO_COLUMNS[_n])},
  coalesce(children, '') AS children FROM {TABLE[_n]} p LEFT JOIN (SELECT r.{_e.key},
   string_agg(c.{_c.key} || ':' || c.{_c.title}, '|' ORDER BY rank) AS children FROM {REPR[_n]} r
   JOIN {TABLE[_c.name]} c ON c.{_c.key} = r.{_c.key} GROUP BY 1) USING ({_e.key})"""
ORACLES["panel_track"] = ORACLES["info_track"].replace(" FROM", ", '' AS children FROM")
ORACLES["flag_totals"] = " UNION ALL ".join(
    f"SELECT '{e.table}' AS entity, count(*) AS total, count_if(searchable)::BIGINT AS searchable, count_if(recable)::BIGINT AS recable FROM {TABLE[e.name]}"
    for e in ENTITIES
)
ORACLES["required_columns"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS entity, '{c}' AS "column", count_if({c} IS NULL OR trim({c}::VARCHAR) = '')::BIGINT AS blanks FROM m_{t}_f"""
    for t, columns in (("albums", catalog.REQUIRED_ALBUM), ("tracks", catalog.REQUIRED_TRACK)) for c in columns
)
ORACLES["album_repr_tracks"] = f"SELECT album_rowid, rank, track_rowid, {_columns(['score'])} FROM m_album_repr"
ORACLES["album_scores"] = "SELECT album_canonical_rowid, round(score, 4) AS score FROM m_album_scores"
ORACLES["artist_repr_albums"] = f"SELECT artist_rowid, rank, album_rowid, {_columns(['score'])} FROM m_artist_repr"
ORACLES["damped_scores"] = f"SELECT label_rowid, artist_rowid, round(score, 4) AS score FROM ({_damped('searchable')})"
ORACLES["label_repr_artists"] = f"SELECT label_rowid, rank, artist_rowid, {_columns(['score'])} FROM m_label_repr"
ORACLES["repr_counts"] = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, {BY_NAME[n].key}::BIGINT AS rowid, nrepr FROM {TABLE[n]}" for n in q.PARENTS
)
ORACLES["repr_coverage"] = " UNION ALL ".join(
    f"SELECT '{BY_NAME[n].table}' AS entity, count(*) AS total, count_if(nrepr > 0)::BIGINT AS with_repr FROM {TABLE[n]}"
    for n in q.PARENTS
)


def _guarantees() -> str:
    rows = []

    def add(name: str, count: str, acceptable: bool = False) -> None:
        rows.append(f"SELECT '{name}' AS n, {str(acceptable).lower()} AS a, ({count}) AS v")

    def outside(a: str, b: str, key: str, where: str = "true") -> str:
        return f"SELECT count(DISTINCT {key}) FROM {a} WHERE {key} NOT IN (SELECT {key} FROM {b} WHERE {where})"

    for column, e, tolerated in NAME_COLUMNS:
        add(f"no blanks in {e.table}.{column}", f"SELECT count(*) FROM {TABLE[e.name]} WHERE {column} = ''", tolerated)
    for e in ENTITIES:
        for p in (BY_NAME[n] for n in e.parents):
            add(f"{e.table}.{p.key} in {p.table}.{p.key}", outside(TABLE[e.name], TABLE[p.name], p.key))
            add(f"{p.table}.{p.key} in {e.table}.{p.key}", outside(TABLE[p.name], TABLE[e.name], p.key),
                p is ARTIST and e is ALBUM)
    for n in q.PARENTS:
        e, c = BY_NAME[n], BY_NAME[BY_NAME[n].repr_child]
        add(f"{e.repr_table}.{e.key} in {e.table}", outside(REPR[n], TABLE[n], e.key))
        add(f"{e.repr_table}.{c.key} in searchable {c.table}", outside(REPR[n], TABLE[c.name], c.key, "searchable"))
        add(f"{e.table}.nrepr matches {e.repr_table}", f"""SELECT count(*) FROM {TABLE[n]} t WHERE nrepr <>
  (SELECT count(*) FROM {REPR[n]} r WHERE r.{e.key} = t.{e.key})""")
        add(f"{e.repr_table} key is unique",
            f"SELECT count(*) FROM (SELECT 1 FROM {REPR[n]} GROUP BY {e.key}, rank HAVING count(*) > 1)")
    for e in ENTITIES:
        t, u = TABLE[e.name], f"m_unit_{e.name}"
        add(f"{e.embedding}.{e.key} in {e.table}.{e.key}", outside(u, t, e.key))
        add(f"{e.table}.{e.key} in {e.embedding}.{e.key}", outside(t, u, e.key))
        add(f"{e.table}.{e.key} is unique", f"SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {e.key} HAVING count(*) > 1)")
        add(f"{e.table}.{e.canonical_key} exists",
            f"SELECT count(DISTINCT {e.canonical_key}) FROM {t} WHERE {e.canonical_key} NOT IN (SELECT {e.key} FROM {t})")
    add("labels.label is unique", "SELECT count(*) FROM (SELECT 1 FROM m_labels_t GROUP BY label HAVING count(*) > 1)")
    return 'SELECT n AS "check", v = 0 AS ok, a AS acceptable, v::BIGINT AS violations FROM (' + " UNION ALL ".join(rows) + ")"


ORACLES["guarantee_report"] = _guarantees()
ORACLES["recommend_not_diverse"] = """SELECT query_id AS seed_rowid, (place - 1)::INT AS position, neighbor_id AS rowid,
  round(score, 4) AS simscore FROM (SELECT k.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
   FROM m_near_track k JOIN m_tracks_f t ON t.track_rowid = k.neighbor_id
   WHERE rank <= 61 AND neighbor_id <> query_id AND t.logcount > 1.25) WHERE place <= 3"""
ORACLES["recommend_status"] = """SELECT r.track_rowid AS rowid, CASE WHEN l.id IS NULL THEN 'missing' WHEN n IS NULL THEN 'empty'
  ELSE 'ok' END AS status, coalesce(n, 0) AS n FROM m_tracks r LEFT JOIN m_list_track l ON l.id = r.track_rowid
  LEFT JOIN (SELECT query_id, least(count(DISTINCT t.artist_rowid), 3) AS n FROM m_near_track k
   JOIN m_tracks_f t ON t.track_rowid = k.neighbor_id WHERE rank <= 61 AND neighbor_id <> query_id AND t.logcount > 1.4
   GROUP BY 1) x ON x.query_id = r.track_rowid"""
ORACLES["name_search"] = """SELECT track_rowid, track_name, artist_name FROM m_meta
  WHERE regexp_matches(track_name, '(?i)RED (widget|r.*g)') AND regexp_matches(artist_name, '(?i)r#0+[1-5]')"""
STEPS["m_patterns"] = """SELECT request_id, CASE request_id % 4 WHEN 0 THEN '^' || upper(p_name)
   WHEN 1 THEN substr(p_name, 1, 3) || '.+' || right(p_name, 4) || '( |$)'
   WHEN 2 THEN '^' || substr(p_name, 1, 2) || '.*' || right(p_name, 2) || '$' ELSE '(' || p_name || '|zzz)' END AS query,
  CASE WHEN request_id % 3 = 1 THEN 'R#0+[1-5]' END AS artist FROM m_asked_names"""
STEPS["m_matched_names"] = """SELECT request_id, m.* FROM m_patterns JOIN m_meta m ON regexp_matches(track_name, '(?i)' || query)
   AND (artist IS NULL OR regexp_matches(artist_name, '(?i)' || artist))"""
ORACLES["name_search_requests"] = "SELECT request_id, track_rowid FROM m_matched_names"
_found_near = f"""  near AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, neighbor_id) AS rank FROM
   (SELECT request_id, seed_rowid, b.id AS neighbor_id, {_score} AS score FROM seeds JOIN m_list_track a ON a.id = seed_rowid,
    m_list_track b)),
  named AS (SELECT n.*, m.track_name, m.artist_name, m.track_popularity, row_number() OVER
   (PARTITION BY request_id, artist_name ORDER BY rank) AS a FROM near n JOIN m_meta m ON m.track_rowid = n.neighbor_id
   WHERE rank <= 251 AND neighbor_id <> seed_rowid)
  SELECT request_id, seed_rowid, (p - 1)::INT AS position, neighbor_id AS track_rowid, track_name, artist_name,
  track_popularity, round(score, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank)
  AS p FROM named WHERE a = 1) WHERE p <= 5"""
ORACLES["find_neighbours"] = f"""WITH asked AS (SELECT request_id, substr(p_name, 1, length(p_name) - 1) AS query,
   CASE WHEN request_id % 2 = 1 THEN (request_id % 10)::VARCHAR END AS artist FROM m_asked_names),
  seeds AS (SELECT request_id, track_rowid AS seed_rowid FROM (SELECT *, row_number() OVER (PARTITION BY request_id
   ORDER BY track_popularity DESC, track_rowid) AS n FROM asked JOIN m_meta ON contains(lower(track_name), query)
   AND (artist IS NULL OR contains(lower(artist_name), artist))) WHERE n = 1),
{_found_near}"""
ORACLES["find_neighbours_pattern"] = f"""WITH seeds AS (SELECT request_id, track_rowid AS seed_rowid FROM (SELECT *, row_number() OVER (PARTITION BY request_id
   ORDER BY track_popularity DESC, track_rowid) AS n FROM m_matched_names) WHERE n = 1),
{_found_near}"""
_doc = ("id", "label", "artist_name", "album_name_norm", "track_name_norm", "logcount", "lon", "lat")
ORACLES["search_documents"] = ORACLES["export_search_documents"] = f"SELECT {_columns(_doc)} FROM m_docs"
for _e in ENTITIES:
    ORACLES[f"export_embedding_{_e.name}"] = ORACLES[f"unit_vectors_{_e.name}"]
    ORACLES[f"export_geojson_{_e.name}"] = f"""SELECT {_e.key}::BIGINT AS rowid, {_columns(["lon", "lat", "logcount"])}
  FROM {TABLE[_e.name]}"""
ORACLES["search_scores"] = "SELECT * FROM m_scores"
ORACLES["search_rarest_words"] = """WITH freq AS (SELECT word, count(DISTINCT id) AS docs FROM m_occ GROUP BY 1),
  sized AS (SELECT request_id, slot, q.term, coalesce(sum(docs), 0) AS docs FROM m_qwords q
   LEFT JOIN m_expand e ON e.term = q.term AND e.is_last = q.is_last LEFT JOIN freq USING (word) GROUP BY 1, 2, 3),
  placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY docs, slot) AS n FROM sized)
  SELECT request_id, term, docs::BIGINT AS docs FROM placed WHERE n = 1 AND docs > 0"""
_fold = lambda x: f"lower(replace(trim({x}), 'ß', 'ss'))"
ORACLES["search_hits"] = ORACLES["search_hits_rarest_first"] = f"""SELECT request_id, rank::INT AS rank, entity_type, rowid, {_columns(_doc[1:])} FROM (SELECT *,
  row_number() OVER (PARTITION BY request_id, entity_type, {_fold("coalesce(track_name_norm, album_name_norm, artist_name, label)")},
  CASE WHEN entity_type IN ('track', 'album') THEN {_fold("artist_name")} END ORDER BY rank) AS n FROM
  (SELECT *, split_part(id, '_', 1) AS entity_type, split_part(id, '_', 2)::BIGINT AS rowid FROM m_ranked)) WHERE n = 1"""
ORACLES["query_base_split"] = "SELECT id AS track_rowid, CASE WHEN is_query THEN 'query' ELSE 'base' END AS part FROM m_drawn"
for _n in ("exact_knn", "exact_knn_lists", "list_search_all"):
    ORACLES[_n] = "SELECT query_id, neighbor_id, round(score, 4) AS score, rank FROM m_knn"
ORACLES["list_search"] = f"""SELECT query_id, neighbor_id, round(score, 4) AS score, rank
  FROM ({_searched("m_knn_queries", "m_cents_16", "m_lists_16", 4)}) WHERE rank <= 10"""
ORACLES["list_recall"] = " UNION ALL ".join(
    f"""SELECT {n} AS nprobe, round(count(*) FILTER (f.rank = 1 AND t.rank = 1) / 50, 4) AS r1,
  round(count(*) FILTER (t.rank <= 10) / 500, 4) AS r10, round(count(*) FILTER (t.rank <= 10) / 500, 4) AS r100,
  round(1 - count(*) / 500, 4) AS missing FROM ({_searched("m_knn_queries", "m_cents_32", "m_lists_32", n)}) f
  LEFT JOIN m_knn t USING (query_id, neighbor_id) WHERE f.rank <= 10"""
    for n in (1, 4, 16)
)
STEPS["m_longer"] = """SELECT id, list_transform(v, lambda x: x * pow(2.0, -(id % 13) / 3)) AS v FROM m_knn_base"""
ORACLES["exact_knn_lengths"] = f"""SELECT query_id, neighbor_id, round(score, 4) AS score, rank::INT AS rank FROM
  (SELECT a.id AS query_id, b.id AS neighbor_id, {_score} AS score,
   row_number() OVER (PARTITION BY a.id ORDER BY {_score} DESC, b.id) AS rank FROM m_knn_queries a, m_longer b) WHERE rank <= 10"""
ORACLES["list_counts"] = " UNION ALL ".join(
    f"""SELECT '{e.name}' AS entity, n, least(greatest(floor(4 * sqrt(n)), 256), 16384)::INT AS nlist,
  least(n, 64 * least(greatest(floor(4 * sqrt(n)), 256), 16384)::BIGINT) AS train
  FROM (SELECT count(*) AS n FROM {TABLE[e.name]} WHERE recable)"""
    for e in ENTITIES
)
ORACLES["projections_union"] = "SELECT entity, rowid, " + _round(["umap_x", "umap_y"], 5) + " FROM m_xy"
ORACLES["geo_lonlat"] = "SELECT entity, rowid, " + _round(["lon", "lat"]) + " FROM m_geo"
_bin = lambda v: f"least(greatest(floor(({v}::DOUBLE - {v}0) / ({v}1 - {v}0) * {q.BINS}), 0), {q.BINS - 1})::INT"
ORACLES["density_bins"] = f"""SELECT {_bin("x")} AS xi, {_bin("y")} AS yi, count(*) AS n FROM
  (SELECT umap_x AS x, umap_y AS y FROM m_xy_track), (SELECT min(umap_x)::DOUBLE AS x0, max(umap_x)::DOUBLE AS x1,
   min(umap_y)::DOUBLE AS y0, max(umap_y)::DOUBLE AS y1 FROM m_xy_track) GROUP BY 1, 2"""
ORACLES["coordinate_summary"] = " UNION ALL ".join(
    f"""SELECT '{a}' AS axis, round(min(v), 6) AS low, round(max(v), 6) AS high, round(max(v) - min(v), 6) AS extent,
  round((max(v) + min(v)) / 2, 6) AS center, round(stddev_pop(v), 6) AS std, count(*) AS points
  FROM (SELECT umap_{a}::DOUBLE AS v FROM m_xy_track)"""
    for a in "xy"
)
_points = """(SELECT p.rowid AS track_rowid, p.umap_x, p.umap_y, log10(v.playlist_count)::FLOAT AS logcount, m.artist_name,
  m.track_name FROM m_xy_track p LEFT JOIN m_valid v ON v.track_rowid = p.rowid
  LEFT JOIN m_meta m ON m.track_rowid = p.rowid)"""
ORACLES["named_points"] = f"SELECT track_rowid, {_round(['umap_x', 'umap_y', 'logcount'])}, artist_name, track_name FROM {_points}"
ORACLES["highlights"] = f"""SELECT artist, track, track_rowid IS NOT NULL AS found, track_rowid,
  {_round(["logcount", "umap_x", "umap_y"])} FROM (SELECT w.*, p.*, row_number() OVER (PARTITION BY artist, track
   ORDER BY logcount DESC, track_rowid) AS n FROM (SELECT DISTINCT upper(a.name) AS artist, upper(t.name) AS track
    FROM m_tracks t JOIN m_pa USING (track_rowid) JOIN m_artists a USING (artist_rowid)) w
   LEFT JOIN {_points} p ON lower(artist) = lower(artist_name) AND lower(track) = lower(track_name)) WHERE n = 1"""
ORACLES["top_by_popularity"] = """SELECT track_rowid, round(log10(playlist_count)::FLOAT::DOUBLE, 4) AS logcount FROM m_valid
  ORDER BY log10(playlist_count)::FLOAT DESC, track_rowid LIMIT 100"""
ORACLES["tile_points"] = "SELECT layer, z, x, y, rowid FROM m_tiles"
ORACLES["tile_sizes"] = "SELECT * FROM m_tile_sizes"
ORACLES["tile_size_stats"] = """SELECT s.*, b.* FROM (SELECT count(*) AS tiles, sum(size)::BIGINT AS total_size,
   round(avg(size), 4) AS mean_size, max(size) AS max_size FROM m_tile_sizes) s,
  (SELECT zoom_level AS max_zoom, tile_column AS max_x, pow(2, zoom_level)::BIGINT - 1 - tile_row AS max_y
   FROM m_tile_sizes ORDER BY size DESC, zoom_level DESC, tile_column DESC, tile_row DESC LIMIT 1) b"""
_px = 512 * (1 << q.PICK_ZOOM)
ORACLES["pick_features"] = f"""SELECT click_id, entity, rowid, round(logcount, 4) AS logcount FROM (SELECT c.rowid AS click_id,
  f.entity, f.rowid, f.logcount, row_number() OVER (PARTITION BY c.rowid ORDER BY f.logcount DESC, f.entity, f.rowid) AS n
  FROM (SELECT * FROM m_world WHERE entity = 'artist') c JOIN m_world f
  ON pow(c.wx * {_px} - f.wx * {_px}, 2) + pow(c.wy * {_px} - f.wy * {_px}, 2) <= {q.PICK_RADIUS**2}) WHERE n = 1"""

ORACLES["pick_features_shown"] = """SELECT click_id, entity, rowid, round(logcount, 4) AS logcount FROM (SELECT c.rowid AS click_id,
  f.entity, f.rowid, f.logcount, row_number() OVER (PARTITION BY c.rowid ORDER BY f.logcount DESC, f.entity, f.rowid) AS n
  FROM (SELECT * FROM m_world WHERE entity = 'artist') c
  JOIN (SELECT w.* FROM m_world w JOIN m_tiles t ON t.layer = w.entity AND t.rowid = w.rowid AND t.z = 6) f
  ON pow(c.wx * 32768 - f.wx * 32768, 2) + pow(c.wy * 32768 - f.wy * 32768, 2) <= pow(greatest(11.0, f.logcount), 2)) WHERE n = 1"""
ORACLES["pca_summary"] = """SELECT (SELECT count(DISTINCT track_rowid) FROM m_vec_track) AS n, 0.0::DOUBLE AS mean_x, 0.0::DOUBLE AS mean_y,
  0.0::DOUBLE AS covariance, true AS first_is_widest, true AS wider_than_components, true AS within_total,
  round(sum(v), 4) AS total_variance FROM (SELECT i, var_pop(v::DOUBLE) AS v FROM m_vec_track GROUP BY i)"""


def _human(n: str) -> str:
    def part(unit: str, suffix: str) -> str:
        x = f"{n} / {unit}"
        up = f"CASE WHEN {x} - floor({x}) = 0.25 THEN {x} + 0.05 ELSE {x} END"
        return f"regexp_replace(printf('%.1f', {up}), '\\.0$', '') || '{suffix}'"

    return (
        f"CASE WHEN {n} >= 1e9 THEN {part('1e9', 'B')} WHEN {n} >= 1e6 THEN {part('1e6', 'M')} "
        f"WHEN {n} >= 1e3 THEN {part('1e3', 'K')} ELSE {n}::BIGINT::VARCHAR END"
    )


ORACLES["display_texts"] = f"""SELECT track_rowid, {_human("round(pow(10, artist_logcount * 3))")} || ' playlists' AS artist_text,
  {_human("(track_rowid * 12345)::DOUBLE")} AS human, greatest(floor(artist_logcount + 1 - 2 + 0.5), 0)::INT AS popfloor,
  coalesce(nullif(CASE WHEN track_rowid % 5 > 0 THEN track_name_norm ELSE '' END, ''), '[no track name]') AS shown,
  CASE track_rowid % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS priority FROM m_tracks_f"""
ORACLES["search_ids"] = """SELECT id, split_part(id, '_', 1) AS entity_type, split_part(id, '_', 2)::BIGINT AS rowid,
  lower(coalesce(artist_name, label)) || ' strasse' AS folded FROM m_docs"""
ORACLES["build_tables"] = " UNION ALL ".join(
    [f"SELECT '{BY_NAME[n].repr_table}' AS \"table\", count(*) AS n FROM {REPR[n]}" for n in q.PARENTS]
    + [f"SELECT '{e.table}', count(*) FROM {TABLE[e.name]}" for e in ENTITIES]
    + [f"SELECT '{e.embedding}', count(DISTINCT {e.key}) FROM m_unit_{e.name}" for e in ENTITIES]
)


def _used(sql: str, seen: set[str]) -> set[str]:
    for name in set(re.findall(r"\bm_\w+", sql)) & STEPS.keys():
        if name not in seen:
            seen.add(name)
            _used(STEPS[name], seen)
    return seen


def compose(sql: str) -> str:
    """Prefix a query with the steps it uses, in the order they are defined."""
    used = _used(sql, set())
    steps = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in STEPS.items() if name in used)
    if not steps:
        return sql
    if sql.startswith("WITH "):
        return f"WITH {steps},\n{sql[5:]}"
    return f"WITH {steps}\n{sql}"


def all_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}
