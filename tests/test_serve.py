import random
import re
import warnings

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas.operators import patterns, search, serve
from coocatlas.schema import ENTITIES

PLACE = {"lon": 1.0, "lat": 2.0}


@pytest.fixture(scope="module")
def tables(spark):
    parents = {f"{p}_{c}": 0.5 for p in ("artist", "album", "label") for c in ("lon", "lat", "logcount")}

    def track(i, name, artist, artist_name, album, label, logcount):
        return dict(track_rowid=i, track_name_norm=name, artist_rowid=artist, artist_name=artist_name, album_rowid=album,
                    album_name=f"album {album}", album_name_norm=f"album {album}", label_rowid=label, label=f"label {label}",
                    logcount=logcount, release_date="1959-08-17", recable=True, searchable=True, **PLACE, **parents)

    def album(i, name, artist, artist_name, label, logcount, nrepr):
        own = {k: v for k, v in parents.items() if not k.startswith("album")}
        return dict(album_rowid=i, album_name_norm=name, artist_rowid=artist, artist_name=artist_name, label_rowid=label,
                    label=f"label {label}", logcount=logcount, nrepr=nrepr, total_tracks=5, release_date="1959",
                    album_type="album", recable=True, searchable=True, **PLACE, **own)

    miles, herbie = (10, "Miles Davis"), (11, "Herbie Hancock")
    made = {
        "tracks": [track(1, "Blue in Green", *miles, 20, 30, 4.7), track(2, "So What", *miles, 20, 30, 4.5),
                   track(3, "Nefertiti", *miles, 21, 30, 3.9), track(4, "Maiden Voyage", *herbie, 22, 31, 4.1)],
        "albums": [album(20, "kind of blue", *miles, 30, 6.1, 2), album(21, "nefertiti", *miles, 30, 5.2, 1),
                   album(22, "maiden voyage", *herbie, 31, 5.8, 1), album(23, "no repr album", *herbie, 31, 4.8, 0)],
        "artists": [dict(artist_rowid=i, artist_name=n, logcount=c, ntrack=9, nalbum=3, nrepr=r, artist_genre="jazz",
                         recable=True, searchable=True, **PLACE) for i, n, c, r in ((10, "Miles Davis", 7.3, 2), (11, "Herbie Hancock", 6.8, 1))],
        "labels": [dict(label_rowid=i, label=n, logcount=c, ntrack=9, nalbum=3, nartist=2, nrepr=1, recable=True,
                        searchable=True, **PLACE) for i, n, c in ((30, "Columbia", 5.0), (31, "Blue Note", 5.5))],
        "album_repr_tracks": [dict(album_rowid=a, rank=r, track_rowid=t, score=0.5) for a, r, t in ((20, 0, 1), (20, 1, 2), (21, 0, 3))],
        "artist_repr_albums": [dict(artist_rowid=a, rank=r, album_rowid=t, score=0.5) for a, r, t in ((10, 0, 20), (10, 1, 21), (11, 0, 22))],
        "label_repr_artists": [dict(label_rowid=a, rank=r, artist_rowid=t, score=0.5) for a, r, t in ((30, 0, 10), (31, 0, 11))],
    }
    frames = {n: spark.createDataFrame(data) for n, data in made.items()}
    rng = np.random.default_rng(42)
    for name, ids in (("track", [1, 2, 3, 4]), ("album", [20, 21, 22]), ("artist", [10, 11]), ("label", [30, 31])):
        m = rng.standard_normal((len(ids), 128)).astype(np.float32)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        frames[f"{name}_embedding"] = spark.createDataFrame(
            [(i, v.tolist()) for i, v in zip(ids, m)], f"{name}_rowid BIGINT, embedding ARRAY<FLOAT>"
        )
    return frames


def ask(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "rowid BIGINT")


def recommended(spark, tables, name, rowid, **kwargs):
    table = next(e.table for e in ENTITIES if e.name == name)
    got = serve.recommend(tables[table], tables[f"{name}_embedding"], name, ask(spark, rowid), **kwargs)
    return [r.asDict() for r in got.orderBy("position").collect()]


def test_info(spark, tables):
    got = serve.info(tables["artists"], "artist", ask(spark, 10, 999)).collect()
    assert [r.asDict() for r in got] == [dict(
        entity_type="artist", rowid=10, artist_name="Miles Davis", logcount=7.3, ntrack=9, nalbum=3, nrepr=2,
        artist_genre="jazz", **PLACE)]
    for e in ENTITIES:
        assert serve.info(tables[e.table], e.name, tables[e.table].select(F.col(e.key).alias("rowid"))).count() == tables[e.table].count()
    with pytest.raises(ValueError, match="unknown entity"):
        serve.info(tables["artists"], "genre", ask(spark, 1))


def test_representatives(spark, tables):
    got = serve.representatives(tables["album_repr_tracks"], tables["tracks"], "album", ask(spark, 20, 23), 3)
    assert rows(got, "parent_rowid", "rank", "entity_type", "rowid", "track_name_norm") == [
        (20, 0, "track", 1, "Blue in Green"), (20, 1, "track", 2, "So What")]
    assert serve.representatives(tables["album_repr_tracks"], tables["tracks"], "album", ask(spark, 20), 1).count() == 1
    for limit in (0, 4):
        with pytest.raises(ValueError):
            serve.representatives(tables["album_repr_tracks"], tables["tracks"], "album", ask(spark, 20), limit)


def test_panel(spark, tables):
    got = {r.rowid: [(c.rowid, c.entity_type) for c in r.reprs] for r in serve.panel(tables, "album", ask(spark, 20, 23)).collect()}
    assert got == {20: [(1, "track"), (2, "track")], 23: []}
    assert serve.panel(tables, "track", ask(spark, 1)).first().reprs == []
    assert [c.artist_name for c in serve.panel(tables, "label", ask(spark, 30)).first().reprs] == ["Miles Davis"]
    with pytest.raises(ValueError):
        serve.panel(tables, "album", ask(spark, 20), 4)


def test_recommend_record(spark, tables):
    (got,) = recommended(spark, tables, "label", 30, limit=1, diverse=False)
    score = got.pop("simscore")
    assert isinstance(score, float)
    assert got == dict(seed_rowid=30, popfloor=0.0, position=0, entity_type="label", rowid=31, label="Blue Note", logcount=5.5, **PLACE)


def test_recommend_keeps_or_drops_repeated_artists(spark, tables):
    plain = recommended(spark, tables, "album", 20, limit=2, diverse=False)
    assert [r["rowid"] for r in plain] == [21, 22]
    diverse = recommended(spark, tables, "track", 1, limit=3, diverse=True)
    assert len({r["artist_name"] for r in diverse}) == len(diverse) == 2
    assert recommended(spark, tables, "artist", 10, limit=1) == recommended(spark, tables, "artist", 10, limit=1, diverse=False)


def test_recommend_underfills_after_filters(spark, tables):
    assert [r["rowid"] for r in recommended(spark, tables, "album", 20, limit=2, popfloor=5.4)] == [22]
    assert recommended(spark, tables, "artist", 10, limit=1, diverse=False, popfloor=6.8) == []
    got = recommended(spark, tables, "track", 1, limit=3, diverse=False, popfloor=4)
    assert len(got) == 2 and all(r["logcount"] > 4 for r in got)


def test_recommend_fetches_before_filtering(spark, tables):
    """Without filters only limit + 1 neighbours are fetched, the seed among them."""
    assert len(recommended(spark, tables, "track", 1, limit=2, diverse=False)) == 2
    unlisted = dict(tables, tracks=tables["tracks"].withColumn("recable", F.col("track_rowid") != 1))
    assert len(recommended(spark, unlisted, "track", 1, limit=2, diverse=False)) == 2


def test_recommend_arguments(spark, tables):
    for bad in (dict(limit=0), dict(limit=51), dict(popfloor=-1)):
        with pytest.raises(ValueError):
            recommended(spark, tables, "track", 1, **bad)


def test_recommend_status(spark, tables):
    asked = ask(spark, 10, 999)
    got = serve.recommend(tables["artists"], tables["artist_embedding"], "artist", asked, limit=1, popfloor=6.8)
    assert rows(serve.recommend_status(asked, tables["artist_embedding"], got, "artist")) == [(10, "empty", 0), (999, "missing", 0)]


def test_per_request_floors(spark, tables):
    asked = spark.createDataFrame([(10, 0), (10, 7), (11, 7)], "rowid BIGINT, popfloor INT")
    got = serve.recommend(tables["artists"], tables["artist_embedding"], "artist", asked, limit=1)
    assert rows(got, "seed_rowid", "popfloor", "rowid") == [(10, 0.0, 11), (11, 7.0, 10)]


def test_recommend_through_an_index(spark, tables):
    from coocatlas.operators.similarity import train_index

    index = train_index(tables["track_embedding"], "track_rowid", nlist=2)
    got = serve.recommend(tables["tracks"], tables["track_embedding"], "track", ask(spark, 1), limit=3, diverse=False, index=index, nprobe=2)
    assert [r.rowid for r in got.orderBy("position").collect()] == [r["rowid"] for r in recommended(spark, tables, "track", 1, limit=3, diverse=False)]


NAMES = [(1, "Michael", "Red House Painters", 40), (2, "michael jackson", "Fatboy", 60), (3, "Ein Michael?", "Red Band", 10),
         (4, "So (What)", "Miles", 5), (5, None, "Nobody", 1)]


def names(spark):
    return spark.createDataFrame(NAMES, "track_rowid BIGINT, track_name STRING, artist_name STRING, track_popularity INT")


def test_match_names(spark):
    assert rows(serve.match_names(names(spark), "MICHAEL", "red"), "track_rowid") == [(1,), (3,)]
    assert rows(serve.match_names(names(spark), r"^mich.*l$"), "track_rowid") == [(1,)]


def test_contains_matches_equals_plain_contains(spark):
    asked = [(1, "MICHAEL", None), (2, "michael", "RED"), (3, "(", None), (4, "so (w", "miles"), (5, "zzz", None), (6, "l?", None), (7, "ä", None)]
    df = spark.createDataFrame(asked, "request_id INT, query STRING, artist STRING")
    expected = [(r, t) for r, q, a in asked for t, n, ar, _ in NAMES
                if n is not None and q.lower() in n.lower() and (a is None or a.lower() in ar.lower())]
    assert rows(serve.contains_matches(df, names(spark)), "request_id", "track_rowid") == sorted(expected)


PATTERNS = ["michael", "^MICH.*l$", "mi(ch|x)ael", "so \\(w", "l\\?", ".*", "", "a|zzz", "[^x]ich[]a]?", "mich{1,2}ael", "\\bmich", "micha?el",
            "(?i)MICHAEL", "\\Qso (w\\E", "ä", "zzzz", "m.c", "ich+ael", "[a-m]ich"]


def test_pattern_matches_equal_the_plain_test(spark):
    valid = [p for p in PATTERNS if "[]" not in p]
    asked = [(i, p, a) for i, (p, a) in enumerate((p, a) for p in valid for a in (None, "RED$|miles"))] + [(999, None, None)]
    df = spark.createDataFrame(asked, "request_id INT, query STRING, artist STRING")
    expected = []
    for i, pattern, artist in asked:
        if pattern is not None:
            found = serve.match_names(names(spark), pattern, artist)
            expected += [(i, r.track_rowid) for r in found.collect()]
    assert rows(patterns.pattern_matches(df, names(spark)), "request_id", "track_rowid") == sorted(expected, key=repr)
    pieces = patterns.name_pieces(names(spark))
    again = patterns.pattern_matches(df, names(spark), pieces, patterns.piece_counts(pieces))
    assert rows(again, "request_id", "track_rowid") == sorted(expected, key=repr)


def test_required_runs_are_necessary():
    assert patterns.required_runs("RED (widget|r.*g)s") == ["red ", "s"]
    assert patterns.required_runs("ab+c?d\\.e[xy]f") == ["ab", "d.e", "f"]
    assert patterns.required_runs("one|two") == [] and patterns.required_runs("[]a]one") == []
    draw = random.Random(4)
    parts = ["a", "b", "ab", "C", "?", "*", "+", ".", "(", ")", "|", "[ab]", "[^a]", "\\.", "\\d", "^", "$", "{2}", "{0,1}", "é", "-"]
    checked = 0
    for _ in range(20_000):
        pattern = "".join(draw.choice(parts) for _ in range(draw.randint(1, 8)))
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("error")
                found = re.compile(pattern, re.I | re.A)
        except (re.error, FutureWarning):
            continue
        text = "".join(draw.choice("abcABC.1é-") for _ in range(draw.randint(0, 12)))
        if found.search(text):
            checked += 1
            assert all(run in text.lower() for run in patterns.required_runs(pattern)), (pattern, text)
    assert checked > 1000


def test_find_neighbours(spark):
    m = np.eye(5)[[0, 0, 0, 1, 2]] + 0.1 * np.random.default_rng(0).normal(size=(5, 5))
    vectors = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(m)], "track_rowid BIGINT, embedding ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(1, "michael", None), (2, "michael", "red")], "request_id INT, query STRING, artist STRING")
    got = serve.find_neighbours(asked, names(spark), vectors, k=2)
    found = rows(got, "request_id", "seed_rowid", "position", "track_rowid")
    assert {(r, s) for r, s, _, _ in found} == {(1, 2), (2, 1)}
    assert {t for r, _, _, t in found if r == 1} == {1, 3} and len(found) == 4


def documents(spark, data):
    return spark.createDataFrame(
        data, "id STRING, label STRING, artist_name STRING, album_name_norm STRING, track_name_norm STRING, logcount DOUBLE, lon DOUBLE, lat DOUBLE")


def test_search_documents(spark, tables):
    got = search.search_documents(tables)
    assert got.columns == ["id", *search.FIELDS, "logcount", "lon", "lat"]
    assert rows(got.where("id = 'album_20'"), "artist_name", "album_name_norm", "track_name_norm") == [("Miles Davis", "kind of blue", None)]
    assert got.count() == 12


def test_search_ranking(spark):
    docs = documents(spark, [
        ("track_1", None, "Miles Davis", None, "Blue in Green", 3.0, 0.0, 0.0),
        ("track_2", None, "Someone", None, "Green and Blue", 5.0, 0.0, 0.0),
        ("track_3", None, "Other", None, "Blue Blue Bleu", 9.0, 0.0, 0.0),
        ("album_4", None, "Miles Davis", "Blue Green", None, 1.0, 0.0, 0.0),
        ("label_5", "Blue Note", None, None, None, 2.0, 0.0, 0.0),
    ])
    asked = spark.createDataFrame([(1, "blue green"), (2, "Miles Davs"), (3, "note"), (4, "not")], "request_id INT, text STRING")
    got = search.search(asked, search.search_index(docs), 20)
    order = {q: [r.rowid for r in got.where(F.col("request_id") == q).orderBy("rank").collect()] for q in range(1, 5)}
    # both words beat one; adjacent beats apart beats reversed; then popularity
    assert order[1] == [4, 1, 2, 3, 5]
    assert order[2] == [1, 4] and order[3] == [5] and order[4] == [5]
    for limit in (0, 21):
        with pytest.raises(ValueError):
            search.search(asked, search.search_index(docs), limit)
    with pytest.raises(Exception, match="must not be empty"):
        search.search(spark.createDataFrame([(1, "")], "request_id INT, text STRING"), search.search_index(docs)).collect()


def test_best_matches_lose_nothing(spark):
    """The first hits from rarest words equal those of scoring every match, whatever the parts and however common a word."""
    rng = np.random.default_rng(5)
    common, rest = ["love", "lovely", "night"], ["".join(rng.choice(list("abcde"), rng.integers(2, 10))) for _ in range(25)]

    def name():
        words = list(rng.choice(rest, rng.integers(0, 3))) + list(rng.choice(common, rng.integers(1, 3)))
        return " ".join(rng.permutation(words))

    docs = documents(spark, [
        (f"track_{i}", None, None if i % 7 == 0 else name(), None, "" if i % 11 == 0 else name(), float(rng.integers(0, 3)), 0.0, 0.0)
        for i in range(300)])
    asked = [" ".join(rng.permutation([*rng.choice(rest, rng.integers(0, 3)), *rng.choice(common, rng.integers(0, 3)), "love"]))
             for _ in range(40)] + ["love", "love love", "lov", "night lovely unheardof", "unheardof love", "...", "n love"]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id INT, text STRING")
    for limit, part in ((1, 50), (2, 50), (10, 10**6), (20, 7)):
        index = search.search_index(docs, part=part)
        expected = search.rank_hits(search.score_matches(requests, index), docs, limit)
        got = search.rank_hits(search.best_matches(requests, index, limit, direct=0 if limit > 1 else 10**9), docs, limit)
        columns = ["request_id", "rank", "id", "matched", "typos", "span", "field", "exact"]
        assert rows(got, *columns) == rows(expected, *columns)
        parts = dict(index.frequencies.select("word", "parts").collect())
        assert (parts["love"] > 1) == (part < 100)


def test_common_words_add_no_candidates(spark):
    docs = documents(spark, [
        (f"track_{i}", None, f"name {i}", None, "the common" + (" zebra" if i % 100 == 0 else ""), 1.0, 0.0, 0.0) for i in range(1000)])
    index = search.search_index(docs)
    phrases = spark.createDataFrame([("the common zebra", True), ("zebra the", True), ("the unheardof", False)], "phrase STRING, whole BOOLEAN")
    terms = spark.createDataFrame([(t, last) for t in ("the", "common", "zebra", "unheardof") for last in (True, False)], "term STRING, is_last BOOLEAN")
    expansion = search.expand_terms(terms, index.spellings, index.prefixes)
    found = search.phrase_candidates(search.rarest_terms(phrases, expansion, index.frequencies), expansion, index)
    assert rows(found.groupBy("phrase").count()) == [("the common zebra", 10), ("zebra the", 10)]
    empty = search.search(spark.createDataFrame([(1, "the")], "request_id INT, text STRING"), search.search_index(docs.limit(0)))
    assert empty.count() == 0


def test_term_expansion_matches_brute_force(spark):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = np.random.default_rng(1)
    make = lambda n: ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(n)]
    words, terms = sorted(set(make(150))), sorted({(t, bool(i % 2)) for i, t in enumerate(make(80))})
    known = spark.createDataFrame([(w,) for w in words], "word STRING")
    asked = spark.createDataFrame(terms, "term STRING, is_last BOOLEAN")
    got = search.expand_terms(asked, search.spellings(known), search.prefixes(known))
    expected = []
    for term, last in terms:
        budget = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
        for word in words:
            d = 0 if last and word.startswith(term) else distance(term, word)
            if d <= budget:
                expected.append((term, last, word, d, term == word))
    assert rows(got) == sorted(expected, key=repr)


def hits(spark, *data):
    return spark.createDataFrame(
        [(1, i, *d) for i, d in enumerate(data, 1)],
        "request_id INT, rank INT, entity_type STRING, rowid BIGINT, label STRING, artist_name STRING, album_name_norm STRING, track_name_norm STRING")


def test_dedup(spark):
    got = search.dedup_hits(hits(
        spark, ("track", 1, None, "CAN", None, "Straße"), ("track", 2, None, " can ", None, " strasse "), ("track", 3, None, "Canal", None, "Straße"),
        ("album", 4, None, "CAN", "Straße", None), ("artist", 5, None, "Can", None, None), ("label", 6, "Can", None, None, None),
        ("label", 7, "CAN", None, None, None)))
    assert rows(got, "rowid") == [(1,), (3,), (4,), (5,), (6,)]
    with pytest.raises(Exception, match="unknown entity type"):
        search.dedup_hits(hits(spark, ("genre", 1, None, None, None, None))).collect()


def test_map_hits_rejects_foreign_ids(spark):
    docs = documents(spark, [("thing_1", None, "x", None, None, 1.0, 0.0, 0.0)]).withColumns({"request_id": F.lit(1), "rank": F.lit(1)})
    with pytest.raises(Exception, match="invalid search id"):
        search.map_hits(docs).collect()
