import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas.operators import similarity as sim


def unit(n, d=16, seed=0, hot=0):
    m = np.random.default_rng(seed).normal(size=(n, d))
    m[:hot] = m[0]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id BIGINT, embedding ARRAY<DOUBLE>")


def brute(q, b, k, first=0):
    scores = np.round(q @ b.T, 9)
    out = []
    for i, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        out += [(i, first + j, rank) for rank, j in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(df):
    return rows(df, "query_id", "neighbor_id", "rank")


@pytest.mark.parametrize("limit", [64 << 20, 16 * 8 * 50, 0], ids=["small base", "small queries", "both large"])
def test_exact_neighbours(spark, limit):
    q, b = unit(40, seed=1), unit(300, seed=2)
    got = sim.exact_neighbours(table(spark, q), table(spark, b, 1000).repartition(5), 7, "id", "id", broadcast_bytes=limit)
    assert found(got) == brute(q, b, 7, 1000)


@pytest.mark.parametrize("limit", [64 << 20, 0], ids=["small", "large"])
def test_a_third_equal_vectors(spark, limit):
    """Ties are broken by id and nothing is lost when a third of the base is one vector."""
    q, b = unit(20, seed=3), unit(240, seed=3, hot=80)
    got = sim.exact_neighbours(table(spark, q), table(spark, b, 500), 30, "id", "id", broadcast_bytes=limit)
    assert found(got) == brute(q, b, 30, 500)


def test_fewer_base_rows_than_k(spark):
    q, b = unit(3), unit(4, seed=9)
    for limit in (64 << 20, 0):
        assert found(sim.exact_neighbours(table(spark, q), table(spark, b), 10, "id", "id", limit)) == brute(q, b, 10)


def test_large_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK_CELLS", 64)
    q, b = unit(50, seed=5), unit(400, seed=6, hot=200)
    index = sim.train_index(table(spark, b), "id", nlist=6)
    assert index.sizes.sum() == 400 and index.sizes.max() >= 200
    probes = sim.probe(index, sim._keyed(table(spark, q), "id"), 6)
    got = sim.merge_best(sim._visit(index, probes, 9, block_rows=25), 9)
    assert found(got) == brute(q, b, 9)


def test_list_search(spark):
    b = unit(300, seed=7)
    index = sim.train_index(table(spark, b), "id", nlist=8)
    assert np.allclose(np.linalg.norm(index.centroids, axis=1), 1)
    everything = sim.search(index, table(spark, b), 5, "id", nprobe=8)
    assert found(everything) == brute(b, b, 5)
    nearest = rows(sim.search(index, table(spark, b), 1, "id", nprobe=1), "query_id", "neighbor_id")
    assert all(a == c for a, c in nearest) and len(nearest) == 300


def test_lists_never_outnumber_vectors(spark):
    index = sim.train_index(table(spark, unit(10)), "id")
    assert len(index.centroids) <= 10 and index.sizes.sum() == 10
    assert sim.list_count_for(10) == 256 and sim.list_count_for(10**6) == 4000 and sim.list_count_for(10**9) == 16384
    with pytest.raises(ValueError):
        sim.train_index(table(spark, unit(1)).where("id < 0"), "id")


def test_index_can_be_written_and_opened(spark, tmp_path):
    b = unit(60)
    path = str(tmp_path / "index")
    index = sim.train_index(table(spark, b), "id", nlist=4, path=path)
    opened = sim.open_index(spark, path)
    assert opened.sizes.tolist() == index.sizes.tolist() and opened.sizes.sum() == 60
    assert np.allclose(opened.centroids, index.centroids) and np.allclose(opened.radii, index.radii)
    for either in (index, opened):
        assert found(sim.search(either, table(spark, b), 3, "id", nprobe=4)) == brute(b, b, 3)
        assert found(sim.search_exact(either, table(spark, b), 3, "id", nprobe=1)) == brute(b, b, 3)
    nearest = rows(sim.search(opened, table(spark, b), 1, "id", nprobe=1), "query_id", "neighbor_id")
    assert sorted(nearest) == [(i, i) for i in range(60)]


def test_only_visited_lists_are_read(spark, tmp_path, monkeypatch):
    """A list that no query visits is not opened."""
    monkeypatch.setattr(sim, "BLOCK_ROWS", 10)
    b = unit(200, seed=4, hot=60)
    index = sim.train_index(table(spark, b), "id", nlist=8, path=str(tmp_path / "index"))
    assert len(list((tmp_path / "index" / "lists").glob("list_id=*"))) == (index.sizes > 0).sum()
    probes = sim.probe(index, sim._keyed(table(spark, b[:1]), "id"), 2)
    visited = set(sim.visit_counts(probes))
    assert len(visited) == 2
    before = found(sim.merge_best(sim._visit(index, probes, 3), 3))
    for folder in (tmp_path / "index" / "lists").glob("list_id=*"):
        if int(folder.name.split("=")[1]) not in visited:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")
            for file in folder.glob(".*.crc"):
                file.unlink()
    opened = sim.open_index(spark, str(tmp_path / "index"))
    assert found(sim.merge_best(sim._visit(opened, probes, 3), 3)) == before and len(before) == 3


def spread(n, d=16, seed=0):
    """Vectors whose lengths run over three decades, with zeros and equal ones."""
    m = unit(n, d, seed) * np.random.default_rng(seed + 1).uniform(-3, 0, size=(n, 1)).__rpow__(10.0)
    m[:3], m[3:9] = 0, m[10]
    return m


@pytest.mark.parametrize("k", [1, 7, 60])
def test_unequal_lengths(spark, k):
    q, b = spread(40, seed=11) * 5, spread(300, seed=12)
    got = sim.exact_neighbours(table(spark, q), table(spark, b, 1000).repartition(5), k, "id", "id", broadcast_bytes=0)
    assert found(got) == brute(q, b, k, 1000)


def test_short_vectors_are_not_visited(spark):
    """With unequal lengths the bound of most lists lies below the floor: they are never scored."""
    q, b = unit(30, seed=13), spread(8000, seed=14)
    index = sim.build_index(table(spark, b), "id", sim.sampled_centroids(table(spark, b), "id", 8, 1), bands=8)
    asked = sim._keyed(table(spark, q), "id")
    first = sim.merge_best(sim._visit(index, sim.first_visits(index, asked, 5, 2), 5), 5)
    visits = sim.first_visits(index, asked, 5, 2).count() + sim.open_visits(index, asked, first, 5, 2).count()
    assert visits < 0.5 * 30 * (index.sizes > 0).sum()
    assert found(sim.search_exact(index, table(spark, q), 5, "id", nprobe=2)) == brute(q, b, 5)


def test_single_precision_stays(spark):
    b = table(spark, unit(50)).selectExpr("id", "CAST(embedding AS ARRAY<FLOAT>) AS embedding")
    index = sim.train_index(b, "id", nlist=4)
    assert index.lists.schema["v"].dataType.simpleString() == "array<float>"
    with pytest.raises(ValueError):
        sim.build_index(b, "id", np.ones((sim.MOST_LISTS, 16)), bands=2)


def test_an_index_without_rows_finds_nothing(spark):
    b = table(spark, unit(5))
    index = sim.empty_index(b, "id")
    assert sim.search(index, b, 3, "id", nprobe=2).count() == 0 and sim.search_exact(index, b, 3, "id").count() == 0


def test_sampled_centroids_do_not_depend_on_layout(spark):
    b = table(spark, unit(80, seed=15))
    one, other = (sim.sampled_centroids(b.repartition(n), "id", 5, 3) for n in (1, 7))
    assert one.shape == (5, 16) and (one == other).all()


def test_recall_grows_with_nprobe(spark):
    got = sim.recall_by_nprobe(table(spark, unit(250, seed=8)), "id", 40, 10, (1, 4, 16), nlist=16).orderBy("nprobe").collect()
    assert [r.nprobe for r in got] == [1, 4, 16]
    assert got[-1].r1 == got[-1].r10 == 1.0 and got[-1].missing == 0.0
    assert got[0].r10 <= got[1].r10 <= got[2].r10


def test_recall_figures(spark):
    place = "query_id BIGINT, neighbor_id BIGINT, rank INT"
    truth = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)], place)
    got = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (2, 21, 1)], place)
    r = sim.recall(got, truth, spark.range(2), 2).first()
    assert (r.r1, r.r10, r.r100, r.missing) == (0.5, 0.5, 0.5, 0.25)


def test_scored_tiles_are_small_and_agree(monkeypatch):
    """Ties across tiles go to the lowest id; what leaves a task at once depends on k, not on the rows of a side."""
    draw = np.random.default_rng(5)
    q, b = (draw.integers(-2, 3, (n, 3)).astype(np.float32) for n in (50, 70))
    qid, bid = np.arange(50), draw.permutation(70)
    whole = sim._best(qid, q.astype(float), bid, b.astype(float), 9)
    monkeypatch.setattr(sim, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sim, "QUERY_ROWS", 8)
    parts = list(sim._tile_best(qid, q, bid, b, 9))
    assert max(part.num_rows for part in parts) == 8 * 9
    assert pa.Table.from_batches(parts).to_pydict() == whole.to_pydict()
    assert sim._stored(pa.array([[1.0, 2.0]], pa.list_(pa.float32()))).dtype == np.float32
