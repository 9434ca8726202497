"""The search by exact bounds against all pairs."""

import threading

import numpy as np
import pytest

from trackloom.operators import gallery, similarity
from trackloom.session import scratch, written


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def clustered(seed, n=600, clusters=12, dims=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return (centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def awkward(seed):
    """Vectors of zeros, of hardly any length, equal ones, opposite ones and one far cluster with most of the rows."""
    rng = np.random.default_rng(seed)
    some = rng.normal(size=(120, 8))
    return np.concatenate([some, -some[:30], some[:20], np.zeros((15, 8)), some[:10] * 1e-7, some[:10] * 1e-12, 5 + 0.01 * rng.normal(size=(200, 8))]).astype(np.float32)


def all_pairs(q, q_ids, g, g_ids, k, least, earlier):
    unit = lambda x: x.astype(np.float64) / (np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True) + 1e-8)
    s = np.round(unit(q) @ unit(g).T, 9)
    out = {}
    for i, name in enumerate(q_ids):
        rows = [(-s[i, j], other) for j, other in enumerate(g_ids) if (other < name if earlier else other != name) and s[i, j] >= least]
        out[name] = [(other, -x) for x, other in sorted(rows)[:k]]
    return {n: x for n, x in out.items() if x}


def told(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.gallery_id, r.similarity))
    return out


def same(found, expected):
    """Equal up to the last of nine digits, in which products of other shapes may differ."""
    assert set(found) == set(expected)
    for name, rows in expected.items():
        assert len(found[name]) == len(rows)
        for (a, x), (b, y) in zip(found[name], rows, strict=True):
            assert abs(x - y) < 3e-9 and (a == b or any(abs(z - x) < 3e-9 for c, z in found[name] + rows if c != a)), name


@pytest.mark.parametrize("make", [lambda: clustered(1), lambda: np.random.default_rng(2).normal(size=(500, 6)).astype(np.float32), lambda: awkward(3)])
@pytest.mark.parametrize("k, least, earlier", [(5, -2.0, False), (1, 0.3, True), (3, 0.9, False)])
def test_search_equals_all_pairs(spark, make, k, least, earlier):
    x = make()
    rows = frame(spark, x)
    ids = list(range(len(x)))
    same(told(similarity.top_k(rows, rows, k, least, earlier, block=40)), all_pairs(x, ids, x, ids, k, least, earlier))


def test_search_of_other_queries(spark):
    x, q = clustered(4), awkward(5)[:, :8]
    g = np.concatenate([x[:, :8], q[:5]])
    found = similarity.top_k(frame(spark, q, 10_000), frame(spark, g), 4, block=50)
    same(told(found), all_pairs(q, range(10_000, 10_000 + len(q)), g, range(len(g)), 4, -2.0, False))


def test_few_blocks_meet_in_clusters(spark):
    """Of clustered vectors less than a fifth of the products of all pairs is made, those within a query's own cell included."""
    rows = frame(spark, clustered(6, n=1500, clusters=15))
    for earlier, share in ((False, 0.2), (True, 0.2)):
        search = similarity.Search(rows, rows, 3, -2.0, earlier, 50, 1500)
        seeds = search.seeds().cache()
        sizes = search.blocks.selectExpr("cell", "part", "size(rows) as n")
        met = search.pairs(seeds).join(sizes, ["cell", "part"]).selectExpr("sum(size(queries) * n) as n").first()[0] or 0
        asked = search.queries.groupBy("cell").count()
        asked = asked.unionByName(asked.where(f"pmod(cell, {similarity.SLABS}) > 0").selectExpr("cell - 1 as cell", "count")) if earlier else asked
        own = asked.join(sizes.where("part = 0"), "cell").selectExpr("sum(count * n) as n").first()[0]
        assert met + own < share * 1500 * 1500, (earlier, met, own)


def test_empty_sides(spark):
    x, none = frame(spark, clustered(7)), frame(spark, [])
    assert similarity.top_k(none, x, 2, block=20).count() == 0
    assert similarity.top_k(x, none, 2, block=20).count() == 0


def test_identities_by_bounds_equal_those_of_all_pairs(spark):
    rows = frame(spark, clustered(8, n=300))
    key = lambda df: sorted(tuple(r) for r in df.select("id", "matched_id", "global_id").collect())
    by_bounds, by_all = (key(gallery.match_tracklets(rows, 0.9, block=b)) for b in (30, 4096))
    assert [(a, g) for a, _, g in by_bounds] == [(a, g) for a, _, g in by_all]


def test_scratch_tables_belong_to_their_thread(spark):
    """A block that ends in one thread deletes nothing that another one writes meanwhile."""
    inside, done = threading.Event(), threading.Event()
    found = {}

    def other():
        with scratch():
            inside.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    with scratch() as kept:
        thread.start()
        inside.wait(60)
        found["table"] = written(spark.range(5).toDF("id"), "thread")
        kept.append(found["table"])
        done.set()
        thread.join()
    assert found["table"].count() == 5


@pytest.mark.parametrize("earlier", [False, True])
def test_vectors_without_structure_are_copied_to_few_cells(spark, earlier):
    """Where no bound rules anything out, a query is handed on once for a cell, and there are no more cells than are allowed."""
    rows = frame(spark, np.random.default_rng(9).normal(size=(2000, 16)).astype(np.float32))
    search = similarity.Search(rows, rows, 1, -2.0, earlier, 20, 2000)
    most = similarity.FEW_COPIES // 2000
    assert search.cells.count() <= 1.5 * most
    met = search.pairs(search.seeds().cache()).selectExpr("count(*) as pairs", "sum(size(queries)) as copies").first()
    assert met.pairs <= (1.5 * most) ** 2 and met.copies <= 1.5 * most * 2000
