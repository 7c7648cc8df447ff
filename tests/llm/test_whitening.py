import numpy as np
import pytest

from thicket.llm import whitening as m

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=8):
    """Exact integers of the usable vectors, their centred sums and eigenvalues by numpy."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = (n * x - total).astype(float) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def agrees(found, rows, components=8):
    deviation, white, shares = brute(rows, components)
    got = {r.vec_id: r for r in found}
    mine = np.array([got[i].white for i, _ in rows])
    assert [int(got[i].deviation) for i, _ in rows] == list(deviation)
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * sign, white, rtol=1e-7, atol=1e-7)
    assert np.allclose(found[0].explained, shares, rtol=1e-9) and {r.n for r in found} == {len(rows)}
    assert max(r.identity_error for r in found) < 1e-6


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    agrees(m.whiten(table).collect(), rows)
    query = m.op13_whitening(spark, sf_dir)
    got = query.collect()
    assert len(got) == 8 * len(rows) and {r.component for r in got} == set(range(1, 9))
    assert dict(query.dtypes) | {"vec_id": "bigint", "n": "bigint", "deviation": "bigint", "component": "int", "whitened": "double"} == dict(query.dtypes)
    deviation, _, shares = brute(rows)
    want = dict(zip([i for i, _ in rows], deviation, strict=True))
    assert all(r.deviation == want[r.vec_id] for r in got)
    assert all(abs(r.explained - shares[r.component - 1]) < 1e-9 for r in got)


@pytest.mark.parametrize(("rows", "dims", "bits"), [(1, 1, 1), (63, 3, 5), (64, 2, 17), (1000, 5, 11), (130, 3, 62)])
def test_plane_products_are_exact(rows, dims, bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << bits, (rows, dims), np.uint64)
    got = m.products(m.planes(values, bits), m.planes(values[:, ::-1], bits))
    whole = values.astype(object)
    assert (got == whole.T @ whole[:, ::-1]).all()


def test_tiles_blocks_and_wide_entries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 11)) * np.array([1, 5, 1e3, 1, 2, 1, 1e6, 1, 1, 1, 7])
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base.astype(np.float32))]
    x = m.vectors(spark.createDataFrame(rows, SCHEMA))
    whole = np.array([r.x for r in sorted(x.collect())], object)
    monkeypatch.setattr(m, "TILE", 3)
    monkeypatch.setattr(m, "ROWS", 64)
    found = list(m._scatter(*bounds(whole))(iter(batches(whole))))[0].to_pydict()
    got = {(i, j): a * m.HALF + b for i, j, a, b in zip(*found.values(), strict=True)}
    shifted = whole - whole.min(axis=0)
    assert got[-1, -1] == 300 and [got[i, -1] for i in range(11)] == list(shifted.sum(axis=0))
    products = shifted.T @ shifted
    assert all(got[i, j] == products[i, j] for i in range(11) for j in range(i, 11))
    small = [(k, [c / s for c, s in zip(v, (1, 1, 50, 1, 1, 1, 1e5, 1, 1, 1, 1), strict=True)]) for k, v in rows]
    agrees(m.whiten(spark.createDataFrame(small, SCHEMA), 4).collect(), small, 4)


def bounds(whole):
    return [int(v) for v in whole.min(axis=0)], [max(1, int(v).bit_length()) for v in whole.max(axis=0) - whole.min(axis=0)]


def batches(whole):
    import pyarrow as pa

    for at in range(0, len(whole), 70):
        yield pa.record_batch([pa.array([[int(c) for c in row] for row in whole[at : at + 70]], pa.list_(pa.int64()))], names=["x"])


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, -1.0, 4.0]), (3, [3.0, 0.0, 0.0]), (4, [1.0, 2.0, 3.5])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, inf, 1.0]), (9, [1.0, 1.0, -inf]), (10, [1.0, 2.0]), (11, [])]
    agrees(m.whiten(spark.createDataFrame(good + bad, SCHEMA)).collect(), good)
    twice = m.whiten(spark.createDataFrame([*good, *good, (None, [0.5, 1.0, -2.0])], SCHEMA)).collect()
    assert len(twice) == 9 and {r.n for r in twice} == {9}  # repeated rows and null ids count
    assert np.ptp([r.white for r in twice if r.vec_id in (1, None)], axis=0).max() < 1e-12
    for none in ([], bad[:5], [(1, []), (2, [])]):
        empty = m.whiten(spark.createDataFrame(none, SCHEMA))
        assert sum(len(r.white) for r in empty.collect()) == 0
    flat = m.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [1.0, 3.0, 0.0])], SCHEMA)).collect()
    assert all(abs(abs(r.white[0]) - 1) < 1e-9 and r.white[1:] == [None, None] and r.explained == [1.0, 0.0, 0.0] for r in flat)
    one = m.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert one[0].white == [None, None] and one[0].deviation == 0 and one[0].identity_error is None
    huge = m.whiten(spark.createDataFrame([(1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [0.0, 1.0])], SCHEMA)).collect()
    assert len(huge) == 3 and max(r.identity_error for r in huge) < 1e-4
    wide = spark.createDataFrame([(1, [1.0], 2, "a"), (2, [2.0], 2, "b")], "n int, x array<double>, id int, white string")
    assert m.whiten(wide, 8, "n", "x").columns == ["vec_id", "n", "deviation", "white", "explained", "identity_error"]
