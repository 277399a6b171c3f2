"""Identity products against brute force: scopes, pruning, movement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import identity as I


def people(spark, n, dim, seed, clusters=0, zero=False):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    if clusters:
        v = 6 * rng.standard_normal((clusters, dim))[np.arange(n) % clusters] + v
    if zero:
        v[::7] = 0
    df = spark.createDataFrame([(f"s{k}", f"p{k % (n // 3)}", [float(x) for x in row]) for k, row in enumerate(v)], "sample_id string, subject_id string, embedding array<double>")
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return df, np.divide(v, length, out=np.zeros_like(v), where=length > 0)


@pytest.mark.parametrize(("clusters", "zero"), [(0, False), (5, False), (4, True)])
def test_products_match_brute_force(spark, monkeypatch, clusters, zero):
    monkeypatch.setattr(I, "BLOCK_BYTES", 8 * 8 * 16)
    monkeypatch.setattr(I, "STRIP_BYTES", 8 * 8 * 16 * 3)
    monkeypatch.setattr(I, "CENTRES", 6)
    monkeypatch.setattr(I, "CHUNK_ROWS", 5)
    e, u = people(spark, 240, 8, clusters, clusters, zero)
    train, test = np.arange(0, 150), np.arange(120, 240)  # thirty samples on both sides
    ids = lambda at: spark.createDataFrame([(f"s{k}",) for k in at], "sample_id string")
    r = I.identity_disjoint(ids(train), ids(test), e, 0.7).first()
    near = u[train] @ u[test].T
    assert (r.n_train, r.n_test, r.violations) == (150, 120, int((near >= 0.7).sum()))
    assert r.max_similarity == pytest.approx(near.max(), abs=1e-12) and r.violation_rate == pytest.approx((near >= 0.7).mean())
    r = I.subject_partition(e, 0.7).first()
    first = {}
    for k in sorted(range(240), key=lambda k: f"s{k}"):
        first.setdefault(f"p{k % 80}", k)
    x = u[list(first.values())]
    near = (x @ x.T)[np.triu_indices(80, 1)]
    assert (r.n_train, r.n_subjects_total, r.violations) == (80, 80, int((near >= 0.7).sum()))
    assert r.max_similarity == pytest.approx(max(0, near.max()), abs=1e-12)


def test_many_scopes_share_one_product(spark, monkeypatch):
    """More scopes than a word has bits, and subjects beside them."""
    monkeypatch.setattr(I, "BLOCK_BYTES", 8 * 4 * 10)
    e, u = people(spark, 90, 4, 3)
    rng = np.random.default_rng(1)
    side = rng.integers(0, 3, (70, 90))
    rows = [(s, f"s{k}", ("train", "test", "dropped")[side[s, k]]) for s in range(70) for k in range(90)]
    folds = spark.createDataFrame(rows, "scope int, sample_id string, side string")
    both = I.side_vectors(folds, e, 71).unionByName(I.subject_vectors(e, 71, 70))
    got = {r.scope: r for r in I.scope_products(both, 0.5).collect()}
    for s in range(70):
        near = u[side[s] == 0] @ u[side[s] == 1].T
        assert (got[s].pairs, got[s].hits) == (near.size, int((near >= 0.5).sum()))
        assert got[s].best == pytest.approx(near.max(), abs=1e-12)
    assert got[70].pairs == 30 * 29 // 2


def test_far_blocks_are_passed_over_and_vectors_move_by_strips(spark, monkeypatch):
    rng = np.random.default_rng(2)
    block = lambda axis: I._pack(_table(np.eye(16)[axis] + 0.01 * rng.standard_normal((50, 16))))

    def _table(v):
        import pyarrow as pa

        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        return pa.table([pa.array([[1]] * len(v)), pa.array([[1]] * len(v)), pa.array([[0]] * len(v)), pa.array(list(v))], names=[*I.MASKS, "v"])

    import pyarrow as pa

    blocks = pa.concat_tables([block(k) for k in range(12)]).append_column("strip", pa.array([0] * 12))
    products = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            products.append(self.shape)
            return np.asarray(self) @ np.asarray(other)

    plain = np.frombuffer
    monkeypatch.setattr(I.np, "frombuffer", lambda *a, **k: plain(*a, **k).view(Watched))
    out = I._multiply(0.9)((pa.scalar(0), pa.scalar(0)), blocks)
    multiplied = [s for s in products if len(s) == 2]
    assert len(multiplied) == 12  # each block with itself, none with another
    assert out.column("pairs").to_pylist() == [600 * 600] and out.column("hits").to_pylist() == [12 * 2500]
    assert abs(out.column("best")[0].as_py() - 1) < 1e-12


def test_null_vectors_are_missing_and_lengths_must_agree(spark):
    e = spark.createDataFrame([("a", "p", [1.0, 0.0]), ("b", "q", None), ("c", "r", [1.0, 0.0, 0.0])], "sample_id string, subject_id string, embedding array<double>")
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "sample_id string")
    assert {r.sample_id for r in I.missing_embeddings(ids, e).collect()} == {"b", "z"}
    r = I.subject_partition(e.where("sample_id <> 'c'")).first()
    assert (r.n_train, r.violations, r.max_similarity) == (1, 0, 0.0)
    with pytest.raises(Exception, match="different lengths"):
        I.subject_partition(e).collect()
    r = I.identity_disjoint(ids.where("false"), ids, e.where(F.col("sample_id") == "a")).first()
    assert (r.n_train, r.n_test, r.violations) == (0, 3, 0)
