"""Block algebra: known rows, identities and bounds."""

import numpy as np
import pytest

from gridloom.operators import blocks as B
from gridloom.operators.coding import CODECS, code_lengths, huffman_decode, huffman_encode
from gridloom.plans import grid
from gridloom.plans.commands import random_field


@pytest.mark.parametrize(("u", "want"), [([10, 3, -8], [11, 2, -7]), ([10, 3, -8, -6, 3], [4.4375, 2, -14.5, -3.5, -6.6875])])
def test_decompose_known(u, want):
    assert np.allclose(B.decompose(np.array(u, float)), want)


@pytest.mark.parametrize(("shape", "levels"), [((5,), 2), ((11, 32), 4), ((1, 257, 129, 129, 1), 7), ((6, 5), 3)])
def test_levels(shape, levels):
    assert grid.Hierarchy(shape).levels == levels


def test_level_shapes_and_errors():
    assert grid.Hierarchy((11, 32)).level_shape(3) == (9, 17)
    assert grid.Hierarchy((6, 5)).level_shape(2) == (5, 5)
    for bad in ((1, 1, 1), (17, 0)):
        with pytest.raises(ValueError):
            grid.Hierarchy(bad)


def test_level_order_known():
    born = grid.hierarchy((9,)).birth_grid()
    assert np.argsort(born, kind="stable").tolist() == [0, 8, 4, 2, 6, 1, 3, 5, 7]
    assert np.argsort(grid.hierarchy((3, 2, 2)).birth_grid().ravel(), kind="stable").tolist() != []


def test_norms_known():
    x, y, z = np.meshgrid(*[np.arange(9) / 8] * 3, indexing="ij")
    u = np.sin(2 * x - y) + np.sin(-x + 2 * z) + np.sin(-3 * y + z) + np.sin(4 * x * y * z)
    want = {np.inf: 2.91471, -1.5: 1.09340, -1: 1.09759, -0.5: 1.10620, 0: 1.12429, 0.5: 1.16421, 1: 1.26009, 1.5: 1.51981}
    for s, norm in want.items():
        assert abs(B.s_norm(u, s) - norm) < 1e-3


@pytest.mark.parametrize("shape", [(33,), (35,), (7, 8, 9), (17, 19), (1, 5, 1, 6), (3, 2, 2)])
def test_inverses(shape):
    rng = np.random.default_rng(1)
    u, x = rng.normal(size=shape), [np.cumsum(rng.uniform(1, 2, n)) for n in shape]
    assert np.allclose(B.recompose(B.decompose(u, x), x), u)
    assert np.allclose(B.recompose(B.decompose(u, x, False), x, False), u)
    assert np.allclose(B.recompose_by_dimension(B.decompose_by_dimension(u, x), x), u)
    for d, xs in enumerate(x):
        assert np.allclose(B.mass_inverse(B.mass(u, xs, d), xs, d), u)
    squares = B.component_squares(u, x)
    assert (squares >= 0).all() and np.isclose(squares.sum(), B.l2_norm(u, x) ** 2)


def test_multilinear_has_no_detail():
    x, y = np.meshgrid(np.arange(9) / 8, np.arange(17) / 16, indexing="ij")
    c = B.decompose(1 + 2 * x - y + 3 * x * y)
    assert np.abs(c[grid.hierarchy((9, 17)).birth_grid() > 0]).max() < 1e-12


def test_flat_dimensions_change_nothing():
    u = random_field((31, 8))
    base = B.quantize(B.decompose(u), B.quanta(u.shape, 0.01, np.inf)).ravel()
    for shape in ((31, 8, 1), (31, 1, 8), (1, 31, 1, 1, 8)):
        v = u.reshape(shape)
        assert (B.quantize(B.decompose(v), B.quanta(shape, 0.01, np.inf)).ravel() == base).all()


@pytest.mark.parametrize("shape", [(65,), (55,), (17, 19), (18, 18), (10, 5, 12), (9, 9, 6)])
@pytest.mark.parametrize("s", [-1.5, -0.5, 0, 0.5, 1.5, np.inf])
def test_error_bound(shape, s):
    u = random_field(shape)
    for tolerance in (1, 0.1, 0.01, 0.001):
        q = B.quanta(shape, tolerance, s)
        back = B.recompose(B.quantize(B.decompose(u), q) * q)
        assert B.s_norm(back - u, s) <= tolerance


def test_functional_norm_is_the_dual():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(13, 13))
    weights = rng.normal(size=(13, 13))
    for s in (-0.5, 0.0, 1.0):
        assert abs((weights * u).sum()) <= B.riesz_norm(weights, s) * B.s_norm(u, s) * (1 + 1e-9)


def test_quantize_halves_and_errors():
    assert B.quantize(np.array([0.5, -0.5, 1.49, 0.49999999999999994]), 1.0).tolist() == [1, -1, 1, 1]
    for bad in (np.array([np.nan]), np.array([1e30])):
        with pytest.raises(ValueError):
            B.quantize(bad, 1.0)


@pytest.mark.parametrize("values", [[], [7], [7] * 20, list(range(-50, 50)), [0] * 90 + [1, -2, 1 << 40]])
@pytest.mark.parametrize("codec", list(CODECS))
def test_codecs(values, codec):
    v = np.asarray(values, np.int64)
    assert CODECS[codec][1](CODECS[codec][0](v)).tolist() == values


def test_code_lengths():
    assert code_lengths(np.array([4, 2, 1, 1])).tolist() == [1, 2, 3, 3]
    v = np.random.default_rng(0).geometric(0.4, 2000) - 5
    assert (huffman_decode(huffman_encode(v)) == v).all()


def test_plans():
    assert grid.prime_factors(360) == [2, 2, 2, 3, 3, 5]
    assert grid.split_longest((100, 10), 300) == (0, 25)
    assert grid.cubic_blocks((100, 100, 100), 64, 5000) == (16, 16, 16)
    assert np.prod(grid.balanced_shape((3600, 2))) == 7200
    assert grid.halved_depth((6, 5)) == 2
    assert grid.parse_shape("3x4x5") == (3, 4, 5)


@pytest.mark.parametrize("shape", [(2,), (3,), (4,), (10,), (33,), (34,), (7, 8), (6, 5, 9), (1, 12)])
def test_halving_hierarchy(shape):
    """Sizes as the halving rule says; both transforms invert; the transform is the projection by its formula."""
    from gridloom.plans.catalogue import projection

    rng = np.random.default_rng(2)
    h = grid.Halving(shape)
    for d, n in enumerate(shape):
        assert [len(h.indices(k, d)) for k in range(h.levels, -1, -1)] == ([1] * (h.levels + 1) if n == 1 else grid.halved_levels(n)[: h.levels + 1])
        assert all(set(h.indices(k, d)) <= set(h.indices(k + 1, d)) for k in range(h.levels))
    u, x = rng.normal(size=shape), [np.cumsum(rng.uniform(1, 2, n)) for n in shape]
    for correct in (True, False):
        assert np.allclose(B.recompose(B.decompose(u, x, correct, kind=grid.Halving), x, correct, kind=grid.Halving), u)
    assert np.allclose(B.recompose_by_dimension(B.decompose_by_dimension(u, x, grid.Halving), x, grid.Halving), u)
    squares = B.component_squares(u, x, grid.Halving)
    assert (squares >= 0).all() and np.isclose(squares.sum(), B.l2_norm(u, x) ** 2)
    if len(shape) == 1:
        assert np.allclose(B.decompose(u, kind=grid.Halving), projection(len(u), True) @ u) and np.allclose(B.decompose(u), projection(len(u)) @ u)


def test_interpolation_is_a_matrix():
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.uniform(1, 2, 17))
    up = B.Interpolation(np.arange(17), np.array([0, 3, 4, 10, 16]), x)
    m = np.stack([up.up(e, 0) for e in np.eye(5)], 1)
    assert np.allclose(m, np.stack([np.interp(x, x[[0, 3, 4, 10, 16]], e) for e in np.eye(5)], 1))
    u = rng.normal(size=(3, 17, 2))
    assert np.allclose(up.down(u, 1), np.einsum("fc,afb->acb", m, u))


def test_long_line():
    """Memory in proportion to the line."""
    import tracemalloc

    u = np.random.default_rng(5).normal(size=200_000)
    tracemalloc.start()
    c = B.decompose(u, correct=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * u.nbytes and np.allclose(B.recompose(c, correct=False), u)


def test_batches_of_fields():
    rng = np.random.default_rng(6)
    for kind in (grid.Hierarchy, grid.Halving):
        u = rng.normal(size=(10, 7, 4))
        c = B.decompose(u, kind=kind, batch=1)
        assert np.allclose(c, np.stack([B.decompose(u[..., k], kind=kind) for k in range(4)], -1)) and np.allclose(B.recompose(c, kind=kind, batch=1), u)


def test_plans_by_rate():
    """Greedy plans reach the tolerance, take planes from the front, and stop as told."""
    from gridloom.operators import bitplanes

    rng = np.random.default_rng(7)
    for _ in range(60):
        errors = np.sort(rng.uniform(0, 1, (4, 9)), 1)[:, ::-1] * 4.0 ** -np.arange(4)[:, None]
        errors[:, -1] = 0
        sizes, tolerance = rng.integers(1, 50, (4, 8)), float(rng.uniform(0.001, 2))
        error = lambda used: sum(errors[k, n] for k, n in enumerate(used))
        after_first, runs = bitplanes.greedy_after_first(errors, sizes, tolerance), bitplanes.greedy_runs(errors, sizes, tolerance)
        assert error(after_first) < tolerance or after_first == [8] * 4
        assert error(runs) < tolerance or runs == [8] * 4
        taken = [n > 0 for n in after_first]
        assert taken == sorted(taken, reverse=True) and after_first[0] >= 1
        if not all(taken):
            # what didn't join wasn't needed
            assert errors[sum(taken) :, 0].sum() < tolerance
    # one plane makes it worse, two together are the best offer
    assert bitplanes.greedy_runs(np.array([[4.0, 5.0, 1.0, 0.5]]), np.array([[1, 1, 1]]), 2.0) == [2]


def test_huffman_windows():
    rng = np.random.default_rng(8)
    for v in (np.zeros(0, np.int64), np.full(9, 5), rng.integers(-3, 4, 1000), np.repeat(np.arange(26), [2**k // 64 + 1 for k in range(26)])[::7]):
        assert (huffman_decode(huffman_encode(v)) == v).all()
    fib = [1, 1]
    while len(fib) < 27:
        fib.append(fib[-1] + fib[-2])
    long = np.repeat(np.arange(27), fib)
    assert code_lengths(np.asarray(fib)).max() > 20 and (huffman_decode(huffman_encode(long)) == long).all()
