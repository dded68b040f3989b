import numpy as np
import pytest

from evenkeel.llm import embedding_links as M

NONE = -(1 << 63)


def brute(table, threshold=0.93):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = [NONE if r[0] is None else r[0] for r in table]
    links, label = [0] * len(table), list(ids)
    near = []
    for i, a in enumerate(table):
        for j, b in enumerate(table):
            if i < j and a[2] is not None and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    near.append((i, j))
                    links[i] += 1
                    links[j] += 1
    for _ in table:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    real = lambda x: None if x == NONE else x
    return sorted(((real(a), n, real(c), a == c) for a, n, c in zip(ids, links, label)), key=str)


def vectors(dims, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, dims))
    out = []
    for i in range(160):
        v = centres[i % 4] + rnd.normal(size=dims) * rnd.choice([0.1, 0.2, 0.3]) if i % 3 else rnd.normal(size=dims)
        out.append((1000 - i, [float(np.float32(x)) for x in v * rnd.choice([0.5, 1, 3])], i % 2, "x"))
    out += [(2000 + i, out[1][1], 1, "y") for i in range(30)] + [out[5], (None, out[7][1], out[7][2], None)]
    out += [(3000, None, 1, ""), (3001, [0.0] * dims, 1, ""), (3002, [float("nan")] * dims, 1, ""), (3003, [None] * dims, 1, ""), (3004, out[1][1], None, ""), (3005, [1.0], 1, ""), (3006, [2.0], 1, ""), (3007, [float("inf")] * dims, 1, ""), (3008, [], 1, "")]
    return out


def run(spark, table):
    return sorted(map(tuple, M.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, rep string")).collect()), key=str)


def test_matches_brute_force(spark):
    for dims in (8, 64):
        table = vectors(dims)
        assert run(spark, table) == brute(table)


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 9)
    table = vectors(16, 2)
    assert run(spark, table) == brute(table)


def test_repeated_and_null_ids_on_different_vectors(spark):
    e = np.eye(8).tolist()
    table = [(None, e[0], 1, ""), (None, e[1], 1, ""), (None, e[1], 2, ""), (7, e[2], 1, ""), (7, e[2], 2, ""), (7, e[3], 1, ""), (5, e[2], 1, ""), (9, e[3], 1, ""), (4, e[4], 2, ""), (4, e[4], 2, ""), (9, e[5], 3, "")]
    assert run(spark, table) == brute(table)


def screened(rows, size):
    """(pairs, copies) that the chosen grids would screen, over all blocks."""
    axes = M.rotation(rows)
    turned = M._unit(rows) @ axes
    pairs = copies = 0
    for b, grid in enumerate(M.grids(turned, 0.93, size)):
        columns, budget = M.blocks_of(rows.shape[1])[b], M.budgets(rows.shape[1], 0.93)[b]
        n = np.unique(np.concatenate([c for _, _, c in M.entries(turned, columns, M.radius_of(budget), grid)]), return_counts=True)[1]
        pairs += int((n * (n - 1) // 2).sum())
        copies += int(n.sum())
    return pairs, copies


def test_the_grid_follows_the_spread_of_the_vectors():
    rnd = np.random.default_rng(4)
    even, strong = rnd.normal(size=(3000, 64)), rnd.normal(size=(3000, 64)) * 0.5 ** np.arange(64)
    unit = M._unit(even)
    assert M.grids(unit @ M.rotation(unit), 0.93, 3000) == [0] * 4  # no cell would spare more than it copies
    pairs, _ = screened(strong, 3000)
    assert pairs < 0.8 * 4 * 3000 * 2999 / 2


@pytest.mark.parametrize("grid", [0, 1, 3])
def test_any_grid_gives_the_same_links(spark, monkeypatch, grid):
    monkeypatch.setattr(M, "grids", lambda *_: [grid] * 4)
    table = vectors(16, 3)
    assert run(spark, table) == brute(table)


def test_every_near_pair_shares_one_cell_and_a_home():
    rnd = np.random.default_rng(5)
    rows = M._unit(rnd.normal(size=(300, 12)) * 0.6 ** np.arange(12))
    for grid in (0, 1, 2, 3):
        radius, columns = 0.1, np.arange(3)
        found = [(m, int(r), int(c)) for m, pick, cell in M.entries(rows, columns, radius, grid) for r, c in zip(pick, cell)]
        by_cell = {}
        for m, r, c in found:
            by_cell.setdefault(c, []).append((r, m))
        met = [tuple(sorted((x, y))) for held in by_cell.values() for i, (x, p) in enumerate(held) for y, q in held[:i] if not p & q]
        assert len(met) == len(set(met))
        near = {(i, j) for j in range(300) for i in range(j) if (np.abs(rows[i, :grid] - rows[j, :grid]) <= radius).all()}
        assert near <= set(met)


def test_empty(spark):
    assert run(spark, []) == []
