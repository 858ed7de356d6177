"""Vector codes against plain Lloyd rounds."""

import math

import numpy as np
import pytest

from auditmill.llm import codes


def plain(rows, parts, entries, rounds):
    """{position: (code, error)}, books by comparing everything in Python integers."""
    kept = [(i, v) for i, v in enumerate(rows) if v[1] is not None and all(c is not None and math.isfinite(c) for c in v[1])]
    x = {i: np.array([math.floor(256 * c) for c in v[1]], dtype=np.int64).reshape(parts, -1) for i, v in kept}
    first = sorted(kept, key=lambda r: (r[1][0] is None, r[1][0] or 0, r[1][1]))[:entries]
    books = [[x[i][p] for i, _ in first] for p in range(parts)]

    def given():
        out = {}
        for i in x:
            far = [[int(((x[i][p] - c) ** 2).sum()) for c in books[p]] for p in range(parts)]
            out[i] = [(min(f), f.index(min(f))) for f in far]
        return out

    for _ in range(rounds):
        best = given()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[i][p] for i in x if best[i][p][1] == e]
                if mine:
                    books[p][e] = np.array([int(s) // len(mine) for s in np.sum(mine, axis=0)])
    return {i: ("".join(f"{e:02x}" for _, e in b), sum(f for f, _ in b)) for i, b in given().items()}, books


def rows_of(rng, n, width, spread=1.0):
    return [(i, (rng.normal(size=width) * spread).astype(np.float32).tolist(), int(rng.integers(0, 4)) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("n, parts, entries, rounds, spread", [(400, 4, 64, 2, 1.0), (300, 2, 16, 6, 40.0), (500, 1, 32, 4, 0.01), (5, 2, 64, 2, 1.0), (1, 2, 4, 2, 1.0)])
def test_codes(spark, n, parts, entries, rounds, spread):
    rng = np.random.default_rng(n)
    rows = rows_of(rng, n, 8, spread)
    if n > 100:
        rows += [(1000, None, 1), (1001, [None, *[0.0] * 7], 1), (1002, [math.nan, *[0.0] * 7], 1), (1003, [math.inf, *[0.0] * 7], None), (None, [0.5] * 8, 2)]
        rows += [(2000, [0.25] * 8, 3)] * 150
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, error int").repartition(3)
    done = codes.encode(table, parts=parts, entries=entries, rounds=rounds)
    want, books = plain(rows, parts, entries, rounds)
    assert done.books.tolist() == [[c.tolist() for c in b] for b in books]
    out = codes.with_label_error(done)
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in out.collect()]
    of_label = {}
    for i, (_, error) in want.items():
        of_label[rows[i][2]] = of_label.get(rows[i][2], 0) + error
    assert sorted(got, key=str) == sorted([(rows[i][0], *want[i], of_label[rows[i][2]]) for i in want], key=str)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    x = rng.normal(scale=60, size=(3000, 4)).astype(np.int64)
    book = x[:64].copy()
    grid = codes.Grid.of(book[None])
    kept, squared = codes.assign_all(x, book, 8, grid)
    for step in range(6):
        new = book + rng.integers(-3, 4, size=book.shape) * (rng.random(64) < 0.5)[:, None]
        moved = grid.high(((new - book) ** 2).sum(1))
        kept, squared, passed = codes.assign_again(x, new, moved, kept, grid)
        far = codes.distances(x, new)
        assert (kept.own == far.argmin(1)).all() and (squared == far.min(1)).all()
        assert (np.diff(kept.bounds, axis=1) >= 0).all()
        steps = np.sqrt(far.astype(float)) * grid.unit
        for row in range(0, 3000, 37):
            others = np.setdiff1d(np.arange(64), [kept.own[row], *kept.near[row]])
            assert (kept.bounds[row, :-1] <= steps[row, kept.near[row]]).all() and (kept.bounds[row, -1] <= steps[row, others]).all()
        assert (passed == 0).mean() > 0.1 and (passed > kept.near.shape[1]).mean() < 0.9
        book = new
        kept = kept.shrunk(codes.next_b(kept.near.shape[1], dict(zip(*np.unique(passed, return_counts=True)))))


def test_refused_and_empty(spark):
    schema = "vec_id long, embedding array<double>, label int"
    none = codes.encode(spark.createDataFrame([], schema))
    assert codes.with_label_error(none).collect() == []
    for rows in ([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 5, 1)], [(1, [1e9] * 16, 1)]):
        with pytest.raises(Exception, match="component|equally|multiple"):
            codes.encode(spark.createDataFrame(rows, schema), entries=1).rows.collect()
