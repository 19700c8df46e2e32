"""Motion of any speed, found level by level."""

import numpy as np
import pyarrow as pa
import pytest

from helpers import make_grid
from stormframe.operators import forecast, motion


def echoes(side, moves, frames=3, seed=1):
    """Smooth echoes on a flat field that move by the same number of cells a frame; what leaves does not come back."""
    rng = np.random.default_rng(seed)
    rows, cols = np.mgrid[0:side, 0:side].astype(float)
    spots = [(rng.uniform(-side, 2 * side), rng.uniform(-side, 2 * side), rng.uniform(3, 12), rng.uniform(10, 60)) for _ in range(side)]
    out = {}
    for k in range(frames):
        field = np.full((side, side), 8.0)
        for r, c, width, height in spots:
            field += height * np.exp(-((rows - r - k * moves[0]) ** 2 + (cols - c - k * moves[1]) ** 2) / (2 * width * width))
        out[f"f{k}"] = field.ravel()
    return out


@pytest.mark.parametrize("moves", [(0, 0), (1, -2), (5, 0), (-5, 5), (11, 3), (-4, 17)])
def test_shifts_of_many_cells_are_found(spark, moves):
    side, block = 96, 32
    grids, blocks, _ = make_grid(spark, range(side), range(side), echoes(side, moves), block)
    got = {(r.block_row, r.block_col): (r.d_row, r.d_col) for r in forecast.block_motion(grids, blocks).collect()}
    assert len(got) == 9
    # What a block shows came from inside the frame where two steps back are still in it.
    seen = [
        (r, c)
        for r, c in got
        if 0 <= r * block - 2 * moves[0] and (r + 1) * block - 2 * moves[0] <= side and 0 <= c * block - 2 * moves[1] and (c + 1) * block - 2 * moves[1] <= side
    ]
    assert seen and {got[k] for k in seen} == {moves}


def plain_motion(frames, side, block, factors):
    """The stated search, one block at a time."""
    floored = {k: np.where(np.isnan(v) | (v < 5), 5.0, v).reshape(side, side) for k, v in frames.items()}
    keys, out = list(frames), {}
    for br in range(side // block):
        for bc in range(side // block):
            at = (0, 0)
            for f in factors:
                n, b = side // f, block // f
                small = {k: v.reshape(n, f, n, f).mean(axis=(1, 3)) for k, v in floored.items()}
                mine = np.arange(br * b, br * b + b)[:, None], np.arange(bc * b, bc * b + b)[None, :]
                errors = {
                    (dr, dc): round(sum(((small[y][mine] - small[x][np.clip(mine[0] - dr, 0, n - 1), np.clip(mine[1] - dc, 0, n - 1)]) ** 2).sum() for x, y in zip(keys, keys[1:], strict=False)), 6)
                    for dr in range(1 - n, n)
                    for dc in range(1 - n, n)
                }
                start = at[0] // f, at[1] // f
                for w in range(1 if f < factors[0] else 3, 2 * n):
                    inside = [s for s in errors if max(abs(s[0] - start[0]), abs(s[1] - start[1])) <= w]
                    best = min(inside, key=lambda s: (errors[s], s[0] ** 2 + s[1] ** 2, *s))
                    if len(inside) == len(errors) or max(abs(best[0] - start[0]), abs(best[1] - start[1])) < w:
                        break
                at = best[0] * f, best[1] * f
            out[br, bc] = at
    return out


def test_noise_takes_the_stated_windows(spark):
    rng = np.random.default_rng(4)
    side, block = 16, 8
    frames = {f"f{k}": np.where(rng.random(side * side) < 0.1, np.nan, rng.uniform(0, 60, side * side)) for k in range(3)}
    grids, blocks, _ = make_grid(spark, range(side), range(side), frames, block)
    got = {(r.block_row, r.block_col): (r.d_row, r.d_col) for r in forecast.block_motion(grids, blocks).collect()}
    assert got == plain_motion(frames, side, block, (2, 1))


def test_means_of_cut_squares():
    values = np.arange(15.0).reshape(1, 3, 5)
    assert motion._means(values, 2).tolist() == [[[3.0, 5.0, 6.5], [10.5, 12.5, 14.0]]]


def test_a_flat_field_stands_still_and_short_history_has_no_motion(spark):
    flat = {f"f{k}": np.full(64, np.nan) for k in range(3)}
    grids, blocks, _ = make_grid(spark, range(8), range(8), flat)
    assert {(r.source_file_key, r.d_row, r.d_col) for r in forecast.block_motion(grids, blocks).collect()} == {("f2", 0, 0)}
    assert forecast.block_motion(grids.where("file_key < 'f2'"), blocks).count() == 0


def test_many_blocks_are_searched_together(monkeypatch):
    """Blocks of several shapes, cut ones at the rim included, in a call per shift window instead of one each."""
    rng = np.random.default_rng(9)
    n, m, block, copies = 10, 7, 4, 30
    calls, errors = [], motion._Search._errors
    monkeypatch.setattr(motion._Search, "_errors", lambda self, rows, shifts: calls.append(len(rows)) or errors(self, rows, shifts))
    places, strips, expected = [], [], []
    for _ in range(copies):
        frames = [rng.integers(0, 4, (n, m)).astype(float) for _ in range(3)]
        for row0 in range(0, n, block):
            for col0 in range(0, m, block):
                h, w = min(block, n - row0), min(block, m - col0)
                places.append(dict(begun=False, row0=row0, col0=col0, height=h, width=w, n_rows=n, n_cols=m, c_row=0, c_col=0, top=0, left=0, bottom=n, right=m))
                mine = []
                for step in (0, 1):
                    mine.append(dict(step=step, now=True, top=row0, left=col0, width=w, cells=frames[step + 1][row0 : row0 + h, col0 : col0 + w].ravel().tolist()))
                    # The earlier frame comes in two pieces.
                    for left, right in ((0, 4), (4, m)):
                        mine.append(dict(step=step, now=False, top=0, left=left, width=right - left, cells=frames[step][:, left:right].ravel().tolist()))
                strips.append(mine)
                rows, cols = np.arange(row0, row0 + h)[:, None], np.arange(col0, col0 + w)[None, :]

                def key(s, frames=frames, rows=rows, cols=cols):
                    came = np.clip(rows - s[0], 0, n - 1), np.clip(cols - s[1], 0, m - 1)
                    return sum(((frames[k + 1][rows, cols] - frames[k][came]) ** 2).sum() for k in (0, 1)), s[0] ** 2 + s[1] ** 2, *s

                reach = 4
                for radius in range(motion.FIRST_WINDOW, reach + 1):
                    tried = [(a, b) for a in range(max(1 - n, -radius), min(n - 1, radius) + 1) for b in range(max(1 - m, -radius), min(m - 1, radius) + 1)]
                    best = min(tried, key=key)
                    whole = len(tried) == (2 * n - 1) * (2 * m - 1)
                    if whole or max(map(abs, best)) < radius:
                        break
                expected.append((*best, int(not whole and max(map(abs, best)) == radius)))
    got = motion._Search(pa.array(places), pa.array(strips), 2, 4).best()
    assert [tuple(r) for r in got.tolist()] == expected and any(r[2] for r in expected)
    shapes = {(p["height"], p["width"]) for p in places}
    assert len(calls) <= len(shapes) * 6 and sum(calls) >= len(places)
