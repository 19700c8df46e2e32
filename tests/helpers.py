"""Small grids built by hand."""

from datetime import UTC, datetime, timedelta

from stormframe.operators import grid

START = datetime(2024, 1, 1, tzinfo=UTC)
CELLS = "file_key string, product string, level string, valid_at timestamp, row_i int, col_i int, lat double, lng double, value double"
GRIDS = (
    "file_key string, product string, level string, valid_at timestamp, n_rows int, n_cols int, "
    "block_height int, block_width int, axis_key string"
)


def make_grid(spark, lats, lngs, frames, block=4, product="P", level="00.50"):
    """(grids, blocks, axes) of ``frames``: {file_key: row-major values}, two minutes apart."""
    cells, catalog = [], []
    for i, (key, values) in enumerate(frames.items()):
        at = START + timedelta(minutes=2 * i)
        catalog.append((key, product, level, at, len(lats), len(lngs), block, block, "axis"))
        for r, lat in enumerate(lats):
            for c, lng in enumerate(lngs):
                cells.append((key, product, level, at, r, c, float(lat), float(lng), float(values[r * len(lngs) + c])))
    grids = spark.createDataFrame(catalog, GRIDS)
    blocks = grid.pack_blocks(spark.createDataFrame(cells, CELLS), block, block)
    return grids, blocks, grid.grid_axes(blocks, grids)
