"""Many stencils of an image at once: Spark brings its pixels together and in order, and the task that holds them lays them out as one array.

A chain of windows sorts the pixels twice for each stencil, and writes mirrored ones for every border. Here they are sorted once, and what
stencils say of each pixel goes back as columns; masks, colours and aggregates stay with Spark. Images may have any size. A task holds
one image as integers and its edges as flags; other stencils are made in bands of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenmill.functions.tables import dealt
from lumenmill.operators.regions import _TAN_HIGH, _TAN_LOW
from lumenmill.operators.stencils import weights

#: Pixels of a band, and of an Arrow batch that goes back.
BAND = 1 << 16

#: What a kernel yields: first row, last row (exclusive), and values of these rows by name.
Band = tuple[int, int, dict[str, np.ndarray]]


def on_planes(px: DataFrame, kernel: Callable[[np.ndarray], Iterator[Band]], made: str, value: str = "l", keep: list[str] | None = None) -> DataFrame:
    """px (image_id, y, x, value, any others), or those of its columns to keep, with the columns that kernel makes of each image's plane; made is their schema.

    An image needs every pixel of its rectangle, with a value. A repeated pixel gets its results as often.
    """
    names, kept = StructType.fromDDL(made).names, px.columns if keep is None else keep

    def laid_out(image: object, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        h, w = int(y.max()) + 1, int(x.max()) + 1
        fits = min(y.min(), x.min()) >= 0 and h * w <= len(y)
        known = np.zeros((h, w) if fits else (1, 1), bool)
        if fits:
            known[y, x] = True
        if not known.all():
            raise ValueError(f"image {image} lacks pixels of its {w} x {h}")
        plane = np.empty((h, w), np.int32)
        plane[y, x] = v
        return plane

    def whole(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
        rows = pa.Table.from_batches(held)
        if rows.column(value).null_count:
            raise ValueError(f"a pixel has no {value}")
        place, y, x, v = (rows.column(n).to_numpy() for n in ("__place", "y", "x", value))
        ids, rows = rows.column("image_id"), rows.select(kept)
        starts = [*np.flatnonzero(place == 1).tolist(), len(rows)]
        for start, end in zip(starts, starts[1:], strict=False):
            ys, xs = y[start:end], x[start:end]
            for first, last, values in kernel(laid_out(ids[start], ys, xs, v[start:end])):
                a, b = np.searchsorted(ys, (first, last))
                yield rows.slice(start + a, b - a), [values[n][ys[a:b] - first, xs[a:b]] for n in names]

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("__place").to_numpy() == 1)
            last = int(starts[-1]) if len(starts) else batch.num_rows
            held.append(batch.slice(0, last))
            if len(starts):
                yield from whole(held)
                held = [batch.slice(last)]
        if held:
            yield from whole(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables([r for r, _ in ready])
            columns = [pa.array(np.concatenate([v[i] for _, v in ready])) for i in range(len(names))]
            yield from pa.table([*rows.columns, *columns], names=[*rows.column_names, *names]).combine_chunks().to_batches(BAND)

        ready, size = [], 0
        for rows, values in images(batches):
            ready.append((rows, values))
            size += len(rows)
            if size >= BAND:
                yield from put()
                ready, size = [], 0
        if size:
            yield from put()

    # The numbers bring an image's pixels into one partition, in order, and say where it begins.
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x"))
    rows = dealt(px)
    return rows.withColumn("__place", place).mapInArrow(cut, StructType([*[rows.schema[n] for n in kept], *StructType.fromDDL(made).fields]))


@lru_cache(1024)
def mirrored(side: int, reach: int) -> np.ndarray:
    """The pixels that stand from -reach to side - 1 + reach: pixel -k is pixel k, as often as it takes."""
    t = np.arange(-reach, side + reach)
    return side - 1 - np.abs(side - 1 - t % max(1, 2 * (side - 1)))


def bands(plane: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, block): bands of rows of a plane with reach mirrored pixels around."""
    h, w = plane.shape
    ys, xs, rows = mirrored(h, reach), mirrored(w, reach), max(1, BAND // w)
    for first in range(0, h, rows):
        last = min(h, first + rows)
        yield first, last, plane[ys[first : last + 2 * reach]][:, xs]


def within(block: np.ndarray, by: int) -> np.ndarray:
    return block[by : block.shape[0] - by, by : block.shape[1] - by]


def sobel(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y of a block with one pixel around."""
    down, right = block[:-2] + 2 * block[1:-1] + block[2:], block[:, :-2] + 2 * block[:, 1:-1] + block[:, 2:]
    return down[:, 2:] - down[:, :-2], right[2:] - right[:-2]


def laplacian(block: np.ndarray) -> np.ndarray:
    """Of a block with one pixel around."""
    return block[:-2, 1:-1] + block[2:, 1:-1] + block[1:-1, :-2] + block[1:-1, 2:] - 4 * block[1:-1, 1:-1]


def box_sum(block: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square of the given radius, of a block with radius pixels around."""
    for _ in range(2):
        upto = np.zeros((block.shape[0] + 1, block.shape[1]), np.int64)
        np.cumsum(block, 0, out=upto[1:])
        block = (upto[2 * radius + 1 :] - upto[: -2 * radius - 1]).T
    return block


def blurred(block: np.ndarray, sigma: float, reach: int) -> np.ndarray:
    """A Gaussian blur, along rows and then columns, of a block with reach pixels around."""
    half = weights(sigma)
    n = len(half) - 1
    block = within(block, reach - n)
    for _ in range(2):
        block = block.T
        size = block.shape[0] - 2 * n
        total = block[n : n + size] * half[0]
        for k, w in enumerate(half[1:], 1):
            total += (block[n - k : n - k + size] + block[n + k : n + k + size]) * w
        block = total
    return block


def quantized(values: np.ndarray) -> np.ndarray:
    """Bytes, half up."""
    return np.clip(np.floor(np.round(values, 9) + 0.5), 0, 255).astype(np.int32)


def thinned(plane: np.ndarray) -> np.ndarray:
    """Sums of both gradients' sizes where they are largest across their direction, else -1. Beyond the image gradients are 0 and pixels repeat."""
    gx, gy = sobel(np.pad(plane, 1, "edge"))
    across, along = np.abs(gx), np.abs(gy)
    around = np.pad(across + along, 1)
    size = around[1:-1, 1:-1]
    at = lambda dy, dx: around[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    flat, steep = along < across * _TAN_LOW, along > across * _TAN_HIGH
    slant = np.where(gx * gy >= 0, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))
    peak = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), slant))
    return np.where(peak, size, -1)


def edges(size: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which pixels of a thinned gradient are edges: those over high, and those over low that hang together with one. A flood from the strong ones that sees a pixel once."""
    h, w = size.shape
    left = np.zeros((h + 2, w + 2), bool)
    left[1:-1, 1:-1] = weak = size > low
    flat, row = left.ravel(), w + 2
    beside = np.array([-row - 1, -row, -row + 1, -1, 1, row - 1, row, row + 1])
    ys, xs = np.nonzero(size > max(low, high))
    at = (ys + 1) * row + xs + 1
    flat[at] = False
    while at.size:
        near = (at[:, None] + beside).ravel()
        at = np.unique(near[flat[near]])
        flat[at] = False
    return weak & ~left[1:-1, 1:-1]
