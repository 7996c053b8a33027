"""Media columns: local image descriptors that find cropped, turned, rescaled or edited copies.

Images are grey: (width, height, pixels), a byte per pixel, row by row. Corners are found at several scales, each gets an
orientation and 128 binary tests of the smoothed image around it, turned by that orientation; a test says whether one
place is brighter than another by more than a share of the contrast there, so that noise on plain areas decides nothing.
Neighbouring corners form pairs. Pairs meet in Hamming tables by parts of both descriptors, those tests that divide the
stored corners best, and by how the corners lie to each other, which neither shift, turn nor scale changes. Each match of pairs gives a similarity transform; images are
copies where enough corners agree on one, the transform brings most of the query's corners onto like ones, and the pixels
of both, a third as large, correlate under it. Corners alone take unlike images of few or repeated shapes for copies at a
fixed rate a pair of images; their pixels tell them apart.

Query images are held against all others in blocks: a task has a bounded number of corners of both, builds the tables of
its own, and returns verified pairs only, so nothing but these grows with the number of look-alike corners.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read_table, release, save

#: Scales are powers of STEP, as far as an image has room for a patch.
STEP, LEVELS = 2**0.5, 8
RADIUS, BITS, ANGLES = 7, 128, 32
#: A corner is the strongest within so many pixels of its scale. There is no other bound on their number.
APART = 2
#: Tests count from this share of a patch's contrast on.
MARGIN = 0.15
#: Pairs of a corner with its nearest ones; bins of their direction, relative turn; tables, and tests of both descriptors in each.
NEIGHBOURS, TURNS, TABLES, WIDTH = 3, 16, 7, 5
#: Corners from which the tests of the tables are chosen, and how much less a test counts for each table that has it.
CHOSEN_FROM, REPEATED = 4096, 1.2
#: Largest Hamming distance of a match, and of a corner onto which the transform brings another.
NEAR, LIKE = 18, 24
#: What a match's two distances and the difference of its shapes, squared and weighted, may come to together: no less than
#: both distances may alone, if shapes are equal.
JOINT, SHAPE = 2 * NEAR, 10
#: Corners that must agree on a transform, and their least share of the corners of the image that has fewer.
VOTES, SHARE = 3, 0.07
#: Corners of the query that must fall on like ones, and their least share of those within the other image; and the least
#: share of these in the corners of the image that has fewer.
COVERED, COVER, WITHIN = 7, 0.65, 0.5
#: By how much the sides of an image are reduced for the comparison of pixels, and the least correlation of copies. From the
#: second correlation on, a smaller share of corners on like ones will do.
REDUCED, ALIKE, SURE, COVER_SURE = 3, 0.9, 0.97, 0.4
#: Corners of stored images and of query images that a task holds, and of query images that it compares at once, but for
#: larger images; pairs of images up to which matches are counted by pair first.
STORED, ASKED, BLOCK, MOST_COUNTED = 1 << 17, 1 << 18, 1 << 14, 1 << 23
_IMAGE = "id long, width int, height int, pixels binary"
_CORNER = np.dtype([("level", "u1"), ("turn", "u1"), ("y", "<f4"), ("x", "<f4"), ("bits", "<u8", 2)])


def _tests() -> np.ndarray:
    """(ANGLES, BITS, 2, 2): places (y, x) of the two pixels of each test, for each orientation."""
    r = np.random.default_rng(11)
    points = r.normal(scale=RADIUS / 2.2, size=(BITS, 2, 2))
    far = np.sqrt((points**2).sum(-1, keepdims=True))
    points = np.where(far > RADIUS - 1, points * (RADIUS - 1) / np.maximum(far, 1e-9), points)
    a = np.arange(ANGLES) * 2 * np.pi / ANGLES
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], -1), np.stack([-np.sin(a), np.cos(a)], -1)], -2)
    return np.rint(np.einsum("aij,btj->abti", turn, points)).astype(np.int64)


_TESTS = _tests()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = _Y**2 + _X**2 <= RADIUS**2


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r+1 pixels, edges repeated."""
    p = np.pad(x, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def _largest(x: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of 2r+1 pixels."""
    p = np.pad(x, r, constant_values=-np.inf)
    rows = np.max([p[i : i + x.shape[0]] for i in range(2 * r + 1)], axis=0)
    return np.max([rows[:, i : i + x.shape[1]] for i in range(2 * r + 1)], axis=0)


def _shrink(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    """An axis resampled to n places by triangles as wide as the step."""
    size = x.shape[axis]
    step = size / n
    at = (np.arange(n) + 0.5) * step - 0.5
    reach = int(np.ceil(step)) + 1
    near = np.floor(at)[:, None].astype(np.int64) + np.arange(-reach, reach + 1)
    weight = np.maximum(0, 1 - np.abs(near - at[:, None]) / step)
    weight /= weight.sum(axis=1, keepdims=True)
    taken = np.take(x, np.clip(near, 0, size - 1), axis=axis)
    return np.einsum("ijw,ij->iw", taken, weight) if axis == 0 else np.einsum("hij,ij->hi", taken, weight)


def describe(image: np.ndarray) -> np.ndarray:
    """The corners of an image as _CORNER rows, places in its own pixels. Equal neighbours are corners alike."""
    out = []
    for level in range(LEVELS):
        h, w = (int(round(n / STEP**level)) for n in image.shape)
        if min(h, w) < 2 * RADIUS + 3:
            break
        x = image if level == 0 else _shrink(_shrink(image, h, 0), w, 1)
        gy, gx = np.gradient(x)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        inside = np.zeros(strength.shape, dtype=bool)
        inside[RADIUS:-RADIUS, RADIUS:-RADIUS] = True
        at = np.argwhere(inside & (strength >= _largest(strength, APART)) & (strength > 1e-3 * max(strength.max(), 1.0)))
        smooth = _box(x, 1)
        for s in range(0, len(at), 4096):
            p = at[s : s + 4096]
            patch = smooth[p[:, 0, None, None] + _Y, p[:, 1, None, None] + _X]
            own = patch[:, _DISC]
            rest = (patch - own.mean(axis=1)[:, None, None]) * _DISC
            angle = np.arctan2((rest * _Y).sum((1, 2)), (rest * _X).sum((1, 2)))
            turn = np.rint(angle * ANGLES / (2 * np.pi)).astype(np.int64) % ANGLES
            place = np.clip(p[:, None, None, :] + _TESTS[turn], 0, np.array([h - 1, w - 1]))
            value = smooth[place[..., 0], place[..., 1]]
            bits = np.packbits(value[..., 0] + MARGIN * own.std(axis=1)[:, None] < value[..., 1], axis=1)
            rows = np.zeros(len(p), dtype=_CORNER)
            rows["level"], rows["turn"], rows["bits"] = level, turn, np.ascontiguousarray(bits).view("<u8")
            rows["y"], rows["x"] = (p[:, 0] + 0.5) * image.shape[0] / h, (p[:, 1] + 0.5) * image.shape[1] / w
            out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, dtype=_CORNER)


def pixels(width: int | None, height: int | None, data: bytes | None) -> np.ndarray | None:
    """The image, or None if a part is missing or sizes disagree."""
    if not width or not height or data is None or width < 0 or height < 0 or len(data) != width * height:
        return None
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width).astype(np.float64)


def _sides(height: int, width: int) -> tuple[int, int]:
    return max(1, round(height / REDUCED)), max(1, round(width / REDUCED))


def reduced(image: np.ndarray) -> np.ndarray:
    """The image with its sides divided by REDUCED."""
    h, w = _sides(*image.shape)
    return np.clip(np.rint(_shrink(_shrink(image, h, 0), w, 1)), 0, 255).astype(np.uint8)


def correlation(a: np.ndarray, a_sides: tuple[int, int], b: np.ndarray, b_sides: tuple[int, int], factor: complex, shift: complex) -> float:
    """The correlation of a reduced image with another, where the transform brings it within that; 0 if either is plain.

    The transform is one of places in the images as they were, whose (height, width) are the sides.
    """
    return float(_correlations(a[None], a_sides, b[None], b_sides, np.array([factor]), np.array([shift]))[0])


def _correlations(a: np.ndarray, a_sides: tuple[int, int], b: np.ndarray, b_sides: tuple[int, int], factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The correlation of each pair of images a[p] and b[p] under its transform."""
    (n, height, width), (h, w) = a.shape, b.shape[1:]
    if min(h, w) < 2:
        return np.zeros(n)
    y, x = (np.arange(k) + 0.5 for k in (height, width))
    at = (x * (a_sides[1] / width) + 1j * (y * (a_sides[0] / height))[:, None]).ravel()
    to = factor[:, None] * at + shift[:, None]
    u, v = to.imag * (h / b_sides[0]) - 0.5, to.real * (w / b_sides[1]) - 0.5
    inside = (u >= -0.5) & (u <= h - 0.5) & (v >= -0.5) & (v <= w - 0.5)
    u, v = np.clip(u, 0, h - 1.001), np.clip(v, 0, w - 1.001)
    i, j = u.astype(np.int64), v.astype(np.int64)
    r, c = u - i, v - j
    flat = np.ascontiguousarray(b).ravel()
    place = (np.arange(n) * (h * w))[:, None] + i * w + j
    two = (flat[place] * (1 - c) + flat[place + 1] * c) * (1 - r) + (flat[place + w] * (1 - c) + flat[place + w + 1] * c) * r
    one, many = a.reshape(n, -1).astype(np.float64), np.maximum(inside.sum(axis=1), 1)[:, None]
    one, two = ((z - (z * inside).sum(axis=1, keepdims=True) / many) * inside for z in (one, two))
    return (one * two).sum(axis=1) / np.maximum(np.sqrt((one**2).sum(axis=1) * (two**2).sum(axis=1)), 1e-9)


def alike(queries: list[tuple[int, int, bytes]], stored: list[tuple[int, int, bytes]], step: int = 1 << 17) -> Callable[..., np.ndarray]:
    """How images of these numbers correlate under transforms; images as (height, width, reduced pixels)."""
    sides = [np.array([x[:2] for x in images], np.int64).reshape(-1, 2) for images in (queries, stored)]

    def test(one: np.ndarray, two: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one))
        kinds, kind = np.unique(np.hstack([sides[0][one], sides[1][two]]), axis=0, return_inverse=True)
        for k, (h, w, m, n) in enumerate(kinds.tolist()):  # images of the same sides are taken together
            pairs = np.flatnonzero(kind.ravel() == k)
            some = max(1, step // (_sides(h, w)[0] * _sides(h, w)[1] + _sides(m, n)[0] * _sides(m, n)[1]))
            for s in range(0, len(pairs), some):
                p = pairs[s : s + some]
                a, b = (
                    np.frombuffer(b"".join(images[x][2] for x in at[p].tolist()), np.uint8).reshape(len(p), *_sides(*of))
                    for images, at, of in ((queries, one, (h, w)), (stored, two, (m, n)))
                )
                out[p] = _correlations(a, (h, w), b, (m, n), factor[p], shift[p])
        return out

    return test


def descriptors(images: DataFrame) -> DataFrame:
    """(id, n, corners, width, height, small): the corners of each image and the image reduced, one row an id; images that
    can't be read or have no corners are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                rows = []
                for i, w, h, data in zip(*(c.to_pylist() for c in batch.slice(s, 256).columns), strict=True):
                    x = pixels(w, h, data)
                    found = describe(x) if x is not None and i is not None else ()
                    if len(found):
                        rows.append((i, len(found), found.tobytes(), w, h, reduced(x).tobytes()))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n", "corners", "width", "height", "small"])

    found = images.select("id", "width", "height", "pixels").mapInArrow(run, "id long, n int, corners binary, width int, height int, small binary")
    return found.groupBy("id").agg(F.min(F.struct("n", "corners", "width", "height", "small")).alias("c")).select("id", "c.*")


def corner_pairs(corners: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, shape): each corner with its nearest ones of the same image and scale, and how they lie to each
    other: direction and turn of the second as the first sees them, in bins, and their distance in half octaves."""
    firsts, seconds = [], []
    group = owner.astype(np.int64) * LEVELS + corners["level"]
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    y, x, turn = corners["y"].astype(np.float64), corners["x"].astype(np.float64), corners["turn"] * (2 * np.pi / ANGLES)
    start, size = cuts[:-1], np.diff(cuts)
    for n in np.unique(size[size > 1]).tolist():  # groups of one size are taken together
        k, same = min(NEIGHBOURS, n - 1), start[size == n]
        many = max(1, (1 << 16) // n**2)
        for s in range(0, len(same), many):
            at = order[same[s : s + many, None] + np.arange(n)]
            for c in range(0, n, 2048):
                own = at[:, c : c + 2048]
                far = np.hypot(y[at][:, None] - y[own][:, :, None], x[at][:, None] - x[own][:, :, None])
                far[:, np.arange(own.shape[1]), c + np.arange(own.shape[1])] = np.inf
                firsts.append(np.repeat(own, k))
                seconds.append(np.take_along_axis(at[:, None], np.argsort(far, axis=2, kind="stable")[:, :, :k], axis=2).ravel())
    i, j = (np.concatenate(a) if a else np.zeros(0, dtype=np.int64) for a in (firsts, seconds))
    dy, dx = y[j] - y[i], x[j] - x[i]
    circle = TURNS / (2 * np.pi)
    distance = 2 * np.log2(np.maximum(np.hypot(dy, dx), 1e-6) / STEP ** corners["level"][i])
    return i, j, np.column_stack([(np.arctan2(dy, dx) - turn[i]) * circle % TURNS, (turn[j] - turn[i]) * circle % TURNS, distance])


def _cell(direction: np.ndarray, turn: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (((direction % TURNS) * TURNS + turn % TURNS) * 64 + np.clip(distance, 0, 63)).astype(np.int64)


def _key(cell: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, words: np.ndarray) -> np.ndarray:
    return cell << 2 * WIDTH | (words[i, table] << WIDTH | words[j, table])


def _dividing(bits: np.ndarray) -> np.ndarray:
    """(TABLES, WIDTH): tests for each table, one by one those that leave the fewest pairs of corners alike in all of them.

    Tests differ in how many corners they hold for, and bins of the tables in size with that: the ones that hold for nearly
    all or no corner divide nothing. The choice does not depend on the order of the corners.
    """
    mixed = (bits[:, 0] ^ bits[:, 1] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    some = np.ascontiguousarray(bits[np.argsort(mixed, kind="stable")[:CHOSEN_FROM]])
    holds = np.unpackbits(some.view(np.uint8).reshape(len(some), BITS // 8), axis=1).astype(np.float32)
    used, out = np.zeros(BITS), np.zeros((TABLES, WIDTH), np.int64)
    for table in range(TABLES):
        key = np.zeros(len(some), np.int64)
        for k in range(WIDTH):
            groups = np.zeros((1 << k, len(some)), np.float32)
            groups[key, np.arange(len(some))] = 1
            ones = (groups @ holds).astype(np.float64)
            alike = (ones**2 + (groups.sum(axis=1, dtype=np.float64)[:, None] - ones) ** 2).sum(axis=0) * REPEATED**used
            alike[out[table, :k]] = np.inf
            out[table, k] = alike.argmin()
            key = key * 2 + holds[:, out[table, k]].astype(np.int64)
        used[out[table]] += 1
    return out


def _words(corners: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """(corners, TABLES): the outcomes of each table's tests."""
    eight = np.ascontiguousarray(corners["bits"]).view(np.uint8).reshape(len(corners), BITS // 8)
    out = np.zeros((len(corners), TABLES), np.int64)
    for k in range(WIDTH):
        out = out << 1 | eight[:, tests[:, k] >> 3] >> (7 - (tests[:, k] & 7)) & 1
    return out


def _distance(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[i, 0] ^ b[j, 0]) + np.bitwise_count(a[i, 1] ^ b[j, 1])


def _fine(shape: np.ndarray) -> list[np.ndarray]:
    """Direction, turn and distance in parts of a bin, so that a circle has 256; pairs of one cell are less than half of that
    apart in each."""
    return [(np.rint(x * (256 / TURNS)).astype(np.int64) & 255).astype(np.uint8) for x in shape.T]


#: Of each difference of these (as an unsigned byte) its weighted square.
_SQUARES = (SHAPE * (np.arange(256, dtype=np.uint8).view(np.int8) * (TURNS / 256)) ** 2).astype(np.float32)


class _Indexed(tuple):
    """Pairs of corners with the tests of their tables and these, for several calls of _matches."""

    tables: tuple[np.ndarray, list] | None = None


def _tables(d: np.ndarray, pairs, tests: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The tests, and of each table the distinct keys in order, the place and number of each key's pairs, the pairs,
    and their words and shapes."""
    di, dj, ds = pairs
    words, cell, fine = _words(d, tests), _cell(*np.floor(ds).T), _fine(ds)
    out = []
    for table in range(TABLES):
        keys = _key(cell, di, dj, table, words)
        order = np.argsort(keys, kind="stable")
        keys, start, n = np.unique(keys[order], return_index=True, return_counts=True)
        out.append((keys, start, n, order.astype(np.int32), [d["bits"][at[order], w] for at in (di, dj) for w in (0, 1)], [x[order] for x in fine]))
    return tests, out


def _matches(q: np.ndarray, q_pairs, d: np.ndarray, d_pairs, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the query's and the stored pairs that match: one key of a table, both corners near, and all differences
    together not large."""
    qi, qj, qs = q_pairs
    size = len(d_pairs[0])
    if not size or not len(qi):
        return (np.zeros(0, np.int64),) * 2
    tests, tables = getattr(d_pairs, "tables", None) or _tables(d, d_pairs, _dividing(d["bits"]))
    q_words = _words(q, tests)
    words = [q["bits"][at, w] for at in (qi, qj) for w in (0, 1)]
    shape = _fine(qs)
    found = []
    low = np.floor(qs - 0.5)  # the query's pairs go to the two nearest bins of each kind
    cells = np.stack([_cell(*(low + [v >> 2, v >> 1 & 1, v & 1]).T) for v in range(8)])
    bits = np.int64(len(qi)).item().bit_length()
    for table, (keys, start, n, order, stored, of) in enumerate(tables):
        asked = np.sort((_key(cells, qi, qj, table, q_words) << bits | np.arange(len(qi))).ravel())
        pair, asked = asked & (1 << bits) - 1, asked >> bits
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == asked)
        pair, place = pair[hit], place[hit]
        first, m = start[place], n[place]
        total = np.cumsum(m)
        at = 0
        while at < len(m):  # runs of query pairs with a bounded number of candidates, or one pair with more
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
            k = m[at:end]
            a = np.repeat(pair[at:end], k)
            b = np.repeat(first[at:end] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            both = np.zeros(len(a), np.uint8)
            for w in (0, 2):  # a corner's first word alone rules out most
                far = np.bitwise_count(words[w][a] ^ stored[w][b])
                good = np.flatnonzero(far <= NEAR)
                a, b, both, far = a[good], b[good], both[good], far[good]
                far += np.bitwise_count(words[w + 1][a] ^ stored[w + 1][b])
                good = np.flatnonzero(far <= NEAR)
                a, b, both = a[good], b[good], both[good] + far[good]
            apart = both.astype(np.float32)
            for one, two in zip(shape, of, strict=True):
                apart += _SQUARES[one[a] - two[b]]
            good = np.flatnonzero(apart <= JOINT)
            found.append(a[good] * size + order[b[good]])
            at = end
    return np.divmod(_unique(np.concatenate(found)), size) if found else (np.zeros(0, np.int64),) * 2


def _unique(x: np.ndarray) -> np.ndarray:
    """Distinct whole numbers in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _distinct(key: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and of each the number of distinct values, which are below ``values``."""
    key = _unique(key * values + value) // values
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.diff(first, append=len(key))


def _needed(a, b):
    """Votes that images of a and b corners need."""
    return np.maximum(VOTES, np.ceil(SHARE * np.minimum(a, b)))


def copies(q: np.ndarray, q_owner: np.ndarray, d: np.ndarray, d_owner: np.ndarray, block: int = BLOCK, stored: int = STORED, like: Callable[..., np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(query, stored, votes) of all copies among the images whose numbers, in ascending order, the owners are.

    ``like`` (see alike) decides too on pairs of images whose corners agree on a transform; without it, their corners do.
    """
    queries, out, tests = list(_blocks(q, q_owner, block)), [], _dividing(d["bits"])
    for y, d1, o1, pairs in _blocks(d, d_owner, stored):
        pairs = _Indexed(pairs)
        pairs.tables = _tables(d1, pairs, tests)
        for x, *one in queries:
            test = like and (lambda a, b, *to, x=x, y=y: like(a + x, b + y, *to))
            out += [(a + x, b + y, v) for a, b, v in _copies(*one, d1, o1, pairs, test)]
    return out


def _blocks(corners: np.ndarray, owner: np.ndarray, size: int) -> Iterator[tuple]:
    """(first image, corners, owners from 0, pairs) of runs of whole images with at most ``size`` corners, or one image."""
    ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))[: len(owner)]
    start = 0
    while start < len(owner):
        fit = ends[np.searchsorted(ends, start + size, "right") - 1] if len(ends) and ends[0] <= start + size else 0
        end = int(fit) if fit > start else int(ends[np.searchsorted(ends, start, "right")])
        c, o = corners[start:end], owner[start:end] - owner[start]
        yield int(owner[start]), c, o, corner_pairs(c, o)
        start = end


def _copies(q: np.ndarray, q_owner: np.ndarray, q_pairs: tuple, d: np.ndarray, d_owner: np.ndarray, d_pairs: tuple, like: Callable[..., np.ndarray] | None) -> list[tuple[int, int, int]]:
    a, b = _matches(q, q_pairs, d, d_pairs)
    zq, zd = (c["x"].astype(np.float64) + 1j * c["y"] for c in (q, d))
    n_q, n_d = np.bincount(q_owner), np.bincount(d_owner)
    pair = (q_owner[q_pairs[0]] * np.int64(len(n_d)))[a] + d_owner[d_pairs[0]][b]
    if len(n_q) * len(n_d) <= MOST_COUNTED:  # most pairs of images have too few matches for any transform
        enough = np.bincount(pair, minlength=len(n_q) * len(n_d)).reshape(len(n_q), -1) >= _needed(n_q[:, None], n_d)
        kept = np.flatnonzero(enough.ravel()[pair])
        a, b, pair = a[kept], b[kept], pair[kept]
    (qi, qj), (di, dj) = ((p[0][n], p[1][n]) for p, n in ((q_pairs, a), (d_pairs, b)))
    factor = (zd[dj] - zd[di]) / (zq[qj] - zq[qi])  # a similarity as z -> factor * z + shift
    # pairs of images go on if enough corners agree on turn and scale, in one of the bins that are near; an octave of scale,
    # as transforms that agree differ by up to 0.4 of it either way
    scale, turn = np.log2(np.abs(factor)) * 2, np.angle(factor) * TURNS / (2 * np.pi)
    likely = []
    for ds in (0, 0.5):
        for dt in (0, 0.5):
            key, votes = _distinct((pair * 64 + np.clip(np.floor(scale / 2 + ds) + 32, 0, 63).astype(np.int64)) * TURNS + np.floor(turn + dt).astype(np.int64) % TURNS, qi, len(q))
            p = key // (64 * TURNS)
            likely.append(p[votes >= _needed(n_q[p // len(n_d)], n_d[p % len(n_d)])])
    likely = _unique(np.concatenate(likely))
    if len(n_q) * len(n_d) <= MOST_COUNTED:
        wanted = np.zeros(len(n_q) * len(n_d), dtype=bool)
        wanted[likely] = True
        chosen = np.flatnonzero(wanted[pair])
    else:
        chosen = np.flatnonzero(np.isin(pair, likely))
    chosen = chosen[np.argsort(pair[chosen], kind="stable")]
    cuts = np.searchsorted(pair[chosen], np.append(likely, np.iinfo(np.int64).max))
    q_order, d_order = np.argsort(q_owner, kind="stable"), np.argsort(d_owner, kind="stable")
    q_at, d_at = np.append(0, np.cumsum(n_q)), np.append(0, np.cumsum(n_d))
    out = []
    one, two = np.divmod(likely, len(n_d))
    need = _needed(n_q[one], n_d[two]).astype(np.int64)
    votes, f, shift = _agreements(zq[qi[chosen]], zd[di[chosen]], factor[chosen], qi[chosen], di[chosen], cuts, need)
    agreed = np.flatnonzero(votes >= need)
    if like is None:
        cover = np.full(len(agreed), COVER)
    else:
        same = like(one[agreed], two[agreed], f[agreed], shift[agreed])
        agreed, same = agreed[same >= ALIKE], same[same >= ALIKE]
        cover = np.where(same >= SURE, COVER_SURE, COVER)
    for p, share in zip(agreed.tolist(), cover.tolist(), strict=True):
        x, y = one[p], two[p]
        if _covered(q[q_order[q_at[x] : q_at[x + 1]]], d[d_order[d_at[y] : d_at[y + 1]]], f[p], shift[p], share):
            out.append((int(x), int(y), int(votes[p])))
    return out


def _agreements(zq, zd, factor, qi, di, cuts: np.ndarray, need: np.ndarray, most: int = 64, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_agreement for each run of matches between two cuts; runs of like length are taken together."""
    size = np.diff(cuts)
    votes, fit, move = np.zeros(len(size), np.int64), np.ones(len(size), np.complex128), np.zeros(len(size), np.complex128)
    grown, turn = np.log2(np.abs(factor)), np.angle(factor)
    order = np.argsort(size, kind="stable")
    start, many = int(np.searchsorted(size[order], 1)), int(np.searchsorted(size[order], most, side="right"))
    while start < many:
        end = start + 1  # runs are in order of length, so the last one is the longest
        while end < many and (end + 1 - start) * int(size[order[end]]) ** 2 <= step:
            end = min(many, start + 2 * (end - start))
            if (end - start) * int(size[order[end - 1]]) ** 2 > step:
                end = start + max(1, (end - start) // 2)
                break
        runs = order[start:end]
        start, m = end, int(size[order[end - 1]])
        column = np.arange(m)
        real = column < size[runs][:, None]
        at = np.where(real, cuts[runs][:, None] + column, cuts[runs][:, None])
        x, y, f, g, t = zq[at], zd[at], factor[at], grown[at], turn[at]
        apart = x[:, None] - x[:, :, None]
        much = np.abs(f)[:, :, None]
        good = np.abs(f[:, :, None] * apart - (y[:, None] - y[:, :, None])) <= 2.5 * np.maximum(1.0, much) + 0.12 * much * np.abs(apart)
        good &= np.abs(g[:, None] - g[:, :, None]) <= 0.4
        good &= np.abs((t[:, None] - t[:, :, None] + np.pi) % (2 * np.pi) - np.pi) <= 0.35
        good &= real[:, None] & real[:, :, None]
        n = np.full(at.shape, most, np.int64)
        for corner in (qi[at], di[at]):  # each distinct corner of a run is a bit
            bit = np.uint64(1) << (corner[:, :, None] == corner[:, None]).argmax(axis=2).astype(np.uint64)
            n = np.minimum(n, np.bitwise_count(np.bitwise_or.reduce(np.where(good, bit[:, None], np.uint64(0)), axis=2)))
        best = n.argmax(axis=1)
        own = np.arange(len(runs))
        w = good[own, best]
        found = n[own, best]
        total = np.maximum(w.sum(axis=1), 1)
        x_mean, y_mean = (x * w).sum(axis=1) / total, (y * w).sum(axis=1) / total
        u, v = (x - x_mean[:, None]) * w, (y - y_mean[:, None]) * w
        f = (v * u.conj()).sum(axis=1) / np.maximum((np.abs(u) ** 2).sum(axis=1), 1e-9)  # least squares
        enough = found >= need[runs]
        kept = runs[enough]
        votes[kept], fit[kept], move[kept] = found[enough], f[enough], (y_mean - f * x_mean)[enough]
    for p in order[many:].tolist():
        m = slice(cuts[p], cuts[p + 1])
        votes[p], fit[p], move[p] = _agreement(zq[m], zd[m], factor[m], qi[m], di[m], int(need[p]), most)
    return votes, fit, move


def _agreement(zq, zd, factor, qi, di, need: int = 1, most: int = 64) -> tuple[int, complex, complex]:
    """Corners that agree on the best of the matches' transforms (of ``most`` spread over them), and that transform; no
    transform with fewer than ``need``."""
    at = np.unique(np.linspace(0, len(zq) - 1, most).astype(np.int64)) if len(zq) > most else np.arange(len(zq))
    f = factor[at][:, None]
    grown = np.abs(f)
    shift = zd[at][:, None] - f * zq[at][:, None]
    good = np.abs(f * zq + shift - zd) <= 2.5 * np.maximum(1.0, grown) + 0.12 * grown * np.abs(zq - zq[at][:, None])
    other = factor / f
    good &= (np.abs(np.log2(np.abs(other))) <= 0.4) & (np.abs(np.angle(other)) <= 0.35)
    best, votes = None, need - 1
    for h in np.flatnonzero(good.sum(axis=1) >= need).tolist():
        g = good[h]
        if g.sum() > votes and (n := min(len(set(qi[g].tolist())), len(set(di[g].tolist())))) > votes:
            best, votes = g, n
    if best is None:
        return 0, 1 + 0j, 0j
    x, y = zq[best], zd[best]
    u, v = x - x.mean(), y - y.mean()
    fit = (v * u.conj()).sum() / max((np.abs(u) ** 2).sum(), 1e-9)  # least squares
    return votes, fit, y.mean() - fit * x.mean()


def _covered(q: np.ndarray, d: np.ndarray, factor: complex, shift: complex, cover: float = COVER) -> bool:
    """Whether the transform brings enough of the query's corners within the other's onto like ones, of like scale."""
    zq, zd = (c["x"].astype(np.float64) + 1j * c["y"] for c in (q, d))
    to = factor * zq + shift
    level = q["level"] + np.log(max(abs(factor), 1e-9)) / np.log(STEP)
    inside = (to.real >= zd.real.min()) & (to.real <= zd.real.max()) & (to.imag >= zd.imag.min()) & (to.imag <= zd.imag.max()) & (level > -0.8) & (level < d["level"].max() + 0.8)
    if inside.sum() < max(COVERED, WITHIN * min(len(q), len(d))):
        return False
    at = np.flatnonzero(inside)
    like = np.zeros(len(at), dtype=bool)
    for s in range(0, len(at), 1024):
        i = at[s : s + 1024]
        near = np.abs(to[i][:, None] - zd[None]) <= 2 + 1.5 * STEP ** level[i][:, None]
        near &= np.abs(level[i][:, None] - d["level"][None]) <= 1
        r, c = np.nonzero(near)
        good = _distance(q["bits"], i[r], d["bits"], c) <= LIKE
        like[s + np.unique(r[good])] = True
    return like.sum() >= max(COVERED, cover * len(at))


def find_copies(queries: DataFrame, images: DataFrame, stored: int = STORED, asked: int = ASKED) -> DataFrame:
    """(query_id, class_id, votes): the classes of equal images of which a query image is a copy, cropped, turned, rescaled
    or edited.

    Equal images are one class, named by its smallest id, and compared once. Both inputs have (id, width, height,
    pixels); other columns are ignored. Of rows of one id that differ, the one with fewer corners counts. Null ids and
    images that can't be read, or without corners, find nothing; an empty table gives no rows. An equal image is found too
    if it has corners enough. Large images have corners in proportion; a task holds ``stored`` and ``asked`` corners.
    """
    named = classes(images).select(F.col("class_id").alias("id")).distinct()
    table = save(descriptors(images).join(named, "id", "left_semi"), "descriptors")
    wanted = save(descriptors(queries.where("id is not null")), "descriptors")
    release(images.sparkSession)
    size = [d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for d in (table, wanted)]
    g, h = -(-size[0] // stored) or 1, -(-size[1] // asked) or 1

    def side(d: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return d.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        arrays = []
        for t in (left, right):
            corners = np.frombuffer(b"".join(t["corners"].to_pylist()), dtype=_CORNER)
            arrays.append((corners, np.repeat(np.arange(t.num_rows), t["n"].to_numpy())))
        (d, d_owner), (q, q_owner) = arrays
        small = ([(h, w, x) for h, w, x in zip(*(t[k].to_pylist() for k in ("height", "width", "small")), strict=True)] for t in (right, left))
        # cells differ in size; the queries are held against a little more at once rather than against a small rest as well
        found = copies(q, q_owner, d, d_owner, stored=stored + stored // 4, like=alike(*small))
        ids = [t["id"].to_numpy() for t in (right, left)]
        cols = [[ids[0][a] for a, _, _ in found], [ids[1][b] for _, b, _ in found], [v for *_, v in found]]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "class_id", "votes"])

    # cells are few and heavy, so they are dealt over more partitions than there are cells
    left, right = (side(d, *of).repartition(4 * g * h, "g", "h") for d, of in ((table, ("g", g, "h", h)), (wanted, ("h", h, "g", g))))
    cells = left.groupBy("g", "h").cogroup(right.groupBy("g", "h"))
    out = save(cells.applyInArrow(run, "query_id long, class_id long, votes long"), "copies")
    drop(table, wanted)
    return out


def classes(images: DataFrame) -> DataFrame:
    """(id, class_id): images of equal size and pixels have the smallest id among them; unreadable ones their own."""
    key = F.sha2(F.concat_ws("|", F.col("width").cast("string"), F.col("height").cast("string"), F.sha2("pixels", 256)), 256)
    keyed = images.select("id", key.alias("h")).where("id is not null").distinct()
    least = keyed.groupBy("h").agg(F.min("id").alias("class_id"))
    return keyed.join(least, "h").select("id", "class_id")


# Images for the query: the test tables hold none, so each embedding is drawn as rectangles.

SIDE = 72


def draw(vector: list | None) -> bytes | None:
    """A grey image of SIDE by SIDE pixels that depends on every component; None for null or non-finite ones."""
    if vector is None or any(v is None for v in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    seed = int.from_bytes(hashlib.sha256(np.floor(v * 1024).astype("<i8").tobytes()).digest()[:8], "little")
    r = np.random.default_rng(seed)
    change = np.zeros((SIDE + 1, SIDE + 1))
    for y, x, h, w, a in zip(r.integers(0, SIDE - 8, 28), r.integers(0, SIDE - 8, 28), r.integers(6, 30, 28), r.integers(6, 30, 28), r.integers(-90, 90, 28), strict=True):
        y1, x1 = min(y + h, SIDE), min(x + w, SIDE)
        change[y, x] += a
        change[y1, x1] += a
        change[y1, x] -= a
        change[y, x1] -= a
    image = change.cumsum(0).cumsum(1)[:SIDE, :SIDE]
    image = 40 + 170 * (image - image.min()) / max(np.ptp(image), 1)
    return np.rint(image).astype(np.uint8).tobytes()


def warp(image: np.ndarray, scale: float, degrees: float) -> np.ndarray:
    """The image rescaled, and turned about its middle; edges are repeated."""
    h, w = image.shape
    small = [max(1, round(n * min(scale, 1.0))) for n in (h, w)]
    x = _shrink(_shrink(image, small[0], 0), small[1], 1) if scale < 1 else image
    rows, cols = (max(1, round(n * scale)) for n in (h, w))
    y, q = np.mgrid[0:rows, 0:cols] - np.array([(rows - 1) / 2, (cols - 1) / 2])[:, None, None]
    t, back = np.deg2rad(degrees), max(scale, 1.0)
    u = np.clip((y * np.cos(t) - q * np.sin(t)) / back + (x.shape[0] - 1) / 2, 0, x.shape[0] - 1.001)
    v = np.clip((y * np.sin(t) + q * np.cos(t)) / back + (x.shape[1] - 1) / 2, 0, x.shape[1] - 1.001)
    i, j = u.astype(np.int64), v.astype(np.int64)
    a, b = u - i, v - j
    return x[i, j] * (1 - a) * (1 - b) + x[i + 1, j] * a * (1 - b) + x[i, j + 1] * (1 - a) * b + x[i + 1, j + 1] * a * b


def edit(image: np.ndarray, seed: int) -> np.ndarray:
    """A copy, by turns cropped to five sixths or two thirds of each side, turned by up to 30 degrees, and rescaled to 0.7
    to 1.4; each with other brightness and contrast, and a little noise."""
    r = np.random.default_rng(seed % 2**32)
    kind = int(r.integers(4))
    if kind < 2:
        part = (5 / 6, 2 / 3)[kind]
        h, w = (int(n * part) for n in image.shape)
        y, x = r.integers(0, image.shape[0] - h + 1), r.integers(0, image.shape[1] - w + 1)
        image = image[y : y + h, x : x + w]
    else:
        image = warp(image, 1.0, r.uniform(-30, 30)) if kind == 2 else warp(image, r.uniform(0.7, 1.4), 0.0)
    return np.clip(np.rint(image * r.uniform(0.8, 1.1) + r.uniform(-10, 10) + r.normal(scale=0.7, size=image.shape)), 0, 255).astype(np.uint8)


def embedding_images(vectors: DataFrame, edited: bool = False) -> DataFrame:
    """(id, width, height, pixels) of (vec_id, embedding): its drawing, or an edited copy of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, w, h = draw(v), SIDE, SIDE
                if edited and data is not None:
                    x = edit(np.frombuffer(data, dtype=np.uint8).reshape(SIDE, SIDE).astype(np.float64), i or 0)
                    data, w, h = x.tobytes(), x.shape[1], x.shape[0]
                rows.append((i, w, h, data))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["id", "width", "height", "pixels"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, _IMAGE)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of the drawings of rows whose vec_id is divisible by 20, searched among the drawings of all rows."""
    vectors = read_table(spark, sf_dir, "embeddings")
    images = save(embedding_images(vectors), "images")
    return find_copies(embedding_images(vectors.where("vec_id % 20 = 0"), edited=True), images)
