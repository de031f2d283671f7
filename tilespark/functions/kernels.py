"""Array kernels: clipping, simplifying, quantising, winding and encoding of a whole batch of features.

Geometry is three arrays: coordinates x and y, `ring` (where each ring begins, with the end last) and
attributes of rings (`feat`: its feature, `ext`: exterior or not). Every step works on all rings at once;
there is no loop over features, and simplification loops over levels of splitting only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tilespark.functions.geometry import CLOSE_PATH, LINE_TO, MOVE_TO

I = np.int64  # noqa: E741


@dataclass
class Rings:
    x: np.ndarray
    y: np.ndarray
    ring: np.ndarray
    feat: np.ndarray
    ext: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ring)

    def of_vertex(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.feat)), self.sizes)

    def take(self, keep: np.ndarray) -> Rings:
        """Some rings (a mask)."""
        v = np.repeat(keep, self.sizes)
        return Rings(self.x[v], self.y[v], np.r_[0, np.cumsum(self.sizes[keep])], self.feat[keep], self.ext[keep])


def sums(values: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Sum of each ring's values; rings may be empty."""
    c = np.r_[np.zeros(1, values.dtype), np.cumsum(values)]
    return c[ring[1:]] - c[ring[:-1]]


def extremes(values: np.ndarray, ring: np.ndarray, ufunc: np.ufunc, empty: float) -> np.ndarray:
    out = np.full(len(ring) - 1, empty)
    full = np.flatnonzero(np.diff(ring) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, ring[:-1][full])
    return out


def bounds(r: Rings, features: int) -> tuple[np.ndarray, ...]:
    """Boxes of features (minx, miny, maxx, maxy), from all their rings; NaN doesn't count."""
    starts = np.searchsorted(r.feat, np.arange(features + 1))
    v = r.ring[starts]
    return (extremes(r.x, v, np.fmin, np.inf), extremes(r.y, v, np.fmin, np.inf), extremes(r.x, v, np.fmax, -np.inf), extremes(r.y, v, np.fmax, -np.inf))


def clip_axis(r: Rings, lo: np.ndarray, hi: np.ndarray, poly: np.ndarray, axis: int) -> Rings:
    """Cuts rings to a slab (lo, hi and poly by ring). Rings within the slab pass, rings beside it vanish; only
    those that leave it are cut."""
    if not len(r.x):
        return r
    v = r.x if axis == 0 else r.y
    least, most = extremes(v, r.ring, np.minimum, np.nan), extremes(v, r.ring, np.maximum, np.nan)  # NaN counts
    within = (least >= lo) & (most <= hi)
    beside = (most < lo) | (least > hi)
    if within.any():  # open polygons' rings are closed, rings of one vertex vanish: left to the cut
        first, last = r.ring[:-1], np.maximum(r.ring[1:] - 1, 0)
        f = np.minimum(first, len(v) - 1)
        within &= (r.sizes >= 2) & (~poly | (r.sizes < 3) | (r.x[f] == r.x[last]) & (r.y[f] == r.y[last]))
    cutting = ~within & ~beside
    if cutting.all():
        return cut_axis(r, lo, hi, poly, axis)
    # rings take part as features of their own, so that they come back in their order
    number = np.arange(len(r.feat))
    own = Rings(r.x, r.y, r.ring, number, r.ext)
    out, part = own.take(within), own.take(cutting)
    if len(part.feat):
        out = merge(out, cut_axis(part, lo[cutting], hi[cutting], poly[cutting], axis))
    return Rings(out.x, out.y, out.ring, r.feat[out.feat], out.ext)


def cut_axis(r: Rings, lo: np.ndarray, hi: np.ndarray, poly: np.ndarray, axis: int) -> Rings:
    """Each vertex contributes up to two points: itself if inside, and where the edge after it leaves, enters or
    crosses the slab. Lines are cut where they leave; polygons' rings are closed again."""
    n = len(r.x)
    size, of = r.sizes, r.of_vertex()
    v, w = (r.x, r.y) if axis == 0 else (r.y, r.x)
    k1, k2 = lo[of], hi[of]
    final = np.zeros(n, bool)
    final[r.ring[1:][size > 0] - 1] = True
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    a, b = v, v[nxt]
    inside = (a >= k1) & (a <= k2)
    after = inside[nxt] & ~final
    edge = ~final
    leaves, enters = edge & inside & ~after, edge & ~inside & after
    crosses = edge & ~inside & ~after & (((a < k1) & (b > k2)) | ((a > k2) & (b < k1)))

    def meet(at: np.ndarray, k: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(at)
        out = np.zeros(n)
        t = (k[i] - a[i]) / (b[i] - a[i])
        out[i] = w[i] + (w[nxt[i]] - w[i]) * t
        return out

    k_in, k_out = np.where(a < k1, k1, k2), np.where(b < k1, k1, k2)
    first, second = inside | enters | crosses, leaves | crosses
    v1, w1 = np.where(inside, a, k_in), np.where(inside, w, meet(enters | crosses, k_in))
    v2, w2 = k_out, meet(second, k_out)
    keep = np.stack([first, second], 1).ravel()
    vv, ww = np.stack([v1, v2], 1).ravel()[keep], np.stack([w1, w2], 1).ravel()[keep]
    ring_of = np.repeat(of, 2)[keep]
    # slices: a new one with each ring, and after each place where a line leaves
    cut = np.stack([np.zeros(n, bool), second & ~poly[of]], 1).ravel()[keep]
    if not len(vv):
        return Rings(vv, ww, np.zeros(1, I), r.feat[:0], r.ext[:0])
    fresh = np.r_[True, (ring_of[1:] != ring_of[:-1]) | cut[:-1]]
    begin = np.flatnonzero(fresh)
    count = np.diff(np.r_[begin, len(vv)])
    origin = ring_of[begin]
    # close polygons' rings; rings of one point vanish, and all that is cut from rings of one vertex
    end = begin + count - 1
    open_ = poly[origin] & (count >= 3) & ((vv[begin] != vv[end]) | (ww[begin] != ww[end]))
    good = (count + open_ >= 2) & (size[origin] >= 2)
    if open_.any():
        at = end[open_] + 1
        vv, ww = np.insert(vv, at, vv[begin[open_]]), np.insert(ww, at, ww[begin[open_]])
    out = Rings(vv, ww, np.r_[0, np.cumsum(count + open_)], r.feat[origin], r.ext[origin])
    out = out if good.all() else out.take(good)
    return out if axis == 0 else Rings(out.y, out.x, out.ring, out.feat, out.ext)


def clip(r: Rings, box: tuple[np.ndarray, ...], poly: np.ndarray) -> Rings:
    """Cuts rings to boxes (minx, miny, maxx, maxy by feature): first along x, then along y. Points come
    back as (x, y) again."""
    minx, miny, maxx, maxy = box
    r = clip_axis(r, minx[r.feat], maxx[r.feat], poly[r.feat], 0)
    return clip_axis(r, miny[r.feat], maxy[r.feat], poly[r.feat], 1)


def tied_split(d: np.ndarray, first: int, last: int) -> int:
    """Which of several vertices at the same greatest distance splits a segment. Vertices are met in order;
    one that equals the greatest distance so far takes over if it is nearer to the middle than any that
    took over before it."""
    best, index, middle, near = 0.0, -1, (first + last) >> 1, last - first
    for i, v in enumerate(d.tolist(), first + 1):
        if v > best:
            best, index = v, i
        elif v == best and abs(i - middle) < near:
            index, near = i, abs(i - middle)
    return index


def importance(r: Rings, ties: str = "scan") -> np.ndarray:
    """For each vertex the squared distance at which it was split off: segments are split at their
    farthest vertex down to the last vertex, whatever the tolerance. Ends get infinity, vertices on their
    segment 0. All segments of a level are split together. ties: which of several farthest vertices splits, the one
    that tied_split finds (scan), or the one nearest to the middle, of two as near the first (nearest)."""
    out = np.zeros(len(r.x))
    full = r.sizes > 0
    out[r.ring[:-1][full]] = out[r.ring[1:][full] - 1] = np.inf
    long = r.sizes > 2
    first, last = r.ring[:-1][long], r.ring[1:][long] - 1
    if len(first):
        split_all(r.x, r.y, first, last, out, ties)
    return out


def split_all(px: np.ndarray, py: np.ndarray, first: np.ndarray, last: np.ndarray, out: np.ndarray, ties: str = "scan") -> None:
    """Splits segments (first, last: numbers of vertices) level by level and writes each vertex's importance."""
    while len(first):
        inner = last - first - 1
        begin = np.cumsum(inner) - inner
        seg = np.repeat(np.arange(len(first)), inner)
        v = np.arange(len(seg)) + np.repeat(first + 1 - begin, inner)
        ax, ay = px[first], py[first]
        dx, dy = px[last] - ax, py[last] - ay
        d = distances(px[v], py[v], ax, ay, px[last], py[last], dx, dy, seg)
        most = np.maximum.reduceat(d, begin)
        top = np.flatnonzero(d == most[seg])
        of = seg[top]
        split = np.full(len(first), -1, I)
        split[of[::-1]] = v[top[::-1]]  # the first one, as later writes win
        live = most > 0
        if len(top) > len(first) and ties == "nearest":
            o = np.lexsort((np.abs(v[top] - (first + last >> 1)[of]), of))  # those as near stay in their order
            split[of[o][::-1]] = v[top[o][::-1]]
        elif len(top) > len(first):  # somewhere several vertices are equally far
            for s in np.flatnonzero(live & (np.bincount(of, minlength=len(first)) > 1)):
                lo, base = int(begin[s]), int(first[s])
                split[s] = base + tied_split(d[lo : lo + int(inner[s])], 0, int(last[s]) - base)
        first, last, split, most = first[live], last[live], split[live], most[live]
        out[split] = most
        ends = np.stack([first, split, split, last], 1).reshape(-1, 2)
        ends = ends[ends[:, 1] - ends[:, 0] > 1]
        first, last = ends[:, 0], ends[:, 1]


def distances(x, y, ax, ay, bx, by, dx, dy, seg) -> np.ndarray:
    """Squared distances of vertices (x, y) from their segments (seg: numbers of segments; the rest by segment),
    the nearest point of the segment being an end or between; NaN counts as 0."""
    d2 = dx * dx + dy * dy
    x0, y0 = ax[seg], ay[seg]
    sx, sy = dx[seg], dy[seg]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x - x0) * sx + (y - y0) * sy) / d2[seg]
        ex, ey = x - (x0 + sx * t), y - (y0 + sy * t)
    before = np.flatnonzero(~(t > 0))
    ex[before], ey[before] = x[before] - x0[before], y[before] - y0[before]
    beyond = np.flatnonzero(t > 1)
    if len(beyond):
        # segments without length are points
        k = seg[beyond]
        line = (dx[k] != 0) | (dy[k] != 0)
        ex[beyond] = x[beyond] - np.where(line, bx[k], ax[k])
        ey[beyond] = y[beyond] - np.where(line, by[k], ay[k])
    ex *= ex
    ey *= ey
    ex += ey
    ex[np.isnan(ex)] = 0.0
    return ex


def box_areas(r: Rings) -> np.ndarray:
    """Area of each ring's box."""
    with np.errstate(invalid="ignore"):
        return (extremes(r.x, r.ring, np.fmax, -np.inf) - extremes(r.x, r.ring, np.fmin, np.inf)) * (extremes(r.y, r.ring, np.fmax, -np.inf) - extremes(r.y, r.ring, np.fmin, np.inf))


def simplify(r: Rings, sq_tol: np.ndarray, drop_flat: bool = True, ties: str = "scan") -> Rings:
    """Drops vertices of importance up to the squared tolerance (by feature; 0: nothing is dropped). Of
    features with several rings, those whose box has less area vanish first; rings keep two points."""
    tol = sq_tol[r.feat]
    on = tol > 0
    if not on.any():
        return r
    if drop_flat:
        several = np.bincount(r.feat, minlength=len(sq_tol))[r.feat] > 1
        small = on & several & (box_areas(r) < tol)
        if small.any():
            r = r.take(~small)
            tol, on = sq_tol[r.feat], sq_tol[r.feat] > 0
    of = r.of_vertex()
    keep = (importance(r, ties) > tol[of]) | ~on[of]
    size = sums(keep.astype(I), r.ring)
    out = Rings(r.x[keep], r.y[keep], np.r_[0, np.cumsum(size)], r.feat, r.ext)
    return out.take((size >= 2) | ~on) if ((size < 2) & on).any() else out


def fix_exteriors(before: Rings, after: Rings, several_ext: np.ndarray) -> Rings:
    """Exterior flags once rings have been cut or dropped: where a feature had several exteriors and at
    most one is left, its first ring is the exterior; where it had one, ring 0 is, whichever that is."""
    n = len(several_ext)
    left = np.bincount(after.feat, after.ext, n)
    lead = np.r_[True, after.feat[1:] != after.feat[:-1]] if len(after.feat) else np.zeros(0, bool)
    many = several_ext[after.feat] & (left[after.feat] > 1)
    return Rings(after.x, after.y, after.ring, after.feat, np.where(many, after.ext, lead))


def signed_areas(r: Rings) -> np.ndarray:
    """Sum of (xi - xj)(yi + yj) over each ring's vertices and their predecessors, the last one before the first."""
    prev = np.arange(len(r.x)) - 1
    full = r.sizes > 0
    prev[r.ring[:-1][full]] = r.ring[1:][full] - 1
    return sums((r.x - r.x[prev]) * (r.y + r.y[prev]), r.ring)


def wind(r: Rings, poly: np.ndarray, winding: str = "reference") -> Rings:
    """Turns polygons' rings in the direction of their role."""
    if not len(r.x):
        return r
    area = signed_areas(r)
    right = area > 0 if winding == "reference" else area < 0
    turn = (right != r.ext) & poly[r.feat]
    if not turn.any():
        return r
    of = r.of_vertex()
    at = np.where(turn[of], (r.ring[:-1] + r.ring[1:] - 1)[of] - np.arange(len(r.x)), np.arange(len(r.x)))
    return Rings(r.x[at], r.y[at], r.ring, r.feat, r.ext)


def encode(r: Rings, poly: np.ndarray, features: int, loose: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Geometry commands of all features (lines and polygons, by feature), one after another, and where
    each feature's begin. A feature's cursor goes on from the last point written. loose: features whose vertices are
    points, all in one command."""
    q = np.zeros(len(r.feat), bool) if loose is None else loose[r.feat]
    if q.any():  # rings of a loose feature are one
        apart = np.r_[True, (r.feat[1:] != r.feat[:-1]) | ~q[1:]]
        r = Rings(r.x, r.y, np.r_[r.ring[:-1][apart], r.ring[-1]], r.feat[apart], r.ext[apart])
        q = q[apart]
    p = poly[r.feat] & ~q
    size = r.sizes
    if len(r.x):
        first, last = np.minimum(r.ring[:-1], len(r.x) - 1), np.maximum(r.ring[1:] - 1, 0)
        closed = p & (size >= 3) & (r.x[first] == r.x[last]) & (r.y[first] == r.y[last])
        written = size - closed
        keep = np.where(p, (size >= 3) & (written >= 3), size >= 2 - q)
        vertex = np.repeat(keep, size)
        vertex[last[closed]] = False
        x, y = r.x[vertex], r.y[vertex]
        ring = np.r_[0, np.cumsum(written[keep])]
        feat, p, q = r.feat[keep], p[keep], q[keep]
    else:
        x, y, ring, feat, p, q = r.x, r.y, np.zeros(1, I), r.feat[:0], p[:0], q[:0]
    count = np.diff(ring)
    length = 2 * count + 2 + p - q
    at = np.r_[0, np.cumsum(length)]
    out = np.empty(int(at[-1]), I)
    if len(x):
        delta = np.empty((len(x), 2), I)
        delta[0] = x[0], y[0]
        np.subtract(x[1:], x[:-1], out=delta[1:, 0])
        np.subtract(y[1:], y[:-1], out=delta[1:, 1])
        lead = ring[:-1][np.r_[True, feat[1:] != feat[:-1]]]
        delta[lead, 0], delta[lead, 1] = x[lead], y[lead]
        np.bitwise_xor(delta << 1, delta >> 63, out=delta)
        # commands stand before each ring's first and second point and after a polygon's last; all else are points
        number = np.zeros(len(out), bool)
        begin, second = at[:-1], (at[:-1] + 3)[~q]
        number[begin] = number[second] = True
        number[at[1:][p] - 1] = True
        out[~number] = delta.ravel()
        out[begin] = MOVE_TO | np.where(q, count, 1) << 3
        out[second] = LINE_TO | (count - 1)[~q] << 3
        out[at[1:][p] - 1] = CLOSE_PATH | 1 << 3
    begins = at[np.searchsorted(feat, np.arange(features + 1))]
    return out, begins


@dataclass
class Tiles:
    """By feature: the tile, its clip box in Mercator units, and options."""

    z: np.ndarray
    x: np.ndarray
    y: np.ndarray
    extent: np.ndarray
    box: tuple[np.ndarray, ...]
    sq_tol: np.ndarray


def quantize(r: Rings, t: Tiles) -> Rings:
    f = r.feat[r.of_vertex()]
    n = (np.ones(len(t.z), I) << t.z).astype(float)[f]
    e = t.extent[f]
    with np.errstate(invalid="ignore"):
        x, y = np.floor(e * (r.x * n - t.x[f]) + 0.5), np.floor(e * (r.y * n - t.y[f]) + 0.5)
    whole = lambda v: np.where(np.isfinite(v), v, 0).astype(I)
    return Rings(whole(x), whole(y), r.ring, r.feat, r.ext)


def fit(r: Rings, box: tuple[np.ndarray, ...], poly: np.ndarray) -> Rings:
    """Features cut to their boxes: those within pass uncut, those outside vanish."""
    minx, miny, maxx, maxy = bounds(r, len(poly))
    bx0, by0, bx1, by1 = box
    out = (maxx < bx0) | (minx > bx1) | (maxy < by0) | (miny > by1)
    within = (minx >= bx0) & (maxx <= bx1) & (miny >= by0) & (maxy <= by1)
    if within.all():
        return r
    cutting = ~out & ~within
    return merge(r.take(within[r.feat]), clip(r.take(cutting[r.feat]), box, poly))


def thinned(r: Rings, box: tuple[np.ndarray, ...]) -> Rings:
    """Rings without vertices that no cut to a box within these (by feature) needs. Of vertices in a row beyond the
    same end in x, those between the first and the last add nothing to a cut along x. Of those beyond the same end
    in y all that counts later is where they begin and end and how far they go in x. What a cut gives stays the
    same, to the last bit and in the same order, degenerate rings too."""
    for axis in (1, 0):
        v, lo, hi = (r.y, box[1], box[3]) if axis else (r.x, box[0], box[2])
        f = r.feat[r.of_vertex()]
        side = (v > hi[f]).astype(np.int8) - (v < lo[f])
        n = len(v)
        if not side.any():
            continue
        first = np.zeros(n + 1, bool)
        first[r.ring] = True
        fresh = first[:-1].copy()
        fresh[1:] |= side[1:] != side[:-1]
        ends = np.r_[fresh[1:], True]
        keep = (side == 0) | fresh | ends
        if axis:
            begin = np.flatnonzero(fresh)
            run = np.cumsum(fresh) - 1
            keep |= (r.x == np.minimum.reduceat(r.x, begin)[run]) | (r.x == np.maximum.reduceat(r.x, begin)[run])
        if not keep.all():
            r = Rings(r.x[keep], r.y[keep], np.r_[0, np.cumsum(sums(keep.astype(I), r.ring))], r.feat, r.ext)
    return r


def gather(r: Rings, rows: np.ndarray, features: int) -> Rings:
    """The features of these numbers, in this order and as often as they are named; they are numbered anew."""
    begin = np.searchsorted(r.feat, np.arange(features + 1))
    count = np.diff(begin)[rows]
    ends = np.cumsum(count)
    at = np.repeat(begin[rows] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
    size = r.sizes[at]
    ring = np.r_[0, np.cumsum(size)]
    v = np.repeat(r.ring[at] - ring[:-1], size) + np.arange(int(ring[-1]))
    return Rings(r.x[v], r.y[v], ring, np.repeat(np.arange(len(rows)), count), r.ext[at])


def to_commands(r: Rings, poly: np.ndarray, t: Tiles, winding: str = "reference", drop_flat: bool = True, loose: np.ndarray | None = None, ties: str = "scan") -> tuple[np.ndarray, np.ndarray]:
    """Lines and polygons in Mercator units to geometry commands of their tiles; loose ones are cut and simplified as
    lines, and written as points. Features that lie within
    the clip box pass uncut, those outside vanish (they get no commands)."""
    n = len(poly)
    several = np.bincount(r.feat, r.ext, n) > 1
    r = fit(r, t.box, poly)
    r = fix_exteriors(r, simplify(fix_exteriors(r, r, several), t.sq_tol, drop_flat, ties), several)
    return encode(wind(quantize(r, t), poly, winding), poly, n, loose)


def merge(a: Rings, b: Rings) -> Rings:
    """Rings of two sets without a feature in common, in order of feature."""
    if not len(b.feat):
        return a
    if not len(a.feat):
        return b
    feat = np.r_[a.feat, b.feat]
    o = np.argsort(feat, kind="stable")
    size = np.r_[a.sizes, b.sizes]
    begin = np.r_[a.ring[:-1], b.ring[:-1] + a.ring[-1]]
    s = size[o]
    ring = np.r_[0, np.cumsum(s)]
    at = np.repeat(begin[o] - ring[:-1], s) + np.arange(int(ring[-1]))
    return Rings(np.r_[a.x, b.x][at], np.r_[a.y, b.y][at], ring, feat[o], np.r_[a.ext, b.ext][o])
