"""Vector code compression over anchors-hierarchy metric trees.

Vectors become integers, are cut into equal parts, and each part is coded by the nearest entry of its position's codebook.
Tasks build, for every block of vectors and every part position, a metric tree middle-out: about sqrt(n) anchors, each the
point farthest from the anchors before it and stealing the points nearer to it; pairs of anchors are merged upwards by the
smallest ball that holds both, and every anchor's points are divided once more downwards in the same way.  A ball caches sum,
count, centroid and radius.  An assignment walks down with a list of candidate entries: an entry leaves the list when the
ball lies wholly on the far side of its bisector with the nearest one.  A ball with one entry left is owned as a whole, its
cached sum and count go to the entry at once; only points of undivided balls meet the entries still listed.

Trees are built once, written to the shared folder and read by every round.  A round sends entries x components numbers a
task to the next codebook, which is as small as the parameters say.  All distances that decide are exact integers; balls are
ruled out with a margin for the rounding of centroid and radius, so results equal a plain search, ties to the lower index.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adlattice.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 2048  # vectors of a tree
LIMIT = 1 << 25  # components beyond are read as this one, so that squared distances fit a long
MARGIN = 1e-9
POINTS = 8192  # points measured at once
NODE = ("position", "start", "end", "child", "children")


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce(v.isNotNull() & ~odd, F.lit(False))


def digitise(values: np.ndarray, offsets: np.ndarray, dim: int) -> np.ndarray:
    """Integer vectors of ``dim`` components from a list column's values; shorter ones end in zeros."""
    whole = np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)
    sizes = np.diff(offsets)
    if (sizes == dim).all():
        return whole[offsets[0]:offsets[-1]].reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, :b - a] = whole[a:b]
    return out


# --- trees -------------------------------------------------------------------------------------------------------

def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def anchor_owners(points: np.ndarray, many: int) -> np.ndarray:
    """The anchor of every point, from 0; fewer than ``many`` if all points coincide with anchors before."""
    owner, dist, picks = np.zeros(len(points), np.int64), squared(points, points[0]), [0]
    while len(picks) < many:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        # a point less than half as far from its anchor as the new one is can't change
        reach = squared(points[picks], points[far])
        near = np.flatnonzero(4 * dist > reach[owner])
        d = squared(points[near], points[far])
        won = d < dist[near]
        owner[near[won]], dist[near[won]] = len(picks), d[won]
        picks.append(far)
    return owner


def sub_owners(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same within each run of points that begins at ``starts``, all runs at once, about sqrt(n) anchors each."""
    sizes = np.diff(np.append(starts, len(points)))
    group = np.repeat(np.arange(len(starts)), sizes)
    many, sub = np.ceil(np.sqrt(sizes)).astype(np.int64), np.zeros(len(points), np.int64)
    dist = squared(points, points[starts][group])
    far = np.zeros(len(starts), np.int64)
    for j in range(1, int(many.max())):
        peak = np.maximum.reduceat(dist, starts)
        grows = (many > j) & (peak > 0)
        if not grows.any():
            break
        at = np.flatnonzero(dist == peak[group])[::-1]
        far[group[at]] = at  # the first farthest point of each run
        d = squared(points, points[far][group])
        won = (d < dist) & grows[group]
        dist[won], sub[won] = d[won], j
    return sub


def merged(centre: np.ndarray, radius: np.ndarray, count: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Anchors merged pairwise, always the two that fit the smallest ball: (children of each new node, anchors from left to right)."""
    n = len(radius)
    centre, radius, count, name = centre.copy(), radius.copy(), count.astype(np.float64), list(range(n))
    joins: list[tuple[int, int]] = []

    def ball(i: int) -> np.ndarray:
        d = np.sqrt(squared(centre, centre[i]))
        return np.maximum(np.maximum(radius, radius[i]), (d + radius + radius[i]) / 2)
    size = np.stack([ball(i) for i in range(n)])
    np.fill_diagonal(size, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(size.argmin()), n)
        joins.append((name[i], name[j]))
        both = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
        radius[i] = max(np.sqrt(squared(both, centre[i])) + radius[i], np.sqrt(squared(both, centre[j])) + radius[j])
        centre[i], count[i], name[i] = both, count[i] + count[j], n + len(joins) - 1
        fresh = ball(i)
        fresh[i] = np.inf
        size[j], size[:, j] = np.inf, np.inf
        fresh[np.isinf(size[i])] = np.inf
        size[i], size[:, i] = fresh, fresh
    order, stack = [], [n + len(joins) - 1 if joins else 0]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            stack += reversed(joins[node - n])
    return joins, order


def grow(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree over ``points``: their order, and per node start, end, child (its first one), children, sum, centre, radius.

    Node 0 is the root, children of a node follow each other, and a node's points are a run in the tree's order.
    """
    n = len(points)
    owner = anchor_owners(points, int(np.ceil(np.sqrt(n))))
    by_owner = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_owner], np.arange(owner.max() + 1))
    count = np.diff(np.append(starts, n))
    centre = np.add.reduceat(points[by_owner], starts) / count[:, None]
    radius = np.sqrt(np.maximum.reduceat(squared(points, centre[owner])[by_owner], starts))
    joins, left_right = merged(centre, radius, count)
    k = len(starts)
    place = np.empty(k, np.int64)
    place[left_right] = np.arange(k)
    sub = np.empty(n, np.int64)
    sub[by_owner] = sub_owners(points[by_owner], starts)
    order = np.lexsort((sub, place[owner]))
    own = points[order]
    leaf = place[owner][order] * (n + 1) + sub[order]
    leaf_start = np.flatnonzero(np.diff(leaf, prepend=-1))
    leaf_end = np.append(leaf_start[1:], n)
    first = np.append(0, np.cumsum(count[left_right]))  # where each anchor's points begin, from left to right
    # nodes above the anchors and the anchors, from the root down
    top, child, children, at = [k + len(joins) - 1 if joins else 0], [], [], 0
    while at < len(top):
        node = top[at]
        at += 1
        if node >= k:
            child.append(len(top))
            children.append(2)
            top += joins[node - k]
        else:
            child.append(-1 - int(place[node]))
            children.append(0)
    span = {i: (int(first[place[i]]), int(first[place[i] + 1])) for i in range(k)}
    for i, (a, b) in enumerate(joins):
        span[k + i] = (span[a][0], span[b][1])
    start, end = (np.array([span[x][i] for x in top], np.int64) for i in (0, 1))
    child, children = np.array(child, np.int64), np.array(children, np.int64)
    # an anchor's children are its divided balls, unless it is one ball
    is_anchor = children == 0
    low, high = np.searchsorted(leaf_start, start[is_anchor]), np.searchsorted(leaf_start, end[is_anchor])
    many = np.where(high - low > 1, high - low, 0)
    child[is_anchor], children[is_anchor] = np.where(many > 0, len(top) + low, 0), many
    start, end = np.append(start, leaf_start), np.append(end, leaf_end)
    child, children = (np.append(x, np.zeros(len(leaf_start), np.int64)) for x in (child, children))
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(own, axis=0)])
    total = running[end] - running[start]
    middle = total / (end - start)[:, None]
    around = np.empty(len(start))
    below = len(top)
    around[below:] = np.sqrt(np.maximum.reduceat(squared(own, np.repeat(middle[below:], leaf_end - leaf_start, axis=0)), leaf_start))
    for i in range(below):
        around[i] = np.sqrt(squared(own[start[i]:end[i]], middle[i]).max())
    return {"order": order, "start": start, "end": end, "child": child, "children": children, "sum": total, "centre": middle, "radius": around}


class Forest:
    """The trees of one block of vectors, one per part position, their nodes in one list."""

    FIELDS = ("points", "order", "node", "total", "ball")

    def __init__(self, points: np.ndarray, order: np.ndarray, node: np.ndarray, total: np.ndarray, ball: np.ndarray):
        self.points, self.order, self.total = points, order, total
        self.position, self.start, self.end, self.child, self.children = node.T
        self.centre, self.radius = ball[:, :-1], ball[:, -1]

    @staticmethod
    def build(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
        """The arrays of ``FIELDS`` for integer vectors (rows) whose length is a multiple of ``parts``."""
        n, dim = vectors.shape
        points, order, node, total, ball, before = [], [], [], [], [], 0
        for p, own in enumerate(vectors.reshape(n, parts, dim // parts).transpose(1, 0, 2)):
            tree = grow(np.ascontiguousarray(own))
            points.append(own[tree["order"]])
            order.append(tree["order"])
            child = np.where(tree["children"] > 0, tree["child"] + before, 0)
            node.append(np.stack([np.full(len(child), p), tree["start"], tree["end"], child, tree["children"]], axis=1))
            total.append(tree["sum"])
            ball.append(np.concatenate([tree["centre"], tree["radius"][:, None]], axis=1))
            before += len(child)
        return [np.stack(points).astype(np.int32), np.stack(order).astype(np.int32), np.concatenate(node).astype(np.int32), np.concatenate(total), np.concatenate(ball)]

    @classmethod
    def read(cls, cells: list[bytes], parts: int, width: int) -> Forest:
        points, order, node, total, ball = (np.frombuffer(c, t) for c, t in zip(cells, (np.int32, np.int32, np.int32, np.int64, np.float64)))
        return cls(points.reshape(parts, -1, width), order.reshape(parts, -1), node.reshape(-1, len(NODE)), total.reshape(-1, width), ball.reshape(-1, width + 1))

    def owned(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Walks down all trees: (nodes, their entries, None) of owned balls, and last (nodes, None, candidates) of divided ones."""
        apart = np.sqrt(squared(book[:, :, None, :].astype(np.float64), book[:, None, :, :].astype(np.float64)))
        real, index = book.astype(np.float64), np.arange(book.shape[1])
        nodes = np.flatnonzero(self.start == 0)
        nodes = nodes[np.unique(self.position[nodes], return_index=True)[1]]  # the root is the first node of its tree
        live = np.ones((len(nodes), len(index)), bool)
        rest, rest_live = [], []
        while len(nodes):
            at, r = self.position[nodes], self.radius[nodes][:, None]
            d = squared(self.centre[nodes][:, None, :], real[at])
            d[~live] = np.inf
            best = d.argmin(axis=1)
            least = d[np.arange(len(best)), best][:, None]
            with np.errstate(invalid="ignore"):
                gap, bound = d - least, 2 * r * apart[at, best]
                out = gap > bound + MARGIN * (d + least + bound)
            # equal points: their centroid is exact, and a tie goes to the lower index
            out |= (r == 0) & ((gap > 0) | (index > best[:, None]))
            live &= ~out
            single = live.sum(axis=1) == 1
            yield nodes[single], live[single].argmax(axis=1), None
            leaf = ~single & (self.children[nodes] == 0)
            rest.append(nodes[leaf])
            rest_live.append(live[leaf])
            down = ~single & ~leaf
            many, kept = self.children[nodes[down]].astype(np.int64), live[down]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            nodes, live = np.repeat(self.child[nodes[down]], many) + step, np.repeat(kept, many, axis=0)
        yield np.concatenate(rest), None, np.concatenate(rest_live)

    def nearest(self, book: np.ndarray, nodes: np.ndarray, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, place, entry) of every point of the ``nodes``, measured against the entries still listed for its ball."""
        listed = live.sum(axis=1)
        by_list = np.argsort(listed, kind="stable")
        nodes, listed = nodes[by_list], listed[by_list]
        entries = np.argsort(~live[by_list], axis=1, kind="stable")  # listed ones first, by index
        size = (self.end - self.start)[nodes].astype(np.int64)
        ball = np.repeat(np.arange(len(nodes)), size)
        place = np.repeat(self.start[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        for a in range(0, len(ball), POINTS):
            b, at = ball[a:a + POINTS], place[a:a + POINTS]
            position = self.position[nodes[b]]
            asked = entries[b, :int(listed[b[-1]])]
            d = squared(book[position[:, None], asked], self.points[position, at].astype(np.int64)[:, None, :])
            d[np.arange(asked.shape[1]) >= listed[b][:, None]] = np.iinfo(np.int64).max
            yield position, at, asked[np.arange(len(b)), d.argmin(axis=1)]

    def sums(self, book: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> None:
        """Adds to ``counts`` and ``totals`` what every entry owns."""
        for nodes, entry, live in self.owned(book):
            if live is None:
                at = self.position[nodes], entry
                np.add.at(counts, at, (self.end - self.start)[nodes])
                np.add.at(totals, at, self.total[nodes])
            else:
                for position, place, entry in self.nearest(book, nodes, live):
                    np.add.at(counts, (position, entry), 1)
                    np.add.at(totals, (position, entry), self.points[position, place].astype(np.int64))

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry per vector and position, squared error per vector)."""
        parts, n = self.order.shape
        found = np.zeros((parts, n), np.int64)
        for nodes, entry, live in self.owned(book):
            if live is None:
                size = (self.end - self.start)[nodes].astype(np.int64)
                place = np.repeat(self.start[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found[np.repeat(self.position[nodes], size), place] = np.repeat(entry, size)
            else:
                for position, place, own in self.nearest(book, nodes, live):
                    found[position, place] = own
        code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
        for p in range(parts):
            code[self.order[p], p] = found[p]
            error[self.order[p]] += squared(self.points[p].astype(np.int64), book[p][found[p]])
        return code, error


# --- Spark -------------------------------------------------------------------------------------------------------

def forests(kept: DataFrame, dim: int, parts: int, block: int) -> DataFrame:
    """One row per block of vectors: keys, labels and the arrays of its trees."""
    key, label = (kept.schema[c].dataType.simpleString() for c in ("key", "label"))

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for at in range(0, rb.num_rows, block):
                own = rb.slice(at, block)
                vectors = own.column("vector")
                cells = Forest.build(digitise(vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy(), dim), parts)
                ends = pa.array([0, own.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, own.column(c)) for c in ("key", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["keys", "labels", *Forest.FIELDS])
    cells = ", ".join(f"{c} binary" for c in Forest.FIELDS)
    return kept.mapInArrow(build, f"keys array<{key}>, labels array<{label}>, {cells}")


def next_book(trees: DataFrame, book: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floored mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = book.shape

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for rb in rows:
            for cells in zip(*[rb.column(c) for c in Forest.FIELDS]):
                Forest.read([c.as_buffer() for c in cells], parts, width).sums(book, counts, totals)
        slot = np.flatnonzero(counts.ravel())
        columns = [slot, counts.ravel()[slot], *totals.reshape(-1, width)[slot].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "n", *[f"s{i}" for i in range(width)]])
    names = [f"s{i}" for i in range(width)]
    found = trees.select(*Forest.FIELDS).mapInArrow(add, ", ".join(f"{c} bigint" for c in ["slot", "n", *names]))
    out = book.reshape(-1, width).copy()
    # one row per entry in use: as many as the codebook has
    for row in found.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():
        out[row["slot"]] = [row[c] // row["n"] for c in names]
    return out.reshape(book.shape)


def coded(trees: DataFrame, book: np.ndarray, key: str, label: str) -> DataFrame:
    """(key, label, code, error) of every vector."""
    parts, _, width = book.shape

    def code(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for i, cells in enumerate(zip(*[rb.column(c) for c in Forest.FIELDS])):
                codes, error = Forest.read([c.as_buffer() for c in cells], parts, width).codes(book)
                text, size = codes.tobytes().hex(), 2 * parts
                texts = [text[a:a + size] for a in range(0, len(text), size)]
                yield pa.RecordBatch.from_arrays([rb.column("keys").slice(i, 1).flatten(), rb.column("labels").slice(i, 1).flatten(), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["key", "label", "code", "error"])
    return trees.mapInArrow(code, f"key {key}, label {label}, code string, error bigint")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per usable vector: key, code, error, label_error, codebooks_sha256.

    Rows without a vector, or with a null or non-finite component, are left out.  Codebooks start from the ``entries`` (at most
    256) least keys, nulls last and ties by the vector; with fewer vectors they have fewer entries.  Vectors of unequal
    lengths, and lengths that the parts don't divide, are read as ending in zeros.  Components beyond 131,072 are read as
    that.  Repeated keys and rows are coded each; an empty table gives no rows.
    """
    kept = vectors.where(usable(vector)).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 1
    dim = -(-max(longest, 1) // parts) * parts
    least = kept.select("vector", "key").orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    rows = [np.array(r["vector"], np.float64) for r in least]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    start = digitise(np.concatenate(rows) if rows else np.zeros(0), ends, dim)
    book = np.ascontiguousarray(start.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2))
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("key", "label")}
    trees = materialise(forests(kept, dim, parts, block))
    for _ in range(rounds if rows else 0):
        book = next_book(trees, book)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    done = materialise(coded(trees, book, kinds["key"], kinds["label"]))
    totals = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    joined = done.join(totals, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """One assignment to codebook ``i`` and the codebook that follows, in SQL."""
    return f"""
near{i} AS (SELECT p.id, p.p, arg_min(b.e, {{'d': {_DISTANCE}, 'e': b.e}}) AS e FROM parts p JOIN book{i} b USING (p) GROUP BY ALL),
mean{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (
  SELECT n.p, n.e, x.j, floor(SUM(p.c[x.j]) / COUNT(*))::BIGINT AS m FROM near{i} n JOIN parts p USING (id, p), (SELECT unnest(range(1, (SELECT MAX(len(c)) FROM parts) + 1)) AS j) x GROUP BY ALL) GROUP BY ALL),
book{i + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"""


_DISTANCE = "list_sum([(a - b.c[j]) * (a - b.c[j]) FOR a, j IN p.c])"
ORACLE = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
              WHERE embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(coalesce(x, 0)) FOR x IN embedding]), true)),
parts AS (SELECT id, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS c FROM kept, range(16) r(p)),
book0 AS (SELECT p, id - 1 AS e, c FROM parts WHERE id <= 64),{_round(0)},{_round(1)},
last AS (SELECT p.id, p.p, MIN({{'d': {_DISTANCE}, 'e': b.e}}) AS best FROM parts p JOIN book2 b USING (p) GROUP BY ALL),
codes AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', best.e), '' ORDER BY l.p) AS code, SUM(best.d)::BIGINT AS error FROM last l JOIN kept k USING (id) GROUP BY k.id, k.vec_id, k.label)
SELECT vec_id, code, error, (SUM(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM codes"""
