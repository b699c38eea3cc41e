"""Exact top-k by inner product with M-trees: best-first search over paged metric nodes.

Scores are inner products, which no metric follows by itself. Every vector v gets one more coordinate,
sqrt(M^2 - |v|^2) with M the largest length of all, and every query a zero there. Then |q - v|^2 = |q|^2 + M^2 - 2 q.v,
so the largest scores are the nearest vectors, and the triangle inequality holds.

All vectors are dealt to at most ``ROUTES`` routing objects, a bounded sample, by least distance; a route's vectors go
to pages of about ``PAGE`` rows by a hash of the row's number, so copies of one vector, rows that share an id, or a
popular region make more pages, not larger ones. A page is built once, by one task, and stored as one row: the M-tree's
nodes with their routing objects, covering radii and distances to the parent, and the entries with theirs. A search
keeps nodes in a queue by the best score they may hold. An entry's distance is computed only if its stored distance to
the parent does not exclude it already.

Queries run in two rounds. First each visits the pages of its most promising route, which gives it a k-th score; then
the pages of all other routes whose covering radius leaves room for that score. A page is sent once for every
``QUERIES`` queries that visit it and not at all if none does, so what is shuffled follows the table and the visits. Scores are exact
integers and bounds carry a margin for rounding.

Rows with a null id or vector, or a null or non-finite component, take no part; shorter vectors end in zeros. Nor do
vectors of a squared length of 2^61 or more after scaling (a single component of about 1.5 million): inner products of such
need not fit a long, those of all others do. A vector far longer than the others makes bounds weak for all. Ids that
repeat are rows of their own: each row with such an id is a candidate, and each whose id is a query's gets a list of
its own, which leaves out every row with that id. Fewer than k others give fewer rows, an empty table none. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from setforge.llm.common import drop_stored, stored

K, EVERY, SCALE = 10, 100, 1024
ROUTES, PAGE, QUERIES = 1024, 4096, 1024
#: Squared lengths of vectors that take part are below this, after scaling; floors add little.
LONGEST_SQ = float(1 << 61)
LEAF, FANOUT, SEED = 128, 8, 5
#: A page as one row. ids, v and apart (distance to the leaf's routing object) are the entries, leaf by leaf; the others the
#: nodes, breadth first: entry that is the routing object, covering radius, distance to the parent's, first child or entry, how many.
STORED_PAGE = "route int, page int, ids array<long>, v array<long>, apart array<double>, at array<int>, radius array<double>, up array<double>, first array<int>, many array<int>, leaf array<boolean>"


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Integer vectors as rows of one matrix."""
    rows = [np.asarray(v, np.int64) for v in column]
    width = max((len(v) for v in rows), default=0) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _points(vectors: np.ndarray, longest_sq: int) -> np.ndarray:
    """Vectors with the coordinate that makes them all equally long."""
    f = vectors.astype(np.float64)
    return np.c_[f, np.sqrt(np.maximum(longest_sq - (f * f).sum(axis=1), 0))]


def _far(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = points - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(ids: np.ndarray, vectors: np.ndarray, longest_sq: int) -> dict[str, np.ndarray]:
    """The M-tree of the rows of one page, in the columns of STORED_PAGE."""
    points = _points(vectors, longest_sq)
    rng = np.random.default_rng(SEED)
    at, radius, up, first, many, leaf = [], [], [], [], [], []
    entries: list[np.ndarray] = []
    apart_of: list[np.ndarray] = []
    n_entries = 0
    queue: list[tuple[np.ndarray, int]] = [(np.arange(len(ids)), -1)]  # the rows below a node and the parent's routing row
    for rows, above in queue:  # grows as it is read
        route = int(rows[rng.integers(len(rows))])
        apart = _far(points[rows], points[route])
        at.append(route)
        radius.append(float(apart.max()))
        up.append(0.0 if above < 0 else float(_far(points[above : above + 1], points[route])[0]))
        leaf.append(len(rows) <= LEAF)
        if leaf[-1]:
            first.append(n_entries)
            many.append(len(rows))
            entries.append(rows)
            apart_of.append(apart)
            n_entries += len(rows)
            continue
        seeds = rng.choice(rows, FANOUT, replace=False)
        nearest = np.argmin(np.stack([_far(points[rows], points[s]) for s in seeds]), axis=0)
        parts = [p for k in range(FANOUT) if len(p := rows[nearest == k])]
        if len(parts) == 1:  # copies: any cut does
            parts = np.array_split(rows, FANOUT)
        first.append(len(queue))
        many.append(len(parts))
        queue += [(p, route) for p in parts]
    order = np.concatenate(entries)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {"ids": ids[order], "v": vectors[order].ravel(), "apart": np.concatenate(apart_of), "at": place[at], "radius": np.array(radius), "up": np.array(up), "first": np.array(first), "many": np.array(many), "leaf": np.array(leaf)}


@dataclass
class Page:
    """A stored page, ready to be searched."""

    ids: np.ndarray
    exact: np.ndarray  # vectors
    apart: np.ndarray
    routes: np.ndarray  # points of the nodes' routing objects
    radius: np.ndarray
    up: np.ndarray
    first: list[int]
    many: list[int]
    leaf: list[bool]
    longest_sq: int

    @staticmethod
    def of(row, longest_sq: int) -> Page:
        ids = np.asarray(row.ids, np.int64)
        v = np.asarray(row.v, np.int64).reshape(len(ids), -1)
        exact = v.astype(np.float64) if longest_sq < 1 << 52 else v  # floats hold such integers exactly
        return Page(ids, exact, np.asarray(row.apart), _points(v[np.asarray(row.at)], longest_sq), np.asarray(row.radius), np.asarray(row.up), list(row.first), list(row.many), list(row.leaf), longest_sq)

    def search(self, query_id: int, query: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of the rows that may be among the k best: scores of ``least`` or more, best first."""
        q = query.astype(np.float64)
        whole = query.astype(self.exact.dtype)
        q_point = np.r_[q, 0.0]
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        most_sq = float(q @ q) + self.longest_sq
        margin = 1e-6 * math.sqrt(self.longest_sq) + 1e-6

        def reach() -> float:
            """The distance beyond which no row can enter."""
            bar = best[0][0] if len(best) == k else least
            return math.sqrt(max(0.0, most_sq - 2 * bar)) + margin if bar > -math.inf else math.inf

        d0 = float(_far(self.routes[:1], q_point)[0])
        queue = [(max(0.0, d0 - self.radius[0]), 0, d0)]
        limit = reach()
        while queue:
            bound, node, d = heapq.heappop(queue)
            if bound > limit:
                break
            lo, hi = self.first[node], self.first[node] + self.many[node]
            if not self.leaf[node]:
                near = lo + np.flatnonzero(np.abs(d - self.up[lo:hi]) - self.radius[lo:hi] <= limit)
                if len(near):
                    apart = _far(self.routes[near], q_point)
                    low = np.maximum(apart - self.radius[near], 0.0)
                    for b, n, a in zip(low.tolist(), near.tolist(), apart.tolist()):
                        if b <= limit:
                            heapq.heappush(queue, (b, n, a))
                continue
            rows = lo + np.flatnonzero(np.abs(d - self.apart[lo:hi]) <= limit)
            if not len(rows):
                continue
            scores = self.exact[rows] @ whole
            bar = best[0][0] if len(best) == k else least
            for at in np.flatnonzero(scores >= bar).tolist():
                if (i := int(self.ids[rows[at]])) == query_id:
                    continue
                entry = (int(scores[at]), -i)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            limit = reach()
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(nr, id, v) of the rows that take part, nr a number of the row and v the components as integers."""
    x = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.lit(float(SCALE)) * c.cast("double")
    length_sq = F.aggregate(x, F.lit(0.0), lambda a, c: a + scaled(c) * scaled(c))  # in doubles, which don't overflow
    v = F.when(length_sq < LONGEST_SQ, F.transform(x, lambda c: F.floor(scaled(c))))
    made = vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("v is not null")
    return made.select(F.monotonically_increasing_id().alias("nr"), "id", "v")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k highest inner products."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = stored(_prepared(vectors, id_col, vector_col))
    length_sq = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    n, longest_sq, width = rows.agg(F.count("*"), F.max(length_sq), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    wanted = max(1, min(ROUTES, n // PAGE))
    drawn = rows.select("nr", "v").orderBy(F.xxhash64("nr"), "nr").limit(wanted).collect()  # ROUTES rows at most
    points = _points(_matrix([r["v"] for r in drawn], width), longest_sq)
    points_sq = (points**2).sum(axis=1)
    margin = 4e-6 * math.sqrt(longest_sq) + 1e-6  # of distances by products, where large squares cancel out

    def far(p: np.ndarray) -> np.ndarray:
        """Distances (rows, routes)."""
        return np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + points_sq - 2 * (p @ points.T), 0))

    def assign(batches):
        for whole in batches:
            for at in range(0, len(whole), 2048):
                pdf = whole.iloc[at : at + 2048]
                d = far(_points(_matrix(pdf["v"], width), longest_sq))
                route = d.argmin(axis=1)
                yield pdf.assign(route=route.astype("int32"), apart=d[np.arange(len(pdf)), route])

    dealt = stored(rows.mapInPandas(assign, "nr long, id long, v array<long>, route int, apart double"))
    drop_stored(rows)
    sizes = {r["route"]: (r["n"], r["radius"]) for r in dealt.groupBy("route").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # ROUTES rows at most
    pages_of = {r: max(1, math.ceil(c / PAGE)) for r, (c, _) in sizes.items()}
    radius = np.array([sizes[j][1] if j in sizes else -1.0 for j in range(len(points))])
    many = F.create_map(*[F.lit(x) for r, c in pages_of.items() for x in (r, c)])[F.col("route")]

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        page = build(pdf["id"].to_numpy(), _matrix(pdf["v"], width), int(longest_sq))
        return pd.DataFrame({"route": pdf["route"].iloc[:1], "page": pdf["page"].iloc[:1]} | {c: [x] for c, x in page.items()})

    page_nr = F.pmod(F.xxhash64("nr"), many.cast("long")).cast("int")
    pages = stored(dealt.select("id", "v", "route", page_nr.alias("page")).groupBy("route", "page").applyInPandas(built, STORED_PAGE))
    queries = dealt.filter(F.col("id") % every == 0).select("nr", "id", "v")

    def bounds(v: np.ndarray) -> np.ndarray:
        """(queries, routes): the highest score that a route's covering radius allows."""
        q = np.c_[v, np.zeros((len(v), 1))]
        low = np.maximum(far(q) - radius - margin, 0)
        top = ((q * q).sum(axis=1)[:, None] + longest_sq - low**2) / 2
        return np.where(radius < 0, -np.inf, top + 1e-6 * abs(top) + 1)

    def plan(first: bool):
        """A row for every page that a query visits."""

        def run(batches):
            for whole in batches:
                for start in range(0, len(whole), 64):
                    pdf = whole.iloc[start : start + 64]
                    out = []
                    for row, top in zip(pdf.itertuples(index=False), bounds(_matrix(pdf["v"], width).astype(np.float64))):
                        best = int(top.argmax())
                        for r in [best] if first else [r for r in np.flatnonzero(top >= row.least).tolist() if r != best]:
                            out += [(row.nr, row.id, row.v, r, p, row.least) for p in range(pages_of[r])]
                    yield pd.DataFrame(out, columns=["nr", "id", "v", "route", "page", "least"])

        return run

    def visit(page_pdf: pd.DataFrame, query_pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(page_pdf) and len(query_pdf):
            page = Page.of(next(page_pdf.itertuples(index=False)), int(longest_sq))
            for row, q in zip(query_pdf.itertuples(index=False), _matrix(query_pdf["v"], width)):
                out += [(row.nr, row.id, i, s) for s, i in page.search(row.id, q, k, row.least)]
        return pd.DataFrame({c: [x[j] for x in out] for j, c in enumerate(("nr", "query_id", "vec_id", "score"))}, dtype="int64")

    key = ["route", "page"]

    def round_of(asked: DataFrame, first: bool) -> DataFrame:
        asked = stored(asked.mapInPandas(plan(first), "nr long, id long, v array<long>, route int, page int, least double"))
        shares = asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).alias("shares"))
        asked = asked.join(shares, key).withColumn("share", F.pmod(F.xxhash64("nr"), F.col("shares"))).drop("shares")
        visited = pages.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
        return visited.groupBy(*key, "share").cogroup(asked.groupBy(*key, "share")).applyInPandas(visit, "nr long, query_id long, vec_id long, score long")

    best_first = W.partitionBy("nr").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    none = F.lit(float("-inf"))
    one = stored(ranked(round_of(queries.withColumn("least", none), True)).drop("rank"))
    if len(sizes) > 1:
        bars = one.groupBy("nr").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bar"))
        asked = queries.join(bars, "nr", "left").select("nr", "id", "v", F.coalesce("bar", none).alias("least"))
        one = one.union(round_of(asked, False))
    return ranked(one).select("query_id", "rank", "vec_id", "score")
