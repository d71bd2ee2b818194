"""Near duplicates of embeddings by hierarchical navigable small-world graphs.

Rows of one label (and length) are dealt into shards of about ``SHARD_ROWS``
vectors; each shard's graph is built in one task and stored. Every vector
queries every shard of its label: greedy descent through the upper layers, a
beam on the ground layer, then expansion along the graph to all vectors near
enough. Each task audits its recall against brute force over the shard, on a
seeded sample of its queries and on planted queries: slightly moved members of
the shard, which must be found, so that the audit measures also where no sampled
query has a link. Recall counts by query, not by link, and must be enough for
each class of queries by their number of links; until then the beam is doubled
(at the last, the task compares with the whole shard). Links are verified by
cosine in double precision on the original vectors.

Equal vectors are one node with a multiplicity, so copies cost nothing. A task
returns only sums of links and a spanning forest of the links it found, never
the links themselves; components are united from the forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
parts, and rows with a null label, link with nothing; repeated rows (same id,
label and vector) are one vector, shown once per row; a null id is a vector
like others but cannot name a component; an empty table gives no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscreen.llm.common import store
from promptscreen.llm.near import components

LEAST = 0.98
SHARD_ROWS = 16_384         # vectors of a shard, and of a block of queries
M = 8                       # links of a node on the upper layers; twice as many on the ground
BEAM, BUILD_BEAM, STEP = 24, 32, 256
AUDIT, AUDIT_RECALL = 256, 0.99
PLANTED, FEW = 128, 4       # planted queries of the audit for each kind of member; near links of a member of a large group
WALK = 0.03                 # the expansion also walks over vectors this much below the threshold


# ------------------------------------------------------------------- graph ----
def _diverse(sim_q: np.ndarray, pair: np.ndarray, m: int) -> np.ndarray:
    """Which of the candidates (sorted, best first) to link: those nearer to
    the node than to any chosen before; free places go to the next best."""
    b, c = sim_q.shape
    chosen, valid = np.zeros((b, c), bool), np.isfinite(sim_q)
    for k in range(c):
        near = np.where(chosen, pair[:, k, :], -np.inf).max(1)
        chosen[:, k] = valid[:, k] & (near < sim_q[:, k]) & (chosen.sum(1) < m)
    rest = valid & ~chosen
    free = m - chosen.sum(1)
    return chosen | (rest & (np.cumsum(rest, 1) <= free[:, None]))


class Graph:
    """Layers of links over the unit vectors ``x``; ``links[l]`` is (n, m) with -1 for none."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        self.back = None
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 8) if n else np.zeros(0, int)
        if n:
            level[0] = level.max() + 1          # the first node is on all layers: the entry
        self.links = [np.full((n, M if k else 2 * M), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        for at in range(0, n, STEP):
            self._add(np.arange(at, min(n, at + STEP)), level, at)

    def _add(self, new: np.ndarray, level: np.ndarray, done: int):
        entry = np.zeros(len(new), np.int64)
        for k in range(len(self.links) - 1, -1, -1):
            ids, sims = self._beam(self.x[new], entry, k, BUILD_BEAM if k == 0 else M, done) if done else (
                np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf))
            if done:
                entry = np.where(ids[:, 0] >= 0, ids[:, 0], 0)
            here = level[new] >= k
            if here.any():
                self._link(new[here], ids[here], sims[here], k)

    def _link(self, new, ids, sims, k):
        """Link ``new`` nodes on layer ``k`` to what the beam found and to each other."""
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -np.inf)
        width = min(BUILD_BEAM, max(1, len(new) - 1))
        near = np.argpartition(-own, width - 1, 1)[:, :width] if len(new) > 1 else np.zeros((1, 0), int)
        ids = np.concatenate([ids, new[near]], 1)
        sims = np.concatenate([np.where(ids[:, :sims.shape[1]] >= 0, sims, -np.inf), np.take_along_axis(own, near, 1)], 1)
        picked = self._choose(ids, sims, M)
        self._store(new, picked, k)
        # the way back: every target gets the new nodes as candidates
        row, col = np.nonzero(picked >= 0)
        target, source = picked[row, col], new[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        values, start, count = np.unique(target, return_index=True, return_counts=True)
        cap = self.links[k].shape[1]
        for lo in range(0, len(values), 1024):
            v, s, c = values[lo:lo + 1024], start[lo:lo + 1024], count[lo:lo + 1024]
            wide = np.full((len(v), cap + int(c.max())), -1, np.int64)
            wide[:, :cap] = self.links[k][v]
            at = np.repeat(np.arange(len(v)), c)
            place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            wide[at, cap + place] = source[s[0]:s[0] + int(c.sum())]
            wide = np.sort(wide, 1)[:, ::-1]
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            room = (wide >= 0).sum(1) <= cap
            sims = np.where(wide >= 0, np.einsum("td,tkd->tk", self.x[v], self.x[np.maximum(wide, 0)]), -np.inf)
            if room.any():
                order2 = np.argsort(-sims[room], 1)[:, :cap]
                self._store(v[room], np.take_along_axis(wide[room], order2, 1), k)
            if (~room).any():
                self._store(v[~room], self._choose(wide[~room], sims[~room], cap), k)

    def _store(self, nodes, picked, k):
        row = np.full((len(nodes), self.links[k].shape[1]), -1, np.int32)
        row[:, :picked.shape[1]] = picked
        self.links[k][nodes] = row

    def _choose(self, ids, sims, m):
        order = np.argsort(-sims, 1)[:, :max(BUILD_BEAM, m + m // 2)]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(ids, 0)]
        keep = _diverse(sims, v @ v.transpose(0, 2, 1), m)
        ids = np.where(keep, ids, -1)
        return np.take_along_axis(ids, np.argsort(~keep, 1, kind="stable"), 1)[:, :m]

    def _beam(self, q, entry, k, ef, n=None, wide=2):
        """Beam search of all queries side by side: (ids, similarities), best first."""
        n, links, b = len(self.x) if n is None else n, self.links[k], len(q)
        ids, sims = np.full((b, ef), -1, np.int64), np.full((b, ef), -np.inf, np.float32)
        spent, seen = np.zeros((b, ef), bool), np.zeros((b, n), bool)
        ids[:, 0], sims[:, 0] = entry, np.einsum("bd,bd->b", q, self.x[entry])
        seen[np.arange(b), entry] = True
        live = np.arange(b)
        while len(live):
            open_sim = np.where(spent[live] | (ids[live] < 0), -np.inf, sims[live])
            w = min(wide, ef)
            best = np.argpartition(-open_sim, w - 1, 1)[:, :w] if ef > w else np.argsort(-open_sim, 1)[:, :w]
            can = np.isfinite(np.take_along_axis(open_sim, best, 1))
            go = can.any(1)
            live, best, can = live[go], best[go], can[go]
            if not len(live):
                break
            spent[live[:, None], best] |= can
            near = links[np.where(can, ids[live[:, None], best], 0)]
            near = np.where(can[:, :, None], near, -1).reshape(len(live), -1)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[live[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("rd,rd->r", q[live[r]], self.x[near[r, c]])
            all_s = np.concatenate([sims[live], s], 1)
            order = np.argsort(-all_s, 1, kind="stable")[:, :ef]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
            spent[live] = np.take_along_axis(np.concatenate([spent[live], np.zeros(near.shape, bool)], 1), order, 1)
            sims[live] = np.take_along_axis(all_s, order, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The (about) ``ef`` nearest nodes of each query."""
        q, parts = np.asarray(q, np.float32), []
        for at in range(0, len(q), STEP):
            part = q[at:at + STEP]
            entry = np.zeros(len(part), np.int64)
            for k in range(len(self.links) - 1, 0, -1):
                entry = self._beam(part, entry, k, 2)[0][:, 0]
            parts.append(self._beam(part, entry, 0, ef))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def within(self, q: np.ndarray, first: np.ndarray, least: float) -> np.ndarray:
        """All nodes of similarity ``least`` or more that links lead to from
        ``first``, followed both ways (a pruned link still leads back)."""
        if self.back is None:
            to = self.links[0].ravel()
            source = np.repeat(np.arange(len(self.x)), self.links[0].shape[1])[to >= 0]
            to = to[to >= 0]
            order = np.argsort(to, kind="stable")
            self.back = source[order], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(self.x)))])
        source, off = self.back
        seen = np.zeros(len(self.x), bool)
        seen[first] = True
        found, edge = [first], first
        while len(edge):
            near = np.unique(np.concatenate([self.links[0][edge].ravel(), *(source[off[e]:off[e + 1]] for e in edge.tolist())]))
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            edge = near[self.x[near] @ q >= least]
            found.append(edge)
        return np.concatenate(found)


def planted(graph: Graph, least: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors moved from members of the shard by up to the threshold's
    angle: as many from members with no near one among their links, with a few
    and with many, so that members of small groups are asked for at any size."""
    x = graph.x.astype(np.float64)
    links = graph.links[0]
    near = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1024):
        to = links[at:at + 1024]
        near[at:at + 1024] = ((np.einsum("nd,nkd->nk", graph.x[at:at + 1024], graph.x[to]) >= least) & (to >= 0)).sum(1)
    picked = [rng.permutation(np.flatnonzero(c))[:PLANTED] for c in (near == 0, (near > 0) & (near < FEW), near >= FEW)]
    x = x[np.concatenate(picked)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= np.einsum("nd,nd->n", side, x)[:, None] * x
    size = np.linalg.norm(side, axis=1)
    side = np.where(size[:, None] > 1e-6, side / np.maximum(size, 1e-6)[:, None], 0)      # one dimension has no side
    angle = (0.999 * np.arccos(np.clip(least, -1, 1)) * rng.random(len(x)))[:, None]
    x = np.cos(angle) * x + np.sin(angle) * side
    return x / np.linalg.norm(x, axis=1)[:, None]


def passed(got: list[np.ndarray], truth: list[np.ndarray]) -> bool:
    """Whether the mean recall of the queries is enough, in each class of
    queries by their number of true links. Queries without any tell nothing;
    if there are no others, nothing was measured and nothing is passed."""
    recall: dict[int, list[float]] = {}
    for a, b in zip(got, truth, strict=True):
        if len(b):
            recall.setdefault((len(b).bit_length() - 1) // 2, []).append(len(np.intersect1d(a, b)) / len(b))
    return bool(recall) and all(np.mean(r) >= AUDIT_RECALL for r in recall.values())


def links_of(graph: Graph, raw: np.ndarray, norm: np.ndarray, queries: np.ndarray, q_norm: np.ndarray, least: float,
             own: np.ndarray, seed: int = 3) -> tuple[list[np.ndarray], int]:
    """For each query the nodes with cosine ``least`` or more (without node
    ``own``), and the beam that passed the audit."""
    def verified(nodes, q, size, self):
        nodes = nodes[(raw[nodes] @ q) / (norm[nodes] * size) >= least]
        return np.sort(nodes[nodes != self])

    def whole(*asked):
        return [verified(np.arange(len(raw)), *a) for a in zip(*asked, strict=True)]

    def by_beam(ef, q, size, self):
        unit = (q / size[:, None]).astype(np.float32)
        ids, sims = graph.search(unit, ef)
        out = []
        for row, i in enumerate(unit):
            near = ids[row][(ids[row] >= 0) & (sims[row] >= least - WALK)]
            out.append(verified(graph.within(i, near, least - WALK), q[row], size[row], self[row]) if len(near) else near)
        return out

    rng = np.random.default_rng(seed)
    some = rng.permutation(len(queries))[:AUDIT]
    moved = planted(graph, least, rng)
    audits = [(queries[some], q_norm[some], own[some]), (moved, np.ones(len(moved)), np.full(len(moved), -1))]
    truth = [whole(*a) for a in audits]
    open_ = [k for k, t in enumerate(truth) if any(map(len, t))]       # the planted queries always have true links
    ef = BEAM
    while 4 * ef < len(raw):                                           # beyond, the whole shard costs less than the beam
        open_ = [k for k in open_ if not passed(by_beam(ef, *audits[k]), truth[k])]
        if not open_:
            return by_beam(ef, queries, q_norm, own), ef
        ef *= 2
    return whole(queries, q_norm, own), len(raw)


# ------------------------------------------------------------------- Spark ----
def _unpack(blobs, d):
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), d)


def _build(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("cid", ignore_index=True)
    raw = _unpack(df["v"], int(df["d"].iloc[0]))
    graph = Graph(raw / np.linalg.norm(raw, axis=1)[:, None])
    out = io.BytesIO()
    np.savez(out, cid=df["cid"].to_numpy(), copies=df["copies"].to_numpy(), raw=raw, **{f"l{k}": x for k, x in enumerate(graph.links)})
    return pd.DataFrame({"label": df["label"][:1], "d": df["d"][:1], "shard": df["shard"][:1], "graph": [out.getvalue()]})


def _open(blob: bytes):
    z = np.load(io.BytesIO(blob))
    raw = z["raw"]
    norm = np.linalg.norm(raw, axis=1)
    g = Graph.__new__(Graph)
    g.x = (raw / norm[:, None]).astype(np.float32)
    g.back = None
    g.links = [z[f"l{k}"] for k in range(sum(name.startswith("l") for name in z.files))]
    return g, z["cid"], z["copies"], raw, norm


def _query(least, queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
    """Links of a block of queries in one shard: their number (``b`` null), and
    a spanning forest of them (pairs ``a``, ``b``)."""
    none = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
    if not len(queries) or not len(graphs):
        return none
    g, cid, copies, raw, norm = _open(graphs["graph"].iloc[0])
    queries = queries.sort_values("cid", ignore_index=True)
    q = _unpack(queries["v"], raw.shape[1])
    q_cid = queries["cid"].to_numpy()
    at = np.minimum(np.searchsorted(cid, q_cid), len(cid) - 1)
    own = np.where(cid[at] == q_cid, at, -1)
    found, _ = links_of(g, raw, norm, q, np.linalg.norm(q, axis=1), least, own)
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows, forest = [], []
    for c, nodes in zip(q_cid.tolist(), found, strict=True):
        if len(nodes):
            rows.append((c, int(copies[nodes].sum())))
            for other in cid[nodes].tolist():
                a, b = top(c), top(other)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    forest.append((c, other))
    return pd.concat([none, pd.DataFrame({"a": [r[0] for r in rows], "b": pd.array([None] * len(rows), "Int64"), "n": [r[1] for r in rows]}).astype({"a": "int64", "n": "int64"}),
                      pd.DataFrame({"a": [f[0] for f in forest], "b": pd.array([f[1] for f in forest], "Int64"), "n": 0}).astype({"a": "int64", "n": "int64"})])


def _pack(batches):
    """Valid vectors as packed doubles, scaled by a power of two if extreme."""
    for df in batches:
        packed = []
        for v in df["embedding"]:
            x = None if v is None else np.array([np.nan if e is None else e for e in v], np.float64)
            ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
            if ok:
                top = np.abs(x).max()
                if not 1e-60 < top < 1e60:
                    x = np.ldexp(x, -int(np.frexp(top)[1]))
            packed.append(x.tobytes() if ok else None)
        yield pd.DataFrame({"vec_id": df["vec_id"].astype("Int64"), "label": df["label"], "v": packed})


def near_vectors(vectors: DataFrame, least: float = LEAST, shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id",
                 embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``."""
    src = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"),
                         F.col(label).cast("string").alias("label"))
    rows = store(src.mapInPandas(_pack, "vec_id long, label string, v binary")
                 .withColumn("v", F.when(F.col("label").isNotNull(), F.col("v")))
                 .withColumn("d", (F.length("v") / 8).cast("int")).withColumn("cid", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))), "vectors")
    nodes = (rows.filter("cid is not null").select("vec_id", "label", "d", "cid", "v").groupBy("cid")
             .agg(F.countDistinct(F.coalesce(F.col("vec_id").cast("string"), F.lit("-"))).alias("copies"), F.first("label").alias("label"),
                  F.first("d").alias("d"), F.first("v").alias("v"), F.min("vec_id").alias("low")))
    nodes = store(nodes, "nodes")
    sizes = nodes.groupBy("label", "d").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    placed = nodes.join(sizes, ["label", "d"])
    shard = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("shards")).cast("int")
    key = ["label", "d", "shard"]
    graphs = store(placed.withColumn("shard", shard).select(*key, "cid", "copies", "v").groupBy(*key)
                   .applyInPandas(_build, "label string, d int, shard int, graph binary"), "graphs")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    block = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("shards")).cast("int")
    asked = placed.select("label", "d", "cid", "v", block.alias("block"), every.alias("shard"))     # every query to every shard
    served = graphs.join(sizes, ["label", "d"]).select(*key, "graph", every.alias("block"))
    by = [*key, "block"]
    answers = store(asked.groupBy(*by).cogroup(served.groupBy(*by)).applyInPandas(
        lambda q, g: _query(least, q, g), "a long, b long, n long"), "vector-links")
    counts = answers.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comp = components(answers.filter("b is not null")).toDF("cid", "comp")
    named = nodes.select("cid", "copies", "low").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    info = (named.join(lows, "comp").join(counts, "cid", "left")
            .select("cid", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("vec_id", "cid").join(info, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
