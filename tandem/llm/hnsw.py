"""Approximate nearest neighbours: one HNSW graph per shard, shard results merged (operator 7).

Index: distinct vectors are dealt, per vector length, to shards of about ``shard_rows`` by a hash. A shard's graph has
layers (a node's top layer is drawn from its hash, 1 in ``fan`` per layer). A layer is built by insertion: nodes come in
batches, each searches the graph built so far with a beam for its candidates (its own batch is compared directly),
keeps up to ``degree`` of them by the diversity rule of HNSW, and the chosen ones link back to their nearest. Layers
are stored as flat neighbour arrays, one row per shard, written once.

Search: queries travel to the shards of their length, in groups of about ``QUERY_GROUP``, each group with one copy of the
shard; they descend greedily through the layers and run a beam of ``beam`` in the bottom layer, all queries of a block in
step. The best ``k`` of every shard, scored in double precision on the original vectors (scaled by powers of two, which
changes no digit of a cosine), are merged with a window per query. Vectors equal in every component are one node that
carries its least ids, so ties come out exactly.

Recall depends on ``beam`` and ``degree``; the tests hold it against brute force.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as
query or candidate; nor do rows with a null id; a cosine is defined for vectors of one length, so rows of another length
are no candidates; a repeated row (same id and vector) counts once; with fewer than k candidates all are returned; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, pick, stored

SHARD_ROWS, DEGREE, BEAM, FAN, QUERY_BLOCK, CANDIDATES = 8192, 16, 96, 16, 512, 48
QUERY_GROUP, FIRST_NODES, EXPANDED = 1 << 15, 128, 4
INDEX = ("dim int, shard int, n int, ids binary, n_ids binary, vectors binary, layers array<binary>, members array<binary>")


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector can take part; v is array<double>."""
    v = F.col("v")
    rows = pick(df, id=id_col, v=vector_col).select("id", F.col("v").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine
                      & F.exists(v, lambda x: x != 0.0)).dropDuplicates(["id", "v"])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its greatest component to 1 or below: no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _diverse(x: np.ndarray, top: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (numbers ``top`` in ``x``, -1 where none, nearest first) up to ``degree``: those nearer to
    the row than to any chosen one, then the nearest of the rest."""
    near = x[np.maximum(top, 0)]
    between = near @ near.transpose(0, 2, 1)
    taken = np.zeros(top.shape, dtype=bool)
    for j in range(top.shape[1]):
        rival = np.where(taken, between[:, j, :], -2).max(axis=1)
        taken[:, j] = (top[:, j] >= 0) & (sim[:, j] > rival) & (taken.sum(axis=1) < degree)
    rank = np.argsort(np.where(taken, 0, np.where(top >= 0, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.full((len(top), degree), -1, dtype=np.int32)
    out[:, : rank.shape[1]] = np.take_along_axis(top, rank, axis=1)
    return out


def build_layer(unit: np.ndarray, members: np.ndarray, degree: int) -> np.ndarray:
    """Flat neighbour array (len(members) x 2*degree, -1 where none) of positions in ``members``: first the chosen
    neighbours of a node, then its nearest links back. Nodes are inserted in batches in the order of ``members``."""
    x, n = unit[members], len(members)
    out = np.full((n, 2 * degree), -1, dtype=np.int32)
    back = np.full((n, degree), -3.0, dtype=np.float32)  # similarities of the links back
    done = 0
    while done < n:
        hi = min(n, FIRST_NODES if done == 0 else done + min(QUERY_BLOCK, max(FIRST_NODES, done // 4)))
        own = np.arange(done, hi)
        sim = x[own] @ x[own].T  # within the batch: directly
        sim[own - done, own - done] = -2
        near = min(len(own) - 1, CANDIDATES)
        top = np.argpartition(-sim, max(near - 1, 0), axis=1)[:, :near] + done if near > 0 else np.zeros((len(own), 0), dtype=np.int64)
        score = np.take_along_axis(sim, top - done, axis=1)
        if done:  # in the graph so far: by search from the nearest of the first nodes
            entry = (x[own] @ x[: min(done, FIRST_NODES)].T).argmax(axis=1)
            node, found = beam_search(x[:done], out, entry, x[own], min(CANDIDATES, done))
            top, score = np.concatenate([node, top], axis=1), np.concatenate([np.where(node < 0, -2, found), score], axis=1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :CANDIDATES]
        top, score = np.take_along_axis(top, order, axis=1), np.take_along_axis(score, order, axis=1)
        out[own, :degree] = chosen = _diverse(x, top, score, degree)
        src, dst = np.repeat(own, degree), chosen.ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        fresh = ~(out[dst, :degree] == src[:, None]).any(axis=1)  # else the link is there already
        src, dst = src[fresh], dst[fresh]
        hit = np.unique(dst)
        held, col = np.nonzero(out[hit, degree:] >= 0)
        src = np.concatenate([src, out[hit[held], degree + col]])
        near_of = np.concatenate([np.einsum("ij,ij->i", x[src[: len(dst)]], x[dst]), back[hit[held], col]])
        dst = np.concatenate([dst, hit[held]])
        order = np.lexsort((-near_of, dst))
        src, dst, near_of = src[order], dst[order], near_of[order]
        nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
        fits = nth < degree
        out[hit, degree:], back[hit] = -1, -3.0
        out[dst[fits], degree + nth[fits]], back[dst[fits], nth[fits]] = src[fits], near_of[fits]
        done = hi
    return out


def build_graph(keys: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, fan: int = FAN):
    """(members, layers), bottom first: node numbers of each layer and its flat neighbour array."""
    unit, members, layers, level = _unit(vectors), [], [], mix(keys.astype(np.uint64))
    own = np.arange(len(vectors), dtype=np.int32)
    while True:
        members.append(own)
        layers.append(build_layer(unit, own, degree))
        up = own[level[own] % np.uint64(fan ** len(members)) == 0]
        if len(up) < 2 or len(own) <= fan:
            return members, layers
        own = up


def search_graph(unit: np.ndarray, members: list[np.ndarray], layers: list[np.ndarray], queries: np.ndarray,
                 beam: int = BEAM) -> np.ndarray:
    """Node numbers of the beam of each query (len(queries) x beam, -1 where none)."""
    q, n = len(queries), len(unit)
    at = np.zeros(q, dtype=np.int64)  # position in the current layer
    for depth in range(len(layers) - 1, 0, -1):
        own, layer = members[depth], layers[depth]
        best = np.einsum("ij,ij->i", unit[own[at]], queries)
        moving = np.arange(q)
        while len(moving):
            nb = layer[at[moving]]
            s = np.einsum("qmd,qd->qm", unit[own[np.maximum(nb, 0)]], queries[moving])
            s[nb < 0] = -2
            j = s.argmax(axis=1)
            better = s[np.arange(len(j)), j] > best[moving]
            moving, j, s, nb = moving[better], j[better], s[better], nb[better]
            at[moving], best[moving] = nb[np.arange(len(j)), j], s[np.arange(len(j)), j]
        at = np.searchsorted(members[depth - 1], own[at])
    return beam_search(unit, layers[0], at, queries, min(beam, n))[0]


def beam_search(x: np.ndarray, layer: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes of ``x`` found from ``entry`` on for each query, and their scores (node -1 where none)."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n), dtype=bool)
    node = np.full((q, width), -1, dtype=np.int64)
    score = np.full((q, width), -2.0, dtype=np.float32)
    done = np.ones((q, width), dtype=bool)
    rows = np.arange(q)
    node[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", x[entry], queries), False
    seen[rows, entry] = True
    expanded = min(EXPANDED, width)
    while len(rows):  # of each query the best nodes not yet looked at, a few at a time
        open_score = np.where(done[rows], -3, score[rows])
        j = np.argpartition(-open_score, expanded - 1, axis=1)[:, :expanded]
        is_open = np.take_along_axis(open_score, j, axis=1) > -2
        keep = is_open.any(axis=1)
        rows, j, is_open = rows[keep], j[keep], is_open[keep]
        if not len(rows):
            break
        done[rows[:, None], j] = True
        nb = np.where(is_open[:, :, None], layer[np.maximum(node[rows[:, None], j], 0)], -1).reshape(len(rows), -1).astype(np.int64)
        nb.sort(axis=1)
        fresh = (nb >= 0) & ~seen[rows[:, None], np.maximum(nb, 0)]
        fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        r, c = np.nonzero(fresh)
        seen[rows[r], nb[r, c]] = True
        s = np.full(nb.shape, -2.0, dtype=np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[nb[r, c]], queries[rows[r]])
        all_s = np.concatenate([score[rows], s], axis=1)
        all_n = np.concatenate([node[rows], np.where(fresh, nb, -1)], axis=1)
        all_d = np.concatenate([done[rows], ~fresh], axis=1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        score[rows], node[rows], done[rows] = (np.take_along_axis(v, top, axis=1) for v in (all_s, all_n, all_d))
    return np.where(score > -2, node, -1), score


def build_index(vectors: DataFrame, keep_ids: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> tuple[DataFrame, DataFrame]:
    """One stored row per length and shard from (id, v), and the number of shards per length (dim, shards); a node carries
    the least ``keep_ids`` ids of its vector."""
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = (vectors.withColumn("nth", least).where(F.col("nth") <= keep_ids).groupBy("v")
             .agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.xxhash64("v")).withColumn("dim", F.size("v")))
    nodes = stored(nodes, "hnsw-nodes")
    shards = stored(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "hnsw-shards")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        members, layers = build_graph(group["key"].to_numpy(), x, degree)
        return pd.DataFrame({
            "dim": [x.shape[1]], "shard": [int(group["shard"].iloc[0])], "n": [len(x)],
            "ids": [np.concatenate(group["ids"].to_numpy()).astype(np.int64).tobytes()],
            "n_ids": [group["ids"].str.len().to_numpy().astype(np.int32).tobytes()], "vectors": [x.tobytes()],
            "layers": [[a.tobytes() for a in layers]], "members": [[a.astype(np.int32).tobytes() for a in members]]})

    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).drop("shards")
    return stored(dealt.groupBy("dim", "shard").applyInPandas(build, INDEX), "hnsw-index"), shards


class Shard:
    """One shard of the index, ready to be searched."""

    def __init__(self, row: pd.Series):
        n, dim = row["n"], row["dim"]
        self.x = _scaled(np.frombuffer(row["vectors"]).reshape(n, dim))
        self.unit, self.norm = _unit(self.x), np.sqrt((self.x ** 2).sum(axis=1))
        self.counts = np.frombuffer(row["n_ids"], dtype=np.int32)
        self.ids, self.first = np.frombuffer(row["ids"], dtype=np.int64), np.concatenate([[0], np.cumsum(self.counts)])
        self.members = [np.frombuffer(m, dtype=np.int32) for m in row["members"]]
        self.layers = [np.frombuffer(a, dtype=np.int32).reshape(len(m), -1) for a, m in zip(row["layers"], self.members, strict=True)]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> pd.DataFrame:
        q = _scaled(q)
        found = search_graph(self.unit, self.members, self.layers, _unit(q), beam)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = (self.x[node] * q[row]).sum(axis=1) / (self.norm[node] * np.sqrt((q[row] ** 2).sum(axis=1)))
        times = self.counts[node]
        at = np.repeat(self.first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out = pd.DataFrame({"query_id": np.repeat(q_ids[row], times), "vec_id": self.ids[at], "score": np.repeat(score, times)})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id", sort=False).head(k)


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for each row of ``queries`` (same columns), by cosine, not
    counting the query's own id: query_id, rank (from 1), vec_id, score; ties go to the lesser id."""
    index, shards = build_index(clean_vectors(df, id_col, vector_col), k + 1, shard_rows, degree)
    asked = clean_vectors(queries, id_col, vector_col).withColumn("dim", F.size("v"))
    asked = stored(asked, "hnsw-queries")
    # groups of queries that meet a shard together; the shard is copied once per group
    groups = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_GROUP).cast("int").alias("groups")).join(shards, "dim")
    groups = stored(groups, "hnsw-groups")
    sent = asked.join(groups, "dim").select(
        "id", "v", "dim", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    copies = index.join(groups.select("dim", "groups"), "dim").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        graph, parts = Shard(shard.iloc[0]), []
        for lo in range(0, len(block), QUERY_BLOCK):
            part = block.iloc[lo:lo + QUERY_BLOCK]
            parts.append(graph.search(part["id"].to_numpy(dtype=np.int64), np.stack(part["v"].to_numpy()).astype(np.float64), k, beam))
        return pd.concat(parts)

    key = ["dim", "shard", "part"]
    found = copies.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
