"""Approximate nearest neighbours by NN-descent and greedy graph search.

Largest inner product becomes least distance by one more component,
sqrt(M^2 - |x|^2), with M the largest norm. Equal vectors are one node. The
graph starts from blocks of a random projection order; NN-descent rounds
then offer each node's neighbours to each other. Queries walk the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwise.llm.common import stored


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` as doubles; null, zero and non-finite vectors, and null ids, take no part."""
    ok = (F.col("vec_id").isNotNull() & (F.size("v") > 0)
          & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
          & F.exists("v", lambda x: x != 0))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(ok)


def _classes(vectors: DataFrame, copies: int) -> DataFrame:
    """``(node, v, members)``: one row per distinct vector with its ``copies`` smallest ids."""
    first = Window.partitionBy("v").orderBy("vec_id")
    return (vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= copies)
            .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
            .select(F.col("members")[0].alias("node"), "v", "members"))


def _codes(nodes: DataFrame, dim: int, top: float) -> DataFrame:
    """Add ``code``: the vector to steer by, in 16-bit steps of its own largest component.

    Before the components stand the step, the square of the norm and the gap,
    ``M`` less the component sqrt(M^2 - |x|^2): the same distances, but no
    large constant that would drown the others. Products of such numbers are
    exact, so a pair has the same distance wherever it is met.
    """
    def run(v):
        x = _matrix(v, dim)
        step = np.abs(x).max(1) / 32767
        q = np.rint(x / np.where(step > 0, step, 1)[:, None])
        square = (q * q).sum(1) * step * step
        gap = square / (top + np.sqrt(np.maximum(top * top - square, 0)))
        head = np.c_[step, square, gap]
        return pd.Series([h.tobytes() + r.tobytes() for h, r in zip(head, q.astype("<i2"))])
    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return nodes.withColumn("code", F.pandas_udf(run, "binary")("v"))


def _matrix(v, dim):
    out = np.zeros((len(v), dim))
    for k, x in enumerate(v):
        out[k, :len(x)] = x
    return out


def _decode(codes):
    """Step, squared norm and gap (a row each) and the components in steps."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, :24].copy().view("<f8").T, raw[:, 24:].copy().view("<i2").astype(np.float64)


def _sims(head, q, rows):
    """Less the squared distances of ``rows`` from all."""
    (step, square, gap), own = head, head[:, rows]
    dots = (q[rows] @ q.T) * (own[0][:, None] * step)
    return 2 * dots - (own[1][:, None] + square) - (own[2][:, None] - gap) ** 2


_GROUP, _WAYS = 4096, 8
_EDGE = "node long, nbr long, sim double"
_NONE = pd.DataFrame({"node": np.zeros(0, int), "nbr": np.zeros(0, int), "sim": np.zeros(0)})
_RATED = pd.DataFrame({"q": np.zeros(0, int), "c": np.zeros(0, int), "s": np.zeros(0)})


def _near(ids, codes, k, allowed=None):
    """Rows (node, nbr, sim): for each of ``ids`` its ``k`` nearest of the others, where ``allowed(rows, sims)``."""
    k = min(k, len(ids) - 1)
    if k < 1:
        return _NONE
    head, q = _decode(codes)
    out = []
    for at in range(0, len(ids), 256):
        rows = np.arange(at, min(len(ids), at + 256))
        sims = _sims(head, q, rows)
        sims[rows - at, rows] = -np.inf
        if allowed:
            sims[~allowed(rows, sims)] = -np.inf
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, best, 1)
        r, c = np.nonzero(value > -np.inf)
        out.append(pd.DataFrame({"node": ids[rows[r]], "nbr": ids[best[r, c]], "sim": value[r, c]}))
    return pd.concat(out, ignore_index=True)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best edges of each node, the older of two equal ones; a hub's edges are first cut down in sixteen groups."""
    part = edges.groupBy("node", F.pmod("nbr", F.lit(16)).alias("salt")).agg(
        F.sort_array(F.collect_set(F.struct("sim", "nbr", (-F.col("born")).alias("age"))), False).alias("e"))
    once = F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["nbr"] != x["nbr"]))
    whole = part.select("node", F.slice(once, 1, k).alias("e")).groupBy("node").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("e")), False), 1, k).alias("e"))
    return whole.select("node", F.explode("e").alias("e")).select("node", "e.nbr", "e.sim", (-F.col("e.age")).alias("born"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", "born")


def _blocks(nodes: DataFrame, seed: int, k: int, block: int, parts: int) -> DataFrame:
    """Edges inside blocks of a random hyperplane order."""
    def keyed(batches):
        for b in batches:
            head, q = _decode(b["code"])
            x = np.c_[q * head[0][:, None], head[2]]
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], 24))
            bits = (x @ planes > 0).astype(np.int64)
            yield pd.DataFrame({"key": bits @ (1 << np.arange(24)[::-1]), "node": b["node"], "code": b["code"]})

    def near(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while len(held) >= 2 * block:
                yield _near(held["node"].to_numpy()[:block], held["code"][:block], k)
                held = held[block:].reset_index(drop=True)
        if held is not None and len(held):
            yield _near(held["node"].to_numpy(), held["code"], k)
    order = nodes.select("node", "code").mapInPandas(keyed, "key long, node long, code binary")
    return (order.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node").select("node", "code")
            .mapInPandas(near, _EDGE).withColumn("born", F.lit(0)))


def build_graph(nodes: DataFrame, k: int = 32, passes: int = 4, block: int = 1024, least_change: float = 0.002) -> DataFrame:
    """Neighbour graph ``(node, nbr, sim, born)`` of ``nodes(node, code)`` by NN-descent.

    Rounds go on until one changes at most the share ``least_change`` of the
    edges; lists only get better, so this comes. Pairs met before are not
    compared again, and none is offered that the node's list would not take.
    """
    n = nodes.count()
    parts = max(1, n // (4 * block))
    start = _blocks(nodes, 0, k // 2, block, parts)
    for seed in range(1, passes):
        start = start.unionByName(_blocks(nodes, seed, k // 2, block, parts))
    graph = stored(_best(start, k), "knn-graph")
    edges, born = graph.count(), 0

    def offer(batches):
        for b in batches:
            out = [_NONE]
            for e in b["e"]:
                new = np.array([x["new"] for x in e])
                worst = np.array([x["worst"] for x in e])
                out.append(_near(np.array([x["nbr"] for x in e]), [x["code"] for x in e], k,
                                 lambda rows, sims: (new[rows][:, None] | new) & (sims > worst[rows][:, None])))
            yield pd.concat(out, ignore_index=True)
    changed = edges
    while changed > least_change * edges:
        forward = _best(graph, k // 2)
        met = (forward.unionByName(_best(_turned(forward), k // 2)).groupBy("node", "nbr").agg(F.min("born").alias("born"))
               .withColumn("new", F.col("born") == born))
        worst = graph.groupBy("node").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
        known = nodes.select("node", "code").join(worst, "node", "left").select(
            F.col("node").alias("nbr"), "code", F.when(F.col("n") >= k, F.col("worst")).otherwise(float("-inf")).alias("worst"))
        lists = (met.join(known, "nbr").groupBy("node").agg(F.collect_list(F.struct("nbr", "code", "worst", "new")).alias("e"))
                 .where(F.exists("e", lambda x: x["new"])))
        born += 1
        offered = lists.select("e").mapInPandas(offer, _EDGE).withColumn("born", F.lit(born))
        graph = stored(_best(graph.unionByName(offered), k), "knn-graph")
        edges, changed = graph.agg(F.count("*"), F.count(F.when(F.col("born") == born, 1))).first()
    return graph


def search(vectors: DataFrame, every: int = 20, k: int = 20, degree: int = 32, beam: int = 200, expand: int = 200, entries: int = 16) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``. Copies of a
    vector rank by id; a query never answers itself. Rows that repeat a
    vec_id are told apart by their vectors only. Vectors of other lengths
    count as padded with zeros. Each walk starts at the query's own vector
    and the ``entries`` of largest norm, and ends when it has stepped on from
    every node of its beam.
    """
    vecs = stored(usable(vectors), "ann-vectors").distinct()
    classes = stored(_classes(vecs, k + 1), "ann-classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    top, dim = classes.agg(F.max(norm), F.max(F.size("v"))).first()
    nodes = stored(_codes(classes, dim or 1, top or 1.0), "ann-nodes")
    graph = stored(build_graph(nodes, degree), "ann-graph")
    asked = stored(vecs.where(F.col("vec_id") % every == 0).join(classes.select("v", "node"), "v").select("vec_id", "node"), "ann-queries")
    queries = nodes.join(asked.select("node").distinct(), "node").select(F.col("node").alias("q"), F.col("code").alias("qcode"), F.col("v").alias("qv"))
    both = graph.select("node", "nbr").union(_best(_turned(graph), degree).select("node", "nbr"))
    links = stored(both.distinct(), "ann-links")
    # Queries are rated in groups of about 4,096: a vector goes once to each group that meets it, at most as
    # often as pairs are met. A group's vectors are dealt over some tasks, each with the group's queries.
    group = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // _GROUP))))
    way = F.pmod(F.xxhash64("c"), F.lit(_WAYS)).cast("int")

    def rate(asking, offers):
        (head, x), at = _decode(asking["qcode"]), pd.Series(np.arange(len(asking)), asking["q"])
        floor, out = asking["floor"].to_numpy(), [_RATED]
        for start in range(0, len(offers), 4096):
            part = offers[start:start + 4096]
            other, y = _decode(part["code"])
            n = part["qs"].map(len).to_numpy()
            row, q = np.repeat(np.arange(len(part)), n), np.concatenate(part["qs"].to_numpy())
            who = at[q].to_numpy()
            for cut in range(0, len(q), 1 << 16):
                r, w = row[cut:cut + (1 << 16)], who[cut:cut + (1 << 16)]
                s = np.einsum("ij,ij->i", x[w], y[r]) * (head[0][w] * other[0][r])
                ok = s > floor[w]
                out.append(pd.DataFrame({"q": q[cut:cut + (1 << 16)][ok], "c": part["c"].to_numpy()[r[ok]], "s": s[ok]}))
        return pd.concat(out, ignore_index=True)
    # Greedy search: keep the best ``beam`` nodes met, step on from the best not yet left.
    place = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    large = classes.select(F.col("node").alias("c"), norm.alias("norm")).orderBy(F.desc("norm"), "c").limit(entries).select("c")
    met = (queries.select("q", F.col("q").alias("c")).union(queries.select("q").crossJoin(F.broadcast(large))).distinct()
           .select("q", "c", F.lit(float("inf")).alias("s"), F.lit(False).alias("left")))
    while True:
        open_ = F.sum(F.when(~F.col("left"), 1).otherwise(0)).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = met.withColumn("go", ~F.col("left") & (open_ <= expand))
        met = stored(met.select("q", "c", "s", (F.col("left") | F.col("go")).alias("left"), "go"), "ann-met")
        if not met.where("go").limit(1).count():
            break
        fresh = (met.where("go").select("q", F.col("c").alias("node")).join(links, "node").select("q", F.col("nbr").alias("c")).distinct()
                 .join(met.select("q", "c"), ["q", "c"], "left_anti"))
        offers = (fresh.groupBy(group.alias("g"), "c").agg(F.collect_list("q").alias("qs"))
                  .join(nodes.select(F.col("node").alias("c"), "code"), "c"))
        floor = met.groupBy("q").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(float("-inf")).alias("floor"))
        asking = queries.join(floor, "q").select(group.alias("g"), F.explode(F.lit([*range(_WAYS)])).alias("way"), "q", "qcode", "floor")
        rated = (asking.groupBy("g", "way").cogroup(offers.withColumn("way", way).groupBy("g", "way")).applyInPandas(rate, "q long, c long, s double")
                 .withColumn("left", F.lit(False)))
        met = (met.select("q", "c", "s", "left").unionByName(rated)
               .withColumn("r", F.row_number().over(place)).where(F.col("r") <= beam).drop("r"))
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    scored = (met.select("q", "c").join(classes.select(F.col("node").alias("c"), "v", "members"), "c").join(queries.select("q", "qv"), "q")
              .select("q", exact.alias("score"), F.explode("members").alias("vec_id")))
    ranked_ = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ranked_.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("l"))
    own = (asked.distinct().select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(lists, "q")
           .select("query_id", F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("l")))
    return (own.select("query_id", F.posexplode("l").alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))
