"""Near duplicates of vectors: links at a cosine of ``threshold`` or more, found by NN-descent.

Identical vectors are one node with a number of copies. Angles obey the triangle inequality, so nodes within half the
threshold's angle of another (its ball's leader) are all linked with each other; they are contracted first, by rounds of
comparing short blocks of the leaders sorted by the signs of random projections (a new order each round; members of a leader
that joins another are measured against the new one). So a group of copies of any size is one node with a radius, and its
links are counted, not listed.

NN-descent then runs over the leaders. Lists of ``NEIGHBOURS`` start from such blocks. In each round every leader's
neighbours, forward and backward, are joined with each other (``MEETING`` at a time; those of a popular leader are dealt into
several meetings by hash, anew each round, and none is left out), unless both were compared in an earlier round. Who is
nearer than the last of a list enters it. A list that is full of possible links is saturated: it is doubled, and its
neighbours meet again. Rounds end when no list grows and few change. Then recall is audited: up to ``AUDITED`` leaders,
half of them with links, are compared with all; what they miss is added, and below ``RECALL`` all lists are doubled and the
rounds go on.

Balls with leaders at angle a and radii r, s have no link if a > t + r + s (t: the threshold's angle), and all if a + r + s <=
t. The list of the wider ball must hold such a pair, so a leader's list is judged by t + 2r. Between the balls of a pair that
these bounds leave open, members are measured against the other leader, and against single members only if that doesn't decide
it. Every link was computed in double precision or follows from these bounds.

A null, empty or zero vector, or one with a null or non-finite element, links with nothing. Vectors of different widths have
no cosine and don't link either. Rows are vectors, repeated ones included; null ids are allowed and greater than any. Other
columns are ignored. Tables between steps are in the shared folder; nothing about the vectors reaches the driver but counts
and the audited ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.llm.common import once, written
from tessera.llm.components import components
from tessera.sources.storage import dropped, kept

THRESHOLD = 0.9
NEIGHBOURS, MEETING, BLOCK = 8, 48, 256
CONTRACTIONS, STARTS, ROUNDS, AUDITS = 4, 3, 12, 3
#: Rounds end when this share of the places in lists, or less, has changed.
SETTLED = 0.05
AUDITED, RECALL = 512, 0.95
#: What bounds are widened by, for the rounding of cosines and angles.
SLACK = 1e-9
#: Candidates of a task that are thinned at once.
HELD = 1_000_000


def _units(column) -> np.ndarray:
    """Rows of an Arrow array of lists, as unit vectors in doubles; all have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # The largest element first, so that squares stay finite and above zero.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(nodes: DataFrame, seed: int, work, schema: str) -> DataFrame:
    """work(ids, unit vectors) of blocks of neighbours in an order by random projections; a vector's width comes first in it."""
    vector = nodes.schema["v"].dataType.simpleString()

    def keyed(batches):
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            widths = batch.column(1).value_lengths().to_numpy()
            keys = np.zeros(len(widths), dtype=np.int64)
            for d in np.unique(widths):
                rows = np.flatnonzero(widths == d)
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, int(d))).standard_normal((int(d), 48))
                signs = _units(batch.column(1).take(pa.array(rows))) @ planes[d] > 0
                keys[rows] = signs @ (1 << np.arange(48, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), batch.column(1)], ["id", "key", "v"])

    def compared(batches):
        import pyarrow as pa

        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1, [len(widths)]])
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                for a in range(first, last, BLOCK):
                    own = batch.slice(a, min(BLOCK, last - a))
                    if len(own) > 1:
                        made = work(own.column(0).to_numpy(), _units(own.column(2)))
                        if len(made[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["id", "other", "cos"])

    order = (F.size("v"), "key", "id")
    sorted_ = nodes.select("id", "v").mapInArrow(keyed, f"id long, key long, v {vector}").repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(compared, schema)


def _absorbed(least: float):
    """Greedy balls of a block: (id, leader, cosine) of those that a leader takes."""

    def work(ids: np.ndarray, units: np.ndarray):
        cosines = units @ units.T
        leader = np.full(len(ids), -1)
        for i in range(len(ids)):
            if leader[i] < 0:
                leader[i] = i
                leader[(leader < 0) & (cosines[i] >= least)] = i
        taken = np.flatnonzero(leader != np.arange(len(ids)))
        return ids[taken], ids[leader[taken]], cosines[taken, leader[taken]]

    return work


def _nearest(ids: np.ndarray, units: np.ndarray):
    """The nearest of a block for each of it."""
    cosines = units @ units.T
    np.fill_diagonal(cosines, -2)
    k = min(NEIGHBOURS, len(ids) - 1)
    best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best.ravel()], np.take_along_axis(cosines, best, axis=1).ravel()


def _cosine(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(a, b))))


def _balls(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes (id, v, copies, own) with ``leader`` and the cosine ``near`` to it; members of one leader are all linked."""
    spark = nodes.sparkSession
    least = math.cos(math.acos(threshold) / 2) + SLACK
    now, path = written(spark, nodes.withColumn("leader", F.col("id")).withColumn("near", F.lit(1.0)), "balls")
    for r in range(CONTRACTIONS):
        leaders = now.filter("id = leader")
        found, at_moves = written(spark, _blocks(leaders, r, _absorbed(least), "id long, other long, cos double"), "moves")
        if found.isEmpty():
            dropped(spark, at_moves)
            break
        to = leaders.select(F.col("id").alias("other"), F.col("v").alias("to_v"))
        moves, at_to = written(spark, found.select(F.col("id").alias("leader"), "other").join(to, "other"), "moved")
        moved = once(now.join(moves, "leader", "left"), "cos", F.when(F.col("other").isNotNull(), _cosine(F.col("v"), F.col("to_v"))))
        joins = F.col("cos") >= least
        following, at = written(
            spark,
            moved.select(
                *nodes.columns,
                F.when(F.col("other").isNull(), F.col("leader")).when(joins, F.col("other")).otherwise(F.col("id")).alias("leader"),
                F.when(F.col("other").isNull(), F.col("near")).when(joins, F.col("cos")).otherwise(1.0).alias("near"),
            ),
            "balls",
        )
        dropped(spark, path, at_moves, at_to)
        now, path = following, at
    return now


class _Thinned:
    """Candidates of a task: each pair once, and for each list not more than it takes."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, ids, others, cosines, k) -> None:
        self.parts.append((ids, others, cosines, k))
        self.size += len(ids)
        if self.size > HELD:
            self.parts = [self.rows()]
            self.size = len(self.parts[0][0])

    def rows(self):
        ids, others, cosines, k = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((others, -cosines, ids))
        ids, others, cosines, k = ids[order], others[order], cosines[order], k[order]
        # The same pair may differ in its last bits from meeting to meeting; the greatest comes first.
        _, first = np.unique(np.stack([ids, others], axis=1), axis=0, return_index=True)
        keep = np.sort(first)
        ids, others, cosines, k = ids[keep], others[keep], cosines[keep], k[keep]
        begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rank = np.arange(len(ids)) - np.repeat(begins, np.diff([*begins, len(ids)]))
        good = rank < k
        return ids[good], others[good], cosines[good], k[good]


def _met(batches):
    """Pairs of each meeting (rows: v, part, id, fresh, last, k, vec; sorted by v, part) that enter a list, thinned."""
    import pyarrow as pa

    found, pairs = _Thinned(), {}

    def meet(ids, fresh, last, k, units):
        n = len(ids)
        if n not in pairs:
            pairs[n] = np.triu_indices(n, 1)
        i, j = pairs[n]
        cosines = (units @ units.T)[i, j]
        new = fresh[i] | fresh[j]
        for a, b in ((i, j), (j, i)):
            enters = new & (cosines > last[a])
            if enters.any():
                found.add(ids[a[enters]], ids[b[enters]], cosines[enters], k[a[enters]])

    left = None
    for batch in batches:
        batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0] if left is not None else batch
        v, part, ids, fresh, last, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(v) != 0) | (np.diff(part) != 0)) + 1, [len(v)]])
        units = _units_of_widths(batch.column(6))
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            if b - a > 1 and fresh[a:b].any():
                meet(ids[a:b], fresh[a:b], last[a:b], k[a:b], units(a, b))
        left = batch.slice(cuts[-2])  # the last meeting may go on in the next batch
    if left is not None and len(left) > 1:
        v, part, ids, fresh, last, k = (left.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        meet(ids, fresh, last, k, _units_of_widths(left.column(6))(0, len(left)))
    if found.parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.rows()[:3]], ["id", "other", "cos"])


def _units_of_widths(column):
    """Unit vectors of a run of rows, which has one width, as all nodes of a connected graph of vectors have."""
    widths = column.value_lengths().to_numpy()
    if len(widths) and (widths == widths[0]).all():
        units = _units(column)
        return lambda a, b: units[a:b]
    return lambda a, b: _units(column.slice(a, b - a))


def _merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    """graph with the candidates (id, other, cos) in its lists; what was in them before is no longer fresh."""
    old = graph.select("id", F.inline("list")).select("id", "other", "cos", F.lit(False).alias("fresh"))
    every = old.unionByName(found.select("id", "other", "cos", F.lit(True).alias("fresh"))).repartition("id")
    pairs = every.groupBy("id", "other").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    lists = pairs.groupBy("id").agg(F.collect_list(F.struct("cos", "other", "fresh")).alias("found"))
    best = F.slice(F.sort_array(F.coalesce("found", F.array().cast("array<struct<cos:double,other:bigint,fresh:boolean>>")), asc=False), 1, F.col("k"))
    return graph.drop("list").join(lists, "id", "left").withColumn("list", best).drop("found")


def _enlarged(graph: DataFrame, which: Column) -> DataFrame:
    """Lists twice as long; their neighbours meet again."""
    again = F.transform("list", lambda x: x.withField("fresh", F.lit(True)))
    return graph.withColumn("list", F.when(which, again).otherwise(F.col("list"))).withColumn("k", F.when(which, 2 * F.col("k")).otherwise(F.col("k")))


def _saturated() -> Column:
    return (F.size("list") >= F.col("k")) & (F.try_element_at("list", F.lit(-1))["cos"] >= F.col("need"))


def _round(graph: DataFrame, r: int) -> DataFrame:
    """Candidates (id, other, cos) from the meetings of one round."""
    edges = graph.select("id", F.inline("list"))
    both = edges.select(F.col("id").alias("v"), F.col("other").alias("id"), "fresh").unionByName(edges.select(F.col("other").alias("v"), "id", "fresh"))
    members = kept(both.groupBy("v", "id").agg(F.max("fresh").alias("fresh")), "members")
    sizes = members.groupBy("v").agg(F.count("*").alias("c"), F.max("fresh").alias("any")).filter("any").select("v", F.ceil(F.col("c") / MEETING).alias("parts"))
    last = F.when(F.size("list") >= F.col("k"), F.try_element_at("list", F.lit(-1))["cos"]).otherwise(-2.0)
    shown = graph.select("id", last.alias("last"), "k", F.col("v").alias("vec"))
    part = F.pmod(F.xxhash64(F.lit(r), F.col("v"), F.col("id")), F.col("parts"))
    meetings = members.join(sizes, "v").join(shown, "id").select("v", part.alias("part"), "id", "fresh", "last", "k", "vec")
    return meetings.repartition("v", "part").sortWithinPartitions("v", "part").mapInArrow(_met, "id long, other long, cos double")


def _audited(graph: DataFrame) -> tuple[float, DataFrame]:
    """The recall of possible links of a sample of leaders against all, and the pairs that were missed, both ways."""
    linked = F.exists("list", lambda x: x["cos"] >= F.col("need"))
    by_hash = lambda df: df.orderBy(F.xxhash64(F.lit("audit"), F.col("id"))).limit(AUDITED // 2)
    rows = {r["id"]: r for r in by_hash(graph).unionByName(by_hash(graph.filter(linked))).select("id", "v", "need").collect()}  # at most AUDITED
    spark = graph.sparkSession
    if not rows:
        return 1.0, spark.createDataFrame([], "id long, other long, cos double")
    ids, need = np.array(list(rows)), np.array([r["need"] for r in rows.values()])
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in rows.values()}:
        own = np.array([i for i, r in enumerate(rows.values()) if len(r["v"]) == d])
        x = np.array([r["v"] for r in rows.values() if len(r["v"]) == d], dtype=np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        by_width[d] = own, x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            others, widths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            for d, (own, units) in by_width.items():
                at = np.flatnonzero(widths == d)
                if len(at):
                    cosines = units @ _units(batch.column(1).take(pa.array(at))).T
                    i, j = np.nonzero((cosines >= need[own][:, None]) & (ids[own][:, None] != others[at][None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own][i]), pa.array(others[at][j]), pa.array(cosines[i, j])], ["id", "other", "cos"])

    true = kept(graph.select("id", "v").mapInArrow(run, "id long, other long, cos double"), "true")
    known = graph.select("id", F.inline("list")).select("id", "other", F.lit(True).alias("known"))
    missed = kept(true.join(known, ["id", "other"], "left_anti"), "missed")
    n, lost = true.count(), missed.count()
    return (1 - lost / n if n else 1.0), missed.unionByName(missed.select(F.col("other").alias("id"), F.col("id").alias("other"), "cos"))


def descend(leaders: DataFrame) -> tuple[DataFrame, float]:
    """(id, v, need, k, list) of leaders (id, v, need), each list with the nearest others found; and the audited recall of those at a cosine of ``need`` or more."""
    spark = leaders.sparkSession
    none = F.array().cast("array<struct<cos:double,other:bigint,fresh:boolean>>")
    graph = leaders.select("id", "v", "need", F.lit(NEIGHBOURS).alias("k"), none.alias("list"))
    starts = _blocks(leaders, 1000, _nearest, "id long, other long, cos double")
    for r in range(1, STARTS):
        starts = starts.unionByName(_blocks(leaders, 1000 + r, _nearest, "id long, other long, cos double"))
    graph, path = written(spark, _enlarged(_merged(graph, starts), _saturated()), "graph")
    recall, r = 1.0, 0
    for audit in range(AUDITS):
        for _ in range(ROUNDS):
            fresh = F.size(F.filter("list", lambda x: x["fresh"]))
            grown = (F.col("k") > NEIGHBOURS) & (F.size("list") > 0) & (2 * F.size("list") <= F.col("k")) & (fresh == F.size("list"))
            places, changed, growing = graph.agg(F.sum(F.size("list")), F.sum(fresh), F.count_if(grown)).first()
            if not changed or not growing and audit == 0 and changed <= SETTLED * places:
                break
            following, at = written(spark, _enlarged(_merged(graph, _round(graph, r)), _saturated()), "graph")
            dropped(spark, path)
            graph, path, r = following, at, r + 1
        recall, missed = _audited(graph)
        graph, at = written(spark, _merged(graph, missed), "graph")
        dropped(spark, path)
        path = at
        if recall >= RECALL or audit == AUDITS - 1:
            break
        graph, at = written(spark, _enlarged(graph, F.lit(True)), "graph")
        dropped(spark, path)
        path = at
    return graph, recall


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _links(pairs: DataFrame, balls: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For pairs (a, b, cos) of leaders that may have links: (id, more) of single nodes, (leader, more) for all members of a leader, (a, b) of linked leaders."""
    theta = math.acos(threshold)
    sizes = balls.groupBy("leader").agg(F.sum("copies").alias("size"), F.max(_angle(F.col("near"))).alias("radius"))
    of = lambda x: sizes.select(F.col("leader").alias(x), F.col("size").alias(f"{x}_size"), F.col("radius").alias(f"{x}_radius"))
    known = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("angle", _angle(F.col("cos")))
    single = (F.col("a_radius") == 0) & (F.col("b_radius") == 0)
    sure = F.when(single, F.col("cos") >= threshold).otherwise(F.col("angle") + F.col("a_radius") + F.col("b_radius") + SLACK <= theta)
    possible = F.when(single, sure).otherwise(F.col("angle") - F.col("a_radius") - F.col("b_radius") - SLACK <= theta)
    known = kept(known.filter(possible).withColumn("sure", sure), "pairs")
    whole = known.filter("sure")
    gains = whole.select(F.col("a").alias("leader"), F.col("b_size").alias("more")).unionByName(whole.select(F.col("b").alias("leader"), F.col("a_size").alias("more")))
    # Members of the smaller ball against the leader of the other.
    turn = F.col("a_size") <= F.col("b_size")
    member, other = balls.select(F.col("leader").alias("x"), F.col("id").alias("m"), F.col("v").alias("mv"), F.col("copies").alias("m_copies")), balls.filter("id = leader").select(F.col("id").alias("y"), F.col("v").alias("yv"))
    open_ = known.filter("NOT sure").select(*[F.when(turn, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("a", "b", "x"), ("b", "a", "y"), ("b_size", "a_size", "y_size"), ("b_radius", "a_radius", "y_radius"))])
    half = once(open_.join(member, "x").join(other, "y"), "c", _cosine(F.col("mv"), F.col("yv"))).withColumn("angle", _angle(F.col("c")))
    alone = F.col("y_radius") == 0
    all_of = F.when(alone, F.col("c") >= threshold).otherwise(F.col("angle") + F.col("y_radius") + SLACK <= theta)
    some_of = F.when(alone, all_of).otherwise(F.col("angle") - F.col("y_radius") - SLACK <= theta)
    half = kept(half.filter(some_of).withColumn("all_of", all_of).select("x", "y", "y_size", "m", "mv", "m_copies", "all_of"), "half")
    gains = gains.unionByName(half.filter("all_of").select(F.col("y").alias("leader"), F.col("m_copies").alias("more")))
    each = half.filter("all_of").select(F.col("m").alias("id"), F.col("y_size").alias("more"))
    rest = half.filter("NOT all_of").join(balls.select(F.col("leader").alias("y"), F.col("id").alias("o"), F.col("v").alias("ov"), F.col("copies").alias("o_copies")), "y")
    rest = kept(rest.filter(_cosine(F.col("mv"), F.col("ov")) >= threshold).select("x", "y", "m", "o", "m_copies", "o_copies"), "rest")
    each = each.unionByName(rest.select(F.col("m").alias("id"), F.col("o_copies").alias("more"))).unionByName(rest.select(F.col("o").alias("id"), F.col("m_copies").alias("more")))
    linked = whole.select("a", "b").unionByName(half.filter("all_of").select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(rest.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()
    return each, gains, linked


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding), a row for each."""
    spark = vectors.sparkSession
    good = usable(F.col("embedding"))
    # Two hashes of all elements, 128 bits, stand for a vector; those without a direction have keys of their own.
    rows = vectors.select("vec_id", "embedding", good.alias("good"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), F.col("embedding")).alias("h2"))
    own = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("own")
    nodes = rows.filter("good").groupBy("h1", "h2").agg(F.first("embedding").alias("v"), F.count("*").alias("copies"), own)
    nodes = kept(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    balls = _balls(nodes.select("id", "v", "copies", "own"), threshold)

    radius = _angle(F.min("near"))
    of_ball = kept(balls.groupBy("leader").agg(F.sum("copies").alias("size"), radius.alias("radius"), F.min("own").alias("least")), "of_ball")
    need = F.cos(F.least(F.lit(math.pi), F.lit(math.acos(threshold)) + 2 * F.col("radius"))) - SLACK
    leaders = balls.filter("id = leader").select("id", "v").join(of_ball.select(F.col("leader").alias("id"), need.alias("need")), "id")
    graph, _ = descend(kept(leaders, "leaders"))

    near = graph.select("id", F.inline("list"), "need").filter("cos >= need")
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    each, gains, linked = _links(kept(pairs, "near"), balls, threshold)
    node = of_ball.select("leader", F.struct("least", "leader").alias("node"))
    named = linked.join(node.select(F.col("leader").alias("a"), F.col("node").alias("u")), "a").join(node.select(F.col("leader").alias("b"), F.col("node").alias("w")), "b")
    roots = components(named.select("u", "w"), "u", "w").select(F.col("node.leader").alias("leader"), F.col("root.least").alias("root"))
    more = gains.groupBy("leader").agg(F.sum("more").alias("of_ball"))
    of_leader = kept(of_ball.join(roots, "leader", "left").join(more, "leader", "left").select("leader", (F.col("size") - 1 + F.coalesce("of_ball", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("root")), "of_leader")
    own_more = each.groupBy("id").agg(F.sum("more").alias("own_more"))
    of_node = balls.select("id", "leader").join(own_more, "id", "left").join(of_leader, "leader").select("id", (F.col("links") + F.coalesce("own_more", F.lit(0))).alias("links"), "root")
    found = kept(nodes.select("id", "h1", "h2").join(of_node, "id").select("h1", "h2", "links", F.lit(True).alias("found"), "root"), "found")
    keyed = kept(rows.select("vec_id", "good", F.when(F.col("good"), F.col("h1")).otherwise(F.xxhash64("vec_id", F.rand(7))).alias("h1"), F.col("h2")), "rows")
    joined = keyed.join(found, ["h1", "h2"], "left")
    component = F.when(F.col("good") & F.col("found"), F.col("root.vec_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(F.col("good"), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
