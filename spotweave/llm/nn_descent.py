"""Near-duplicate vectors through a neighbour graph refined by NN-descent.

Equal vectors become one. Random hyperplanes deal the vectors into leaves, several times over, and the best
partners in the leaves are the first neighbour lists. Then lists are refined by neighbours of neighbours: the
vectors that share a neighbour meet there, and pairs closer than what a list holds enter it, until few do. The
lists' edges above the threshold, confirmed in double precision, link vectors. A list that is full of links is
too short: it is enlarged by whatever may be a link, until it ends below the threshold or holds LONGEST vectors.

What is full even then lies in a crowd, whose links can't be listed one by one. The components of crowds are cut into
blocks of near vectors, balls with a centre and a radius. Two balls, of one component or of two, that can't hold a link are
passed over, in two that hold only links these are counted without looking, and the others are compared. So
lists that filled up with one group lose no link to another one.

The recall of links is audited on a bounded sample against all vectors, vector by vector and apart for few and many
links; if it is short, lists get longer and everything is refined again, and an error ends what can't reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.common import components, prefix_sums
from spotweave.llm.vectors import lists, matrix, usable
from spotweave.session import materialize

NEIGHBOURS = 10
LEAF = 128  # vectors of a leaf, aimed at
TREES = 3
ROUNDS = 6  # of refinement, at most, between audits
SETTLED = 0.02  # share of list entries that change in the last round
LOOSE = 0.03  # edges this far below the threshold by rounded vectors are looked at in full
LONGEST = 80  # entries of a list that was enlarged; beyond, links are counted by balls
BLOCK = 512  # members of a ball
BALLS_AT_ONCE = 512  # balls whose centres are compared with as many others in one group
CODE_BITS = 12  # hyperplanes by whose sides members of a ball are alike
AUDITED = 384  # vectors compared with all others
RECALL = 0.99


def _rounded(unit: np.ndarray) -> np.ndarray:
    """Components of unit vectors as small integers, a quarter of single precision."""
    return np.clip(np.rint(unit * 127 / np.abs(unit).max(1, keepdims=True)), -127, 127).astype(np.int8)


def _rounded_rows(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors back from rounded ones, single precision."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, d).astype(np.float32)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)


def _unit(column) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = matrix(column)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _leaf_edges(d: int, k: int, longest: int, loose: float):
    def best(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        x = _rounded_rows(table["small"], d)
        near = x @ x.T
        np.fill_diagonal(near, -2)
        top = np.argsort(-near, axis=1, kind="stable")[:, :longest]
        a = np.repeat(ids, top.shape[1])
        b, s = ids[top.ravel()], near[np.arange(len(ids))[:, None], top].ravel()
        place = np.tile(np.arange(top.shape[1]), len(ids))
        real = (a != b) & ((place < k) | (s >= loose))
        return pa.table({"a": a[real], "b": b[real], "near": s[real].astype(np.float32)})

    return best


def _first_lists(small: DataFrame, d: int, n: int, k: int, longest: int, loose: float, tree: int) -> DataFrame:
    """(a, b, near): best partners within the leaves of one random tree."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    planes = np.random.default_rng(1000 + tree).normal(size=(d, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = _rounded_rows(batch.column(1), d) @ planes > 0
                code = sides @ (1 << np.arange(bits)) if bits else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int64))], names=["id", "small", "leaf"])

    dealt = small.mapInArrow(deal, "id long, small binary, leaf long")
    parts = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(float(2 * LEAF))).cast("long").alias("parts"))
    dealt = dealt.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("id", F.lit(tree)), F.col("parts")))
    return dealt.groupBy("leaf", "part").applyInArrow(_leaf_edges(d, k, longest, loose), "a long, b long, near float")


def _best(edges: DataFrame, k: int, longest: int, loose: float) -> DataFrame:
    """The k closest of every list and, where these are links, further ones up to ``longest``; an entry is new if it is not known."""
    edges = edges.groupBy("a", "b").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
    kept = (F.col("rank") <= k) | ((F.col("rank") <= longest) & (F.col("near") >= loose))
    return edges.withColumn("rank", rank).where(F.col("rank") <= longest).where(kept).drop("rank")


def _local_joins(d: int):
    """Pairs of vectors that share a neighbour and are closer than the farthest entry of a list."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            hub, ids = table["hub"].to_numpy(), table["id"].to_numpy()
            limit, fresh = table["limit"].to_numpy(), table["fresh"].to_numpy()
            x = _rounded_rows(table["small"], d)
            cuts = np.flatnonzero(np.diff(hub)) + 1
            out_a, out_b, out_s = [], [], []
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(hub)]])):
                if hi - lo > 1:
                    near = x[lo:hi] @ x[lo:hi].T
                    wanted = (near > limit[lo:hi, None] + 1e-6) & (fresh[lo:hi, None] | fresh[None, lo:hi]) & (ids[lo:hi, None] != ids[None, lo:hi])
                    i, j = np.nonzero(wanted)
                    out_a.append(ids[lo + i])
                    out_b.append(ids[lo + j])
                    out_s.append(near[i, j])
            a, b, s = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((out_a, np.int64), (out_b, np.int64), (out_s, np.float32)))
            order = np.lexsort((b, a))
            a, b, s = a[order], b[order], s[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(s[first])], names=["a", "b", "near"])

        # rows come sorted by hub; a hub's rows, a bounded number, stay together
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([*([rest] if rest is not None else []), batch])
            table = table.combine_chunks()
            hub = table["hub"].to_numpy()
            cut = int(np.searchsorted(hub, hub[-1])) if len(hub) else 0
            if cut:
                yield pairs(table.slice(0, cut))
            left = table.slice(cut).combine_chunks().to_batches()
            rest = left[0] if left else None
        if rest is not None:
            yield pairs(pa.Table.from_batches([rest]))

    return join


def _lists_so_far(graph: DataFrame, k: int, longest: int, loose: float) -> DataFrame:
    """(id, limit, crowd): what a list still takes, and whether it is as long as a list gets and holds nothing but links.

    A list with fewer than k entries takes anything, one that ends below the threshold what is closer than its last entry,
    a full one anything that may be a link; one of a crowd takes nothing, for its links are counted by balls.
    """
    sizes = graph.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("c"), F.min("near").alias("least"))
    crowd = (F.col("c") >= longest) & (F.col("least") >= loose)
    limit = F.when(F.col("c") < k, -2.0).when(crowd, 3.0).otherwise(F.least(F.col("least").cast("double"), F.lit(loose)))
    limit = F.when((F.col("c") >= k) & (F.col("least") < loose), F.col("least").cast("double")).otherwise(limit)
    return sizes.select("id", limit.cast("float").alias("limit"), crowd.alias("crowd"))


def _refined(graph: DataFrame, small: DataFrame, d: int, k: int, longest: int, loose: float) -> tuple[DataFrame, float]:
    """The graph after one round, written, and the share of entries that are new."""
    reverse_rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("near"), "a"))
    # of those that hold a vector the closest k take part; the others meet through their own lists
    back = graph.withColumn("rank", reverse_rank).where(F.col("rank") <= k)
    meet = graph.select(F.col("a").alias("hub"), F.col("b").alias("id"), "fresh").unionByName(
        back.select(F.col("b").alias("hub"), F.col("a").alias("id"), "fresh")
    )
    meet = meet.groupBy("hub", "id").agg(F.max("fresh").alias("fresh"))
    own = graph.select("a").distinct().select(F.col("a").alias("hub"), F.col("a").alias("id"), F.lit(False).alias("fresh"))
    limits = _lists_so_far(graph, k, longest, loose).select("id", "limit")
    rows = meet.unionByName(own).join(limits, "id").join(small, "id").select("hub", "id", "limit", "fresh", "small")
    found = rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(_local_joins(d), "a long, b long, near float")
    after = _best(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k, longest, loose)
    after = materialize(after, "neighbours")
    counts = after.agg(F.avg(F.col("fresh").cast("double")).alias("new")).first()
    return after, float(counts["new"] or 0.0)


def _confirm(threshold: float):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.einsum("nd,nd->n", _unit(batch.column(2)), _unit(batch.column(3)))
                linked = pa.array(near >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(linked) for i in range(2)], names=["a", "b"])

    return exact


def _ball(table: pa.Table) -> pa.Table:
    """The centre, the radius (an angle) and the weight of a block's vectors."""
    x = _unit(table["embedding"])
    centre = x.mean(0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    values = {"ball": table["ball"][:1], "centre": lists(centre[None], pa.float64()), "radius": pa.array([radius]),
              "mass": pa.array([int(np.sum(table["m"].to_numpy()))]), "first": pa.array([int(np.min(table["id"].to_numpy()))])}
    return pa.table(values)


def _balls_in_reach(threshold: float):
    """Pairs of balls that may hold links, and whether all their pairs surely are."""
    angle = float(np.arccos(threshold))

    def reach(table: pa.Table) -> pa.Table:
        ball, radius, mass, side = (table[c].to_numpy() for c in ("ball", "radius", "mass", "side"))
        first, x = table["first"].to_numpy(), matrix(table["centre"])
        apart = np.arccos(np.clip(x @ x.T, -1, 1))
        wide = radius[:, None] + radius[None, :]
        # angles of centres are exact to about 1e-7
        near = (apart - wide <= angle + 1e-6) & (ball[:, None] <= ball[None, :])
        if (side != side[0]).any():
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(near)
        sure = apart[i, j] + wide[i, j] <= angle - 1e-6
        return pa.table({"one": ball[i], "two": ball[j], "sure": sure, "one_mass": mass[i], "two_mass": mass[j], "one_first": first[i], "two_first": first[j]})

    return reach


def _ball_links(threshold: float):
    """Number of links of each member of two balls with the members of the other, or within one, and one of them."""

    def compare(table: pa.Table) -> pa.Table:
        ids, ball, m = table["id"].to_numpy(), table["ball"].to_numpy(), table["m"].to_numpy()
        x = _unit(table["embedding"])
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if (ball != ball[0]).any():
            linked &= ball[:, None] != ball[None, :]
        some = linked.any(1)
        return pa.table({"id": ids[some], "links": (linked * m[None, :]).sum(1).astype(np.int64)[some], "other": ids[linked.argmax(1)][some]})

    return compare


def _crowd_links(inside: DataFrame, d: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, links) of members of crowds with members of crowds, pairs (a, b) of links that join components).

    ``inside`` has component_id, id, m and embedding of all members of crowded components.
    """
    planes = np.random.default_rng(77).normal(size=(d, CODE_BITS))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ((_unit(batch.column(3)) @ planes > 0) @ (1 << np.arange(CODE_BITS))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sides.astype(np.int64))], names=[*batch.schema.names, "code"])

    coded = inside.select("component_id", "id", "m", "embedding").mapInArrow(code, "component_id long, id long, m long, embedding array<double>, code long")
    h = F.xxhash64("id")
    coded = coded.withColumns({"part": F.pmod(h, F.lit(64)), "fine": F.pmod(F.shiftright(h, 8), F.lit(1024))})
    ranked = materialize(prefix_sums(coded, ["component_id"], ["code", "part", "fine"], ["id"], out="place"), "crowd-places")
    ball = F.xxhash64("component_id", F.floor(F.col("place") / BLOCK))
    members = materialize(ranked.select("id", "m", "embedding", ball.alias("ball")), "crowd-members")
    balls = materialize(members.groupBy("ball").applyInArrow(_ball, "ball long, centre array<double>, radius double, mass long, first long"), "balls")
    n_groups = max(1, -(-balls.count() // BALLS_AT_ONCE))
    side = F.pmod(F.xxhash64("ball"), F.lit(n_groups)).cast("int")
    dealt = balls.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    dealt = dealt.withColumns({"one_side": F.least("side", "other"), "two_side": F.greatest("side", "other")})
    schema = "one long, two long, sure boolean, one_mass long, two_mass long, one_first long, two_first long"
    pairs = materialize(dealt.groupBy("one_side", "two_side").applyInArrow(_balls_in_reach(threshold), schema), "balls-in-reach")

    sure = pairs.where("sure")
    whole = sure.select(F.col("one").alias("ball"), F.col("two_mass").alias("mass")).unionByName(
        sure.where("one <> two").select(F.col("two").alias("ball"), F.col("one_mass").alias("mass"))
    )
    counted = members.join(whole.groupBy("ball").agg(F.sum("mass").alias("links")), "ball")
    # a ball that surely links with itself counted each member's own class
    itself = sure.where("one = two").select(F.col("one").alias("ball"), F.lit(True).alias("itself"))
    counted = counted.join(itself, "ball", "left").select("id", (F.col("links") - F.when(F.col("itself"), F.col("m")).otherwise(0)).alias("links"))
    unsure = pairs.where(~F.col("sure"))
    ends = unsure.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("ball"))
    found = ends.join(members, "ball").groupBy("one", "two").applyInArrow(_ball_links(threshold), "id long, links long, other long")
    found = materialize(found, "ball-links")
    links = counted.unionByName(found.select("id", "links")).groupBy("id").agg(F.sum("links").cast("long").alias("links"))
    joins = sure.where("one <> two").select(F.col("one_first").alias("a"), F.col("two_first").alias("b"))
    return links, joins.unionByName(found.select(F.col("id").alias("a"), F.col("other").alias("b")))


def _audit(classes: DataFrame, links: DataFrame, threshold: float) -> float:
    """The least mean share of a vector's links that were found, over sampled vectors with none, few and many of them."""
    order = F.xxhash64("id", F.lit("audit"))
    many = F.when(F.col("links") == 0, 0).when(F.col("links") < 10, 1).otherwise(2)
    sample = (
        classes.join(links, "id", "left")
        .select("id", "embedding", "m", F.coalesce("links", F.lit(0)).alias("links"))
        .withColumn("tier", many)
        .withColumn("place", F.row_number().over(Window.partitionBy("tier", F.pmod(order, F.lit(64))).orderBy(order)))
        .where(F.col("place") <= AUDITED // 192)
        .collect()
    )  # at most AUDITED rows
    if not sample:
        return 1.0
    x = np.array([r["embedding"] for r in sample])
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["id"] for r in sample])
    sent = classes.sparkSession.sparkContext.broadcast((x, ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids = sent.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                linked = x @ _unit(batch.column(1)).T >= threshold
                linked &= ids[:, None] != batch.column(0).to_numpy()[None, :]
                total += (linked * batch.column(2).to_numpy()[None, :]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "links"])

    counted = classes.select("id", "embedding", "m").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    true = {r["id"]: r["links"] for r in counted.collect()}
    share = {}
    for r in sample:
        wanted = true[r["id"]]
        share.setdefault(r["tier"], []).append(min(r["links"], wanted) / wanted if wanted else 1.0)
    return min(float(np.mean(s)) for s in share.values())


def near_vectors(
    rows: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows``; links are cosines of ``threshold`` or more.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components link with
    nothing. Equal vectors link with each other. An id that repeats is one vector, with a row each time; a null
    id links with nothing, is its own component and kept. An empty table gives an empty table.
    """
    good = usable(rows, vec_id, embedding)
    d_row = good.select(F.size("embedding").alias("d")).limit(1).collect()
    everyone = rows.select(F.col(vec_id).cast("long").alias("vec_id"))
    nothing = everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not d_row:
        return nothing
    d = d_row[0]["d"]
    members = materialize(good.withColumn("key", F.md5(F.to_json("embedding"))), "vectors")
    classes = members.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.min("embedding").alias("embedding"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = _rounded(_unit(batch.column(3))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes() for s in small], pa.binary())], names=[*batch.schema.names, "small"])

    classes = materialize(
        classes.mapInArrow(shrink, "key string, id long, m long, embedding array<double>, small binary"), "vector-classes"
    )
    n = classes.count()
    small = classes.select("id", "small")
    graph, attempt, loose = None, 0, threshold - LOOSE
    while True:
        longest = max(k, LONGEST)
        first = [_first_lists(small, d, n, k, longest, loose, attempt * TREES + t).withColumn("fresh", F.lit(True)) for t in range(TREES)]
        edges = first[0]
        for more in [*first[1:], *([graph.withColumn("fresh", F.lit(False))] if graph is not None else [])]:
            edges = edges.unionByName(more)
        graph = materialize(_best(edges, k, longest, loose), "neighbours")
        for _ in range(ROUNDS):
            graph, new = _refined(graph, small, d, k, longest, loose)
            if new < SETTLED:
                break
        crowd = materialize(_lists_so_far(graph, k, longest, loose).where("crowd").select("id"), "crowd-lists")
        # of links inside crowds the closest hang them together, and balls find those between what they leave apart
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
        named = lambda c: crowd.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_crowd"))
        close = graph.withColumn("place", place).where(F.col("near") >= loose).join(named("a"), "a", "left").join(named("b"), "b", "left")
        close = close.where((F.col("place") <= k) | F.col("a_crowd").isNull() | F.col("b_crowd").isNull())
        close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda s: classes.select(F.col("id").alias(s), F.col("embedding").alias(f"{s}_v"))
        confirmed = close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_v", "b_v").mapInArrow(_confirm(threshold), "a long, b long")
        confirmed = materialize(confirmed, "vector-links")
        joined = materialize(components(confirmed, "vector-components"), "vector-components")
        # lists that are full of links at their longest: crowds, counted by balls
        crowded = materialize(joined.join(crowd, "id", "left_semi").select("component_id").distinct(), "crowds")
        links = None
        if crowded.limit(1).count():
            inside = materialize(joined.join(crowded, "component_id", "left_semi").join(classes.select("id", "m", "embedding"), "id"), "crowded")
            counted, across = _crowd_links(inside, d, threshold)
            links = counted
            joined = materialize(components(confirmed.unionByName(across), "vector-components"), "vector-components")
        both = confirmed.unionByName(confirmed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if links is not None:
            both = both.join(inside.select(F.col("id").alias("a")), "a", "left_anti")
        listed = both.join(classes.select(F.col("id").alias("b"), "m"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("m").cast("long").alias("links"))
        links = materialize(listed if links is None else links.unionByName(listed), "vector-link-counts")
        recall = _audit(classes, links, threshold)
        if recall >= RECALL:
            break
        if k >= n:
            raise RuntimeError(f"{recall:.3f} of the links of audited vectors were found, {RECALL} are wanted")
        attempt, k = attempt + 1, 2 * k
    labelled = classes.select("key", "id", "m").join(links, "id", "left").join(joined, "id", "left")
    labelled = labelled.select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    found = members.select("vec_id", "key").join(labelled, "key").select(F.col("vec_id").alias("found_id"), "n_links", "component_id")
    out = everyone.join(found, everyone["vec_id"] == found["found_id"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
