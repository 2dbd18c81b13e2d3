"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of five-word shingles. Equal sets become one. In each of several independent trees a node
chooses one or two coordinates of the MinHash signatures and its sets branch by their minimum there, so that
similar sets keep meeting while others part. A small node compares all its sets. A large one estimates its sets'
similarity to some pivots, and the closest pairs are confirmed on whole sets. If all but a few of its sets hang
together by links confirmed so far, those few are compared with every member and the node is done; else it
branches on with all its members. Nodes within one known component are skipped and pivots compared with sets of
other components only; trees can run in two waves, so that the second knows what the first has joined.
Candidates are confirmed on whole shingle sets. The trees are DataFrame joins and group-bys over (set, node) rows of sixteen bytes; no
node of unbounded size is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import components
from spotweave.session import fresh_path, materialize

SHINGLE_WORDS = 5
LEAST_PERCENT = 75
COORDINATES = 64
TREES = 16
FIRST_TREES = TREES  # trees of a first wave, whose links are known to all others; each wave costs jobs of its own
FILTER_BITS = 1 << 25  # at most, of the filter that rows pass before they are shuffled; false hits only cost work
BITS_A_ROW = 64  # of a filter of few rows
SMALL_NODE = 32  # such a node compares all its sets
PIVOTS = 8  # sets of a larger node that all its sets are compared with
NEAR = 0.7  # estimates from which a level confirms sets' closest pivots; other pairs wait for the end
PLAUSIBLE = 0.5  # estimates of linked sets reach this but for 5 in a million of the least similar
DEEPEST = 40  # nodes large after so many levels, of which none is expected, are compared in full
_SEED = np.random.default_rng(20240501)
_MULTIPLY = _SEED.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, each computed once while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) == 0:
        return w
    with np.errstate(over="ignore"):
        if len(w) < SHINGLE_WORDS:
            value = np.uint64(len(w))
            for h in w:
                value = value * _BASE + h
            return np.array([value ^ (value >> np.uint64(29))], np.uint64)
        value = w[: len(w) - SHINGLE_WORDS + 1].copy()
        for i in range(1, SHINGLE_WORDS):
            value *= _BASE
            value += w[i : len(w) - SHINGLE_WORDS + 1 + i]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
    return np.unique(value)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum per coordinate, as signed 32-bit numbers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            part = _MULTIPLY[:, None] * shingles[None, a : a + 2048] + _ADD[:, None]
            np.minimum(least, part.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sizes, keys, signatures = [], [], []
        for text in batch.column(1):
            found = shingle_set(text.as_py(), hashes)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else np.zeros(0, np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in signatures])]).astype(np.int32)
        values = np.concatenate(signatures) if signatures else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, values)],
            names=["doc_id", "n_shingles", "set_key", "signature"],
        )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for set_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = shingle_set(text.as_py(), hashes)
            if xxhash.xxh3_128_hexdigest(found.tobytes()) != key:
                continue  # another text under a repeated doc_id
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id]), pa.ListArray.from_arrays(np.array([0, len(found)], np.int32), found.view(np.int64))],
                names=["set_id", "shingles"],
            )


def _branches(node: Column, signature_column: Column) -> Column:
    """The children of a node for a set: one or two coordinates chosen by the node, one and a third on average."""
    child = lambda salt: F.xxhash64(
        node, (c := F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(COORDINATES)).cast("int")), F.element_at(signature_column, c + 1)
    )
    second = F.pmod(F.xxhash64(node, F.lit(17)), F.lit(3)) == 0
    return F.array_distinct(F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1))))


def _estimate(a: Column, b: Column) -> Column:
    """Estimated similarity of two sets from their signatures."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x) / F.lit(float(COORDINATES))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _maybe_in(rows: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, by a filter of bounded size; both are written tables.

    Its bits reach the driver as numbers of 64 each, FILTER_BITS / 64 at most, and come back as one value of a
    scalar subquery, so that rows are looked up where they are read.
    """
    place = lambda salt, size: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(size))
    bits = wanted.select(F.explode(F.array(place(1, FILTER_BITS), place(2, FILTER_BITS))).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    found = words.toArrow()
    at, word = found.column("w").to_numpy(), found.column("b").to_numpy()
    # the bits of few rows are laid on top of each other: their places modulo a smaller power of two
    size = min(FILTER_BITS, max(64, BITS_A_ROW << (int(np.bitwise_count(word.view(np.uint64)).sum()) // 2).bit_length()))
    table = np.zeros(size // 64, np.int64)
    np.bitwise_or.at(table, at % len(table), word)
    one = pa.table({"bits": pa.ListArray.from_arrays(np.array([0, len(table)], np.int32), table)})
    known = rows.sparkSession.createDataFrame(one).scalar()
    rows = rows.where(F.col(key).isNotNull()).withColumn("_p1", place(1, size)).withColumn("_p2", place(2, size)).withColumn("_bits", known)
    is_set = lambda p: f"shiftright(_bits[cast({p} div 64 as int)], cast({p} % 64 as int)) & 1L = 1L"
    return rows.where(F.expr(f"({is_set('_p1')}) and ({is_set('_p2')})")).drop("_p1", "_p2", "_bits")


class _WholeSets:
    """Whole shingle sets of the sets asked for, written once each, and the pairs that they confirm."""

    def __init__(self, rows: DataFrame, sets: DataFrame):
        # one row per set: of the rows with its key, any text will do
        holders = sets.where("first_doc is not null").select("set_id", "set_key", F.col("first_doc").alias("doc_id"))
        self.rows, self.holders = rows, holders
        self.path = fresh_path(rows.sparkSession, "whole-sets")
        self.held: DataFrame | None = None

    def fetch(self, wanted: DataFrame) -> None:
        """Hold the sets of the column set_id too."""
        new = wanted.distinct()
        if self.held is not None:
            new = new.join(self.held.select("set_id"), "set_id", "left_anti")
        owners = materialize(self.holders.join(new, "set_id", "left_semi"), "set-owners")
        if owners.isEmpty():
            return
        texts = _maybe_in(self.rows, owners).join(owners, "doc_id").select("set_id", "set_key", "text")
        whole = texts.mapInArrow(_whole_sets, "set_id long, shingles array<long>")
        whole.write.mode("append").parquet(self.path)
        # one table, however often it grew: a union would read it by as many scans, each with its own copy of a filter
        self.held = self.rows.sparkSession.read.schema(whole.schema).parquet(self.path)

    def both_held(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sets are held."""
        ids = self.held.select("set_id").distinct()
        return pairs.join(ids.withColumnRenamed("set_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("set_id", "b"), "b", "left_semi")

    def confirm(self, pairs: DataFrame, label: str) -> DataFrame:
        """Those pairs (a, b), of sets that are held, that are linked."""
        # sets are large: only those of the pairs travel
        ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
        whole = _maybe_in(self.held, ends, "set_id").dropDuplicates(["set_id"])
        both = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("shingles").alias("a_set")), "a")
        both = both.join(whole.select(F.col("set_id").alias("b"), F.col("shingles").alias("b_set")), "b")
        shared, sizes = F.size(F.array_intersect("a_set", "b_set")).cast("long"), F.size("a_set") + F.size("b_set")
        return materialize(both.where(shared * (100 + LEAST_PERCENT) >= sizes * LEAST_PERCENT).select("a", "b"), label)


def _with_part(frame: DataFrame, parts: DataFrame | None, end: str, part: str) -> DataFrame:
    """``frame`` with the part of the set in its column ``end``: its component so far, or itself."""
    if parts is None:
        return frame.withColumn(part, F.col(end))
    named = parts.select(F.col("id").alias(end), F.col("component_id").alias(part))
    return frame.join(named, end, "left").withColumn(part, F.coalesce(part, end))


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Parts after more links: only the parts that links join are walked through, and their members follow them."""
    if parts is None:
        return materialize(components(links, "near-links", inside_tasks=True), "near-components")
    between = _with_part(_with_part(links, parts, "a", "a_part"), parts, "b", "b_part")
    joined = components(between.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")), "near-links", inside_tasks=True)
    joined = materialize(joined, "joined-parts")
    now = joined.select(F.col("id").alias("component_id"), F.col("component_id").alias("now"))
    followed = parts.join(now, "component_id", "left").select("id", F.coalesce("now", "component_id").alias("component_id"))
    single = joined.join(parts.select("id"), "id", "left_anti")
    return materialize(followed.unionByName(single), "near-components")


def _closest(pairs: DataFrame) -> DataFrame:
    """Of (a, b, near) every set's most similar pair."""
    ends = pairs.select(F.col("a").alias("x"), "near", "a", "b").unionByName(pairs.select(F.col("b").alias("x"), "near", "a", "b"))
    return ends.groupBy("x").agg(F.max(F.struct("near", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _against_pivots(inside: DataFrame) -> DataFrame:
    """Members of large nodes with the two closest of their node's pivots that aren't known to hang together with them (``best``).

    Pivots are drawn by hash, so that about twice as many as needed are gathered of a node of any size.
    """
    drawn = F.pmod(F.xxhash64("set_id", "node"), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.lit(2.0 * PIVOTS) / F.col("m")
    order = F.struct(F.xxhash64("node", "set_id").alias("h"), F.col("set_id").alias("id"), "signature", "part")
    pivots = inside.where(drawn).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(order)), 1, PIVOTS).alias("pivots"))
    others = F.filter("pivots", lambda p: p["part"] != F.col("part"))
    seen = F.transform(others, lambda p: F.struct(_estimate(p["signature"], F.col("signature")).alias("near"), p["id"].alias("id")))
    best = F.slice(F.sort_array(F.coalesce(seen, F.array().cast("array<struct<near:double,id:bigint>>")), asc=False), 1, 2)
    return inside.join(pivots, "node", "left").select("set_id", "node", "signature", best.alias("best"))


def candidate_pairs(
    sets: DataFrame, whole: _WholeSets, trees: int = TREES, small: int = SMALL_NODE
) -> tuple[DataFrame, DataFrame | None]:
    """Distinct (a, b), a < b, of set ids that met in a node of some tree and are not known to hang together, and
    the components (id, component_id) known from confirmed links, if any; ``sets`` has set_id and signature.

    Every level reads and writes tables, so plans stay short however deep the trees go.
    """
    spark = sets.sparkSession
    path = fresh_path(spark, "candidate-pairs")
    parts = None

    def apart(pairs: DataFrame) -> DataFrame:
        """Those pairs whose sets are not known to hang together."""
        if parts is None:
            return pairs
        return _with_part(_with_part(pairs, parts, "a", "a_part"), parts, "b", "b_part").where("a_part <> b_part").drop("a_part", "b_part")

    def keep(pairs: list[DataFrame]) -> None:
        reduce(DataFrame.unionByName, pairs).distinct().write.mode("append").parquet(path)

    for wave in (range(min(FIRST_TREES, trees)), range(FIRST_TREES, trees)):
        if not len(wave):
            break
        roots = F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in wave])
        rows = sets.select("set_id", F.explode(F.flatten(F.transform(roots, lambda r: _branches(r, F.col("signature"))))).alias("node"))
        for depth in range(DEEPEST + 1):
            rows = materialize(rows, "paths")
            named = _with_part(rows, parts, "set_id", "part")
            nodes = named.groupBy("node").agg(F.count("*").alias("m"), F.min("part").alias("low"), F.max("part").alias("high"))
            nodes = materialize(nodes.where("low <> high").select("node", "m"), "nodes")  # others hold one set or one component
            crowded = nodes.where(F.col("m") > small)
            more, met_here = not crowded.isEmpty(), []
            if more:
                inside = materialize(named.join(crowded, "node").join(sets.select("set_id", "signature"), "set_id"), "crowded")
            if more and depth < DEEPEST:
                inside = materialize(_against_pivots(inside), "against-pivots")
                best = inside.select("set_id", F.explode("best").alias("p")).where(F.col("p.near") >= PLAUSIBLE)
                pairs = best.select("set_id", F.col("p.id").alias("other"), "p.near").select(*_pair("set_id", "other"), "near")
                pairs = materialize(pairs.distinct(), "pivot-pairs")
                if depth & (depth - 1) == 0:  # at levels ever farther apart, as each time reads all texts
                    whole.fetch(pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))))
                if whole.held is not None:
                    chosen = materialize(_closest(whole.both_held(apart(pairs.where(F.col("near") >= NEAR)))), "closest-pivots")
                    links = whole.confirm(chosen, "pivot-links")
                    if not links.isEmpty():
                        parts = _joined(parts, links)
                    pairs = apart(pairs.join(chosen, ["a", "b"], "left_anti"))
                met_here.append(pairs.select("a", "b"))
            leaves = nodes.where(F.col("m") <= small).select("node")
            members = _with_part(rows.join(leaves, "node"), parts, "set_id", "part").groupBy("node")
            members = members.agg(F.sort_array(F.collect_list(F.struct("set_id", "part"))).alias("ids"))
            after = lambda x, i: F.filter(F.slice("ids", i + 2, small), lambda y: y["part"] != x["part"])
            met = F.flatten(F.transform("ids", lambda x, i: F.transform(after(x, i), lambda y: F.struct(x["set_id"].alias("a"), y["set_id"].alias("b")))))
            met_here.append(members.select(F.explode(met).alias("p")).select("p.*"))
            if more and depth == DEEPEST:
                others = inside.select("node", F.col("set_id").alias("other"))
                met_here.append(apart(inside.join(others, "node").where("set_id < other").select(*_pair("set_id", "other"))))
            if not more or depth == DEEPEST:
                keep(met_here)
                break
            # a node is done if all but a few hang together by confirmed links; those few are compared with every member
            inside = _with_part(inside, parts, "set_id", "part")
            sizes = inside.groupBy("node", "part").agg(F.count("*").alias("c")).groupBy("node")
            ways = sizes.agg(F.sum("c").alias("m"), F.max(F.struct("c", "part")).alias("most"))
            ways = materialize(ways.select("node", F.col("most.part").alias("main"), (F.col("m") - F.col("most.c") <= small).alias("done")), "ways")
            few = inside.join(ways.where("done"), "node").where("part <> main")
            few = few.groupBy("node").agg(F.collect_list(F.struct("set_id", "signature", "part")).alias("few"))
            alike = lambda f: (f["part"] != F.col("part")) & (_estimate(f["signature"], F.col("signature")) >= PLAUSIBLE)
            met = inside.join(few, "node").select("set_id", F.explode(F.transform(F.filter("few", alike), lambda f: f["set_id"])).alias("other"))
            keep([*met_here, met.select(*_pair("set_id", "other"))])
            go_on = inside.join(ways.where(~F.col("done")).select("node"), "node")
            # two branchings at a time: large nodes need several anyway
            once = go_on.select("set_id", "signature", F.explode(_branches(F.col("node"), F.col("signature"))).alias("node"))
            rows = once.select("set_id", F.explode(_branches(F.col("node"), F.col("signature"))).alias("node"))
    return apart(spark.read.schema("a long, b long").parquet(path).distinct()), parts


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Links join sets whose intersection is at least 75 hundredths of their union. A null or empty text, or one of
    white space only, has an empty set, links with nothing and is its own component. Rows that repeat a doc_id
    get a row each; with equal sets they are one class, and both are kept if that doc_id is. A null doc_id is
    never the smallest; a class without any other has a null component_id, is kept and links with nothing.
    Other columns are not used. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = materialize(
        rows.mapInArrow(_describe, "doc_id long, n_shingles long, set_key string, signature array<int>"), "signatures"
    )
    sets = (
        described.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("first_doc"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
        .withColumn("set_id", F.monotonically_increasing_id())
    )
    sets = materialize(sets, "sets")  # written, so the ids stay
    whole = _WholeSets(rows, sets)
    pairs, part = candidate_pairs(sets.select("set_id", "signature"), whole, trees)
    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("signature").alias(f"{s}_signature"), F.col("n").alias(f"{s}_n"))
    # the smaller set must reach the share of the larger, and the estimate must be plausible
    sizes_fit = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * LEAST_PERCENT
    near = _estimate(F.col("a_signature"), F.col("b_signature"))
    plausible = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes_fit).withColumn("near", near)
    plausible = materialize(plausible.where(F.col("near") >= PLAUSIBLE).select("a", "b", "near"), "plausible-pairs")
    whole.fetch(plausible.select(F.col("a").alias("set_id")).unionByName(plausible.select(F.col("b").alias("set_id"))))
    if whole.held is not None:
        # every set's most similar partner first; then the pairs that would still join two components
        first = materialize(_closest(whole.both_held(plausible)), "closest-pairs")
        part = _joined(part, whole.confirm(first, "first-links"))
        between = _with_part(_with_part(plausible.join(first, ["a", "b"], "left_anti"), part, "a", "a_part"), part, "b", "b_part")
        between = materialize(between.where("a_part <> b_part").select("a", "b"), "between-parts")
        if not between.isEmpty():
            part = _joined(part, whole.confirm(between, "more-links"))
    classes = _with_part(sets, part, "set_id", "class")
    smallest = classes.groupBy("class").agg(F.min("first_doc").alias("component"))
    labelled = classes.join(smallest, "class").select("set_key", "component")
    out = described.select("doc_id", "n_shingles", "set_key").join(labelled, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
