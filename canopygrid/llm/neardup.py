"""Near duplicates of configuration documents by a chosen-path set similarity join.

Documents with equal shingle sets form one class and are never paired. Every class enters the
roots of independent trees: a root's node is a coordinate of its minwise signature together
with that coordinate's value. A node of few classes is compared exhaustively. A larger one is
sounded with a few of its classes: if few others resemble them it branches at once, by pairs
of coordinates chosen from its own name. If many do, those few are compared with all (point
comparisons); classes that are connected by then need no further comparison with each other,
so only those outside the node's largest connected part go on: against all others in blocks
when that is little work, else the node branches too. A pair is looked at once, at the first
root it shares whose node does not branch, and in every tree below nodes that do. Signatures
only choose what is compared; every link is confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.common import need, slices, texts_of
from canopygrid.llm.shingles import COORDS, ROOTS, class_id, shingle_sets, signatures
from canopygrid.session import cut_lineage

PERCENT = 75  # 100 * intersection >= PERCENT * union
SMALL = 128  # classes in a node that is compared exhaustively at once
POINTS = 8  # classes of a larger node that are compared with all of it
BLOCK = 512  # classes in a block of a larger node
WORK = 2_000_000  # comparisons of one node that are done in blocks; beyond, it branches
VARIED = 0.3  # a node in which fewer classes than this share resemble any sounding class branches at once
BRANCHES, MAX_DEPTH = 4, 6  # a pair at PERCENT that meets only in nodes that branch is lost 4 times in a million
ROWS_PER_FILE = 200_000
BROADCAST_KEYS = 1_000_000  # document keys (16 MB) that may be sent to every task; more are joined by a shuffle
SURE = 0.5  # an agreement of signatures below this excludes PERCENT but for 2 in a million pairs

SIG_BYTES = 4 * ROOTS + 2 * COORDS


def _pack(sig: np.ndarray) -> list[bytes]:
    """Root values in full, all coordinates by their lower half."""
    roots, low = np.ascontiguousarray(sig[:, :ROOTS]), sig.astype(np.uint16)
    return [a.tobytes() + b.tobytes() for a, b in zip(roots, low, strict=True)]


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SIG_BYTES)
    return (np.ascontiguousarray(raw[:, :4 * ROOTS]).view(np.uint32), np.ascontiguousarray(raw[:, 4 * ROOTS:]).view(np.uint16))


def _texts(docs: DataFrame, name: str, doc: str) -> DataFrame:
    """``key, tid, doc``; the text id tells rows with equal or null keys apart."""
    text = docs[doc].cast("string")
    return docs.select(docs[name].alias("key"), F.xxhash64(text).alias("tid"), text.alias("doc"))


def shingled(docs: DataFrame, name: str, doc: str) -> DataFrame:
    """``key, tid, n, cid, sig, row`` for every row: text id, set size, class, signature and number; class null for an empty set."""
    out = T.StructType([T.StructField("key", docs.schema[name].dataType), T.StructField("tid", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("cid", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "doc"):
            sets = shingle_sets(texts_of(b, "doc"))
            packed = _pack(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([p if len(s) else None for p, s in zip(packed, sets, strict=True)], pa.binary())], names=out.names)

    done = _texts(docs, name, doc).select("key", "tid", "doc").mapInArrow(run, out)
    return done.withColumn("row", F.monotonically_increasing_id())


NODE = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.IntegerType()), T.StructField("cid", T.LongType())])


def _names(*parts: np.ndarray) -> np.ndarray:
    h = np.uint64(0x51ED270B)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h.astype(np.int64)


def roots(classes: DataFrame) -> DataFrame:
    """``node, root, cid``: every class in the root nodes of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values, cid = _unpack(b.column(1))[0], b.column(0).to_numpy()
                r = np.tile(np.arange(ROOTS), len(cid))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_names(r, values.ravel())), pa.array(r.astype(np.int32)), pa.array(np.repeat(cid, ROOTS))], names=NODE.names)

    return classes.select("cid", "sig").mapInArrow(run, NODE)


def branch(rows: DataFrame) -> DataFrame:
    """``node, root, cid``: rows of ``node, root, cid, sig`` in ``BRANCHES`` child nodes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, root, cid = (b.column(i).to_numpy() for i in range(3))
            low, names = _unpack(b.column(3))[1], []
            for j in range(BRANCHES):
                pick = _names(node, np.full(len(node), j)).astype(np.uint64) >> np.uint64(20)
                one, two = (ROOTS + (x % np.uint64(COORDS - ROOTS)).astype(np.int64) for x in (pick, pick >> np.uint64(16)))
                names.append(_names(node, one, two, low[np.arange(len(node)), one], low[np.arange(len(node)), two]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.tile(root, BRANCHES)),
                                              pa.array(np.tile(cid, BRANCHES))], names=NODE.names)

    return rows.select("node", "root", "cid", "sig").mapInArrow(run, NODE)


def _agreeing(low: np.ndarray, roots_: np.ndarray, spared: np.ndarray, i: int, root: int) -> np.ndarray:
    """Which rows agree with row ``i`` in enough coordinates and are to meet it here.

    ``root`` -1 stands for any; ``spared`` has a bit for every root whose node branches.
    """
    near = (low == low[i]).sum(axis=1) >= SURE * COORDS
    if root > 0:
        earlier = (spared[i] >> np.arange(root)) & 1 == 0
        near &= ~((roots_[:, :root] == roots_[i, :root]) & earlier).any(axis=1)
    near[i] = False
    return near


GROUP = T.StructType([T.StructField("gid", T.LongType()), T.StructField("root", T.IntegerType()), T.StructField("cid", T.LongType()),
                      T.StructField("sig", T.BinaryType()), T.StructField("label", T.LongType()), T.StructField("asks", T.BooleanType()),
                      T.StructField("spared", T.IntegerType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _wanted(table: pa.Table) -> pa.Table:
    """The rows of one group with at least one partner by signature, asker or asked, under another label."""
    t = table.combine_chunks()
    column = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("label", "asks", "spared")}
    roots_, low = _unpack(t.column("sig"))
    root, take = t.column("root")[0].as_py(), np.zeros(t.num_rows, dtype=bool)
    for i in np.flatnonzero(column["asks"]):
        near = _agreeing(low, roots_, column["spared"], i, root) & (column["label"] != column["label"][i])
        if near.any():
            take |= near
            take[i] = True
    return t.filter(pa.array(take)).select([f.name for f in GROUP.fields])


def _linked(table: pa.Table) -> pa.Table:
    """Links of one group confirmed on full sets, as few as connect what is connected."""
    t = table.combine_chunks()
    cid, label, asks, spared = (t.column(n).to_numpy(zero_copy_only=False) for n in ("cid", "label", "asks", "spared"))
    roots_, low = _unpack(t.column("sig"))
    root, raw = t.column("root")[0].as_py(), t.column("set").to_pylist()
    sets: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {int(x): int(x) for x in label}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(raw[i], dtype=np.uint64)
        return sets[i]

    links = []
    for i in np.flatnonzero(asks):
        near = np.flatnonzero(_agreeing(low, roots_, spared, i, root))
        near = near[np.argsort(-(low[near] == low[i]).sum(axis=1), kind="stable")]
        for at in range(0, len(near), 64):
            part = [j for j in near[at:at + 64] if top(int(label[i])) != top(int(label[j]))]
            if not part:
                continue
            x, others = full(i), [full(j) for j in part]
            sizes = np.array([len(y) for y in others])
            flat = np.concatenate(others)
            inside = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
            both = np.add.reduceat(inside, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
            for j in np.flatnonzero(100 * both >= PERCENT * (len(x) + sizes - both)):
                a, b = top(int(label[i])), top(int(label[part[j]]))
                if a != b:
                    links.append((int(cid[i]), int(cid[part[j]])))
                    parent[max(a, b)] = min(a, b)
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def confirm(groups: DataFrame, classes: DataFrame, docs: DataFrame, name: str, doc: str) -> DataFrame:
    """Links between the classes of each group; ``asks`` rows are compared with all rows of the group."""
    groups = groups.select(*[f.name for f in GROUP.fields])
    wanted = cut_lineage(groups.groupBy("gid").applyInArrow(_wanted, GROUP))
    # one document of each wanted class gives its set; all copies do where the class has no key
    keys = cut_lineage(wanted.select("cid").distinct().join(classes.select("cid", "least"), "cid").select(
        F.col("least.key").alias("_key"), F.col("least.tid").alias("_tid")).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = _texts(docs, name, doc).join(keys, F.col("key").eqNullSafe(F.col("_key")) & (F.col("tid") == F.col("_tid")))
    out = T.StructType([T.StructField("cid", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "doc"):
            sets = [s for s in shingle_sets(texts_of(b, "doc")) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(class_id, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=out.names)

    sets = texts.select("key", "doc").mapInArrow(run, out)
    full = wanted.join(sets.dropDuplicates(["cid"]), "cid")
    return cut_lineage(full.groupBy("gid").applyInArrow(_linked, LINKS))


def components(links: DataFrame) -> DataFrame:
    """``cid, label`` for every class in a link; label is the least class reachable.

    Each round every class takes the least label among itself and its neighbours, then the
    label of its label; rounds go on until nothing changes. Neighbours' labels are combined
    before the shuffle, so a class with very many links is no hot group. Tables are written
    in as many files as their rows call for.
    """
    links = cut_lineage(links)
    files = 1 + 2 * links.count() // ROWS_PER_FILE
    keep = lambda df: cut_lineage(df.coalesce(files))
    both = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "cid"))
    while True:
        seen = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels["cid"] == seen["a"]).select("cid", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        hop = labels.select(F.col("cid").alias("to"), F.col("label").alias("far"))
        nxt = keep(step.join(hop, "to").select("cid", F.least("to", "far").alias("label"), "was"))
        if nxt.where(F.col("label") != F.col("was")).isEmpty():
            return nxt.select("cid", "label")
        labels = nxt.select("cid", "label")


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Connected parts after more links; earlier parts enter as links to their labels."""
    if parts is not None:
        links = links.unionByName(parts.where("cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b")))
    return components(links)


def _labelled(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows with ``label``: the connected part so far, the class itself where it has no link."""
    if parts is None:
        return rows.withColumn("label", F.col("cid"))
    return rows.join(parts.withColumnRenamed("label", "_to"), "cid", "left").withColumn("label", F.coalesce("_to", "cid")).drop("_to")


def near_duplicates(cfgs: DataFrame, name: str = "name", doc: str = "doc") -> DataFrame:
    """``name, n_shingles, component_id, kept`` for every row.

    Two documents are linked when 100 * |A and B| >= 75 * |A or B| over their sets of five-word
    shingles; ``component_id`` is the least key reachable by links, ``kept`` tells whether it
    is the row's own. A null, empty or blank document has no shingles and stands alone. Rows with
    equal keys are repeated rows of one document if their texts are equal; else each text is
    placed by itself. Of rows with the least key, or of a component without any key, one is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    done = _placed(cfgs, name, doc)
    return done.select(F.col("key").alias(name), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, name: str = "name", doc: str = "doc") -> DataFrame:
    """The rows, unchanged, that ``near_duplicates`` keeps: one of each component, and all without shingles."""
    of_text = cut_lineage(_placed(docs, name, doc).groupBy("key", "tid").agg(
        F.max("kept").alias("kept"), (F.count("cid") > 1).alias("_many")).where("kept").select(
        F.col("key").alias("_key"), F.col("tid").alias("_tid"), "_many"))
    rows = docs.join(of_text, docs[name].eqNullSafe(F.col("_key")) & (F.xxhash64(docs[doc].cast("string")) == F.col("_tid")))
    # only repeated rows are moved to be told apart
    return rows.where("not _many").unionByName(rows.where("_many").dropDuplicates(["_key", "_tid"])).select(*docs.columns)


def _placed(cfgs: DataFrame, name: str, doc: str) -> DataFrame:
    """``key, tid, n, cid, component_id, kept`` for every row."""
    need(cfgs, name, doc)
    every = cut_lineage(shingled(cfgs, name, doc))
    classes = cut_lineage(every.where(F.col("cid").isNotNull()).groupBy("cid").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid", "row")).alias("least"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    parts: DataFrame | None = None
    groups: list[DataFrame] = []
    spared = None
    nodes = roots(classes)
    for depth in range(MAX_DEPTH + 1):
        sizes = nodes.groupBy("node").count().where("count > 1").withColumnRenamed("count", "m")
        live = cut_lineage(nodes.join(sizes, "node").join(classes.select("cid", "sig"), "cid"))
        if live.isEmpty():
            break
        live = _labelled(live, parts)
        if parts is not None:  # nodes whose classes are all connected already need no more comparisons
            mixed = live.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node")
            live = cut_lineage(live.join(mixed, "node"))
        at = F.when(F.lit(depth == 0), F.col("root")).otherwise(F.lit(-1))
        groups.append(live.where(F.col("m") <= SMALL).select(
            F.xxhash64("node", F.lit(0)).alias("gid"), at.alias("root"), "cid", "sig", "label", F.lit(True).alias("asks")))
        large = cut_lineage(live.where(F.col("m") > SMALL))
        if large.isEmpty():
            break
        last = F.lit(depth == MAX_DEPTH)
        large = cut_lineage(large.join(_sounded(large), "node"))
        deeper, alike = large.where((F.col("near") < VARIED) & ~last), large.where((F.col("near") >= VARIED) | last)
        if not alike.isEmpty():
            parts = _joined(parts, confirm(_blocks(alike, _points(alike)).withColumns({"root": F.lit(-1), "spared": F.lit(0)}), classes, cfgs, name, doc))
            # what the point comparisons left apart
            alike = _labelled(alike.drop("label"), parts)
            main = alike.groupBy("node", "label").count().groupBy("node").agg(
                F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("parts")).where("parts > 1").select(
                "node", F.col("top.label").alias("main"), ((F.col("all") - F.col("top.count")) * F.col("all")).alias("work"))
            alike = cut_lineage(alike.join(main, "node"))
            few = (F.col("work") <= WORK) | last
            direct = alike.where(few)
            asking = direct.where(F.col("label") != F.col("main")).select("node", "cid", F.lit(True).alias("asks"))
            groups.append(_blocks(direct, asking).withColumn("root", at))
            deeper = deeper.unionByName(alike.where(~few).select(*deeper.columns))
        if depth == 0:
            spared = deeper.groupBy("cid").agg(F.bit_or(F.pow(F.lit(2), "root").cast("int")).alias("spared"))
        nodes = cut_lineage(branch(deeper).distinct())
    if groups:
        every_group = functools.reduce(DataFrame.unionByName, groups)
        every_group = every_group.join(spared, "cid", "left") if spared is not None else every_group.withColumn("spared", F.lit(None).cast("int"))
        parts = _joined(parts, confirm(every_group.withColumn("spared", F.coalesce("spared", F.lit(0))), classes, cfgs, name, doc))
    placed = _labelled(classes.select("cid", "least"), parts)
    least = placed.groupBy("label").agg(F.min("least").alias("least"))
    of_class = placed.select("cid", "label").join(least, "label").select(
        "cid", F.col("least.key").alias("component_id"), F.col("least.row").alias("only"))
    done = every.drop("sig").join(of_class, "cid", "left")
    return done.select("key", "tid", "n", "cid", F.coalesce("component_id", "key").alias("component_id"),
                       F.coalesce(F.col("row") == F.col("only"), F.lit(True)).alias("kept"))


def _points(rows: DataFrame) -> DataFrame:
    """``node, cid, asks``: ``POINTS`` classes of each node, chosen by hashes."""
    pick = [F.min(F.struct(F.xxhash64("node", "cid", F.lit(j)).alias("h"), F.col("cid"))).alias(f"p{j}") for j in range(POINTS)]
    return rows.groupBy("node").agg(*pick).select(
        "node", F.explode(F.array_distinct(F.array(*[f"p{j}.cid" for j in range(POINTS)]))).alias("cid"), F.lit(True).alias("asks"))


def _sounded(rows: DataFrame) -> DataFrame:
    """``node, near``: the share of each node's classes whose signature resembles a sounding class's."""
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("hit", T.LongType()), T.StructField("all", T.LongType())])

    def sound(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        low, near = _unpack(t.column("sig"))[1], np.zeros(t.num_rows, dtype=bool)
        for i in np.flatnonzero(asks):
            near |= (low == low[i]).sum(axis=1) >= SURE * COORDS
        return pa.table({"node": t.column("node").slice(0, 1), "hit": pa.array([int((near & ~asks).sum())], pa.int64()),
                         "all": pa.array([int((~asks).sum())], pa.int64())})

    blocks = _blocks(rows, _points(rows), keep="node")
    return blocks.groupBy("gid").applyInArrow(sound, out).groupBy("node").agg((F.sum("hit") / F.greatest(F.sum("all"), F.lit(1))).alias("near"))


def _blocks(rows: DataFrame, asking: DataFrame, keep: str = "root") -> DataFrame:
    """Groups that let every ``asking`` class of a node meet all its rows, in blocks of about ``BLOCK``.

    A row stands in its own block; an asking class stands in all blocks of its node.
    """
    marked = rows.join(asking, ["node", "cid"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(7)), blocks).cast("int")
    where = F.when(F.col("asks"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return marked.withColumn("block", F.explode(where)).select(
        F.xxhash64("node", "block", F.lit(1)).alias("gid"), keep, "cid", "sig", "label", "asks")
