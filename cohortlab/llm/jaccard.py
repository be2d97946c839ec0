"""N-gram Jaccard join by T-occurrence search, with linked groups as the result.

1. Every document's distinct shingles are hashed (64 bits). A hash exchange counts in how
   many documents each shingle stands. A document with a partner shares 3/4 of its
   shingles, so fewer repeated ones settle it as alone. Equal sets become one node.
2. Shingles are ordered rarest first. Of two linked sets, each has one of its first
   n - ceil(3n/4) + 1 shingles in common with the other's. Where such a key stands in a set
   bounds the overlap, hence the sizes of the sets that it may link with; nodes that share a
   key and lie in one run of such sizes are chained to the run's first node, and the chains'
   components are clusters: links never leave one. Sets that only share a template (their
   own shingles are the rarer ones) are not chained unless the template alone may be enough.
3. In a block of a cluster (``BLOCK`` nodes at most) an inverted index is searched by
   DivideSkip: for a set that needs T matches, the T - 1 longest lists are set aside, the
   short ones are merged on a heap, and each candidate is probed by binary search in the
   long ones until it reaches the required overlap or cannot.
4. A cluster of more than one block is settled without comparing all pairs: blocks link
   inside, then one leader per linked group is compared over the cluster's blocks, round by
   round, while groups still merge. Then every node outside its cluster's largest group
   queries all blocks. Two linked nodes of different groups cannot both be inside the
   largest, so no link is lost.

Defined cases: null or wordless texts have no shingles and link with nothing; rows with a
null id are linked like others but never name a component; rows that share an id get their
own row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caches import enter
from .chunks import bucket_count, chunk_table, chunk_texts, exchange, pack, pack_sorted, per_row, slices, unpack, unpack_sorted, with_answers
from .components import components
from .hashing import WORD_SPACED, joined, mix, sequence_hash, windows, words
from .stage import stage

BITS = 48
SHINGLE = 5
PERCENT = 75   # similarity, in hundredths
BLOCK = 512    # nodes in one index
COUNTED = 1 << 18  # hashes that a reducer sorts at a time


def shingle_sets(row) -> list[np.ndarray]:
    """Distinct shingle hashes of each document of a chunk, ascending."""
    buf, starts = joined(chunk_texts(row["lens"], row["blob"]))
    _, _, doc, wh = words(buf, starts, WORD_SPACED, True)
    first, h = windows(wh, doc, SHINGLE)
    edge, word_edge = (np.searchsorted(x, np.arange(len(row["ids"]) + 1)) for x in (doc[first], doc))
    out = []
    for k in range(len(row["ids"])):
        if edge[k + 1] > edge[k]:
            out.append(np.unique(h[edge[k]:edge[k + 1]]))
        elif word_edge[k + 1] > word_edge[k]:
            out.append(sequence_hash(mix(wh), word_edge[k:k + 1], word_edge[k + 1:k + 2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _short(sets: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)) >> np.uint64(64 - BITS)


def _emit_counts(n_buckets: int):
    def emit(row):
        u, count = np.unique(_short(shingle_sets(row)), return_counts=True)
        cuts = slices(u, n_buckets, BITS)
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                head = pack_sorted(u[i:j])
                yield b, len(head).to_bytes(8, "little") + head + pack(count[i:j].astype("<u4").tobytes())
    return emit


def _sum_counts(messages: list[bytes]) -> list[bytes]:
    parts = []
    for m in messages:
        n = int.from_bytes(m[:8], "little")
        parts.append((unpack_sorted(m[8:8 + n]), np.frombuffer(unpack(m[8 + n:]), "<u4")))
    # a range of values at a time, so that sorting holds a part of the bucket
    low, high = min(int(h[0]) for h, _ in parts), max(int(h[-1]) for h, _ in parts) + 1
    n = -(-sum(len(h) for h, _ in parts) // COUNTED)
    edges = np.array([low + (high - low) * k // n for k in range(n + 1)], np.uint64)
    cuts = [np.searchsorted(h, edges) for h, _ in parts]
    answers = [np.empty(len(h), "<u2") for h, _ in parts]
    for k in range(n):
        own = [slice(c[k], c[k + 1]) for c in cuts]
        _, where = np.unique(np.concatenate([h[s] for (h, _), s in zip(parts, own)]), return_inverse=True)
        total = np.minimum(np.bincount(where, np.concatenate([c[s] for (_, c), s in zip(parts, own)])), 65535).astype("<u2")[where]
        at = 0
        for answer, s in zip(answers, own):
            answer[s] = total[at:at + s.stop - s.start]
            at += s.stop - s.start
    return [pack(x.tobytes()) for x in answers]


SET_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("items", pa.binary())])


def _sets(percent: int):
    """Rows (doc_id, n_shingles, digest, items): items are the repeated shingles, rarest
    first; digest and items are null for documents that cannot have a partner."""
    def sets(row):
        own = shingle_sets(row)
        _, where = np.unique(_short(own), return_inverse=True)
        total = np.concatenate([np.frombuffer(unpack(a["data"]), "<u2") for a in row["counts"]]) if row["counts"] else np.zeros(0, "<u2")
        df = total[where]
        at = 0
        for i, s in zip(row["ids"], own):
            d = df[at:at + len(s)]
            at += len(s)
            again = d > 1
            if len(s) and 100 * int(again.sum()) >= percent * len(s):
                digest = np.array([mix(s).sum(), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], "<u8").tobytes()
                keep, d = s[again], d[again]
                yield i, len(s), digest, pack(keep[np.lexsort((keep, d))].astype("<u8").tobytes())
            else:
                yield i, len(s), None, None
    return sets


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def reach(n: int, left, percent: int):
    """Largest size of a set that can link with one of ``n`` items where ``left`` of the latter's
    items remain from the first common one on: the overlap is ``left`` at most, see ``required``."""
    return (100 + percent) * left // percent - n


def _keys(percent: int):
    """Rows (key, node, n, reach) of a node's prefix."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("reach", pa.int64())])

    def keys(batches):
        enter("chunks")
        for b in batches:
            out = [[], [], [], []]
            for node, n, items in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("items").to_pylist()):
                have = np.frombuffer(unpack(items), "<i8")
                own = have[:max(0, prefix_length(n, percent) - (n - len(have)))]  # unique shingles are the rarest of all
                far = reach(n, len(have) - np.arange(len(own), dtype=np.int64), percent)
                for column, values in zip(out, (own, np.full(len(own), node), np.full(len(own), n), far)):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
                                              for x in out], schema=schema)
    return keys


def _chains(postings: DataFrame) -> DataFrame:
    """(a, b): each node with the first node of its run under a key.

    Let two linked sets have x as their first common item. Then each one's size is within the
    other's reach at x, so the smaller one is within its own: it is open at x. The sizes that
    open nodes stretch over, from their own to their reach, form runs; the larger of two linked
    sets lies in the run of the smaller one and reaches back to that run's beginning. A key has
    at most one row for each size of set, however many documents hold it."""
    is_open = F.col("reach") >= F.col("n")
    sizes = postings.groupBy("key", "n").agg(
        F.min(F.when(is_open, F.col("node"))).alias("lead"), F.max(F.when(is_open, F.col("reach"))).alias("far"), F.count(F.lit(1)).alias("k"))
    whole, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n")
    marked = sizes.withColumn("held", F.sum("k").over(whole)).where("held > 1 and lead is not null") \
        .withColumn("past", F.max("far").over(before.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("run", F.count(F.when(F.col("past").isNull() | (F.col("n") > F.col("past")), 1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(F.col("key").alias("_key"), "run").agg(
        F.min("n").alias("least"), F.max("far").alias("most"), F.min_by("lead", "n").alias("lead"))
    inside = (F.col("key") == F.col("_key")) & F.col("n").between(F.col("least"), F.col("most")) & (F.col("reach") >= F.col("least"))
    return postings.join(runs, inside).where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()


class Links:
    """Groups of nodes joined so far (union by smaller number)."""

    def __init__(self, groups=None):
        self.up = dict(groups or {})

    def find(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def required(a: int, b: int, percent: int) -> int:
    """Smallest overlap of sets of a and b items at which 100 x overlap >= percent x union."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(items: list, n: int, sizes: list[int], lists: dict, percent: int, settled):
    """Indexed sets that overlap enough with ``items`` (of a set of ``n``).
    ``settled(i)`` tells that a link to set i is known already."""
    mine = [x for x in (lists.get(i) for i in items) if x]
    need = -(-percent * n // 100)  # whatever the other's size
    if len(mine) < need:
        return
    mine.sort(key=len)
    cut = len(mine) - need + 1
    short, long = mine[:cut], mine[cut:]
    for i, same in groupby(heapq.merge(*short)):
        if settled(i):
            continue
        have, want, left = sum(1 for _ in same), required(n, sizes[i], percent), len(long)
        for one in long:
            if have >= want or have + left < want:
                break
            at = bisect_left(one, i)
            have += at < len(one) and one[at] == i
            left -= 1
        if have >= want:
            yield i


def _search(percent: int):
    """Group function over (cluster, part, node, n, items, label, query): links found among
    the indexed rows of a part, or from its query rows (if any) to them."""
    def search(group: pd.DataFrame) -> pd.DataFrame:
        enter("chunks")
        found = []
        for _, rows in group.groupby(["cluster", "part"], sort=False):
            asked = rows[rows["query"]]
            index = rows[~rows["query"]].sort_values(["n", "node"])
            lists, sizes, names = {}, [], []
            links = Links(dict(zip(rows["node"].tolist(), rows["label"].tolist())))

            def ask(node, n, items):
                hits = divide_skip(items, n, sizes, lists, percent, lambda i: links.find(names[i]) == links.find(node))
                for i in list(hits):
                    if links.find(names[i]) != links.find(node):
                        links.link(names[i], node)
                        found.append((node, names[i]))

            for node, n, items in zip(index["node"].tolist(), index["n"].tolist(), index["items"]):
                items = np.frombuffer(unpack(items), "<u8").tolist()
                if not len(asked):
                    ask(node, n, items)
                for x in items:
                    lists.setdefault(x, []).append(len(sizes))
                sizes.append(n)
                names.append(node)
            for node, n, items in zip(asked["node"].tolist(), asked["n"].tolist(), asked["items"]):
                ask(node, n, np.frombuffer(unpack(items), "<u8").tolist())
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return search


def _links(rows: DataFrame, percent: int, total: int) -> DataFrame:
    """Stage table (a, b) of links. Small clusters share a task; a part is never split."""
    bins = max(1, total // 32)
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("cluster", "part"), F.lit(bins)))
    return stage(binned.groupBy("bin").applyInPandas(_search(percent), "a long, b long"), "links")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    groups = components(links).withColumnsRenamed({"node": "_n", "comp": "_c"})
    return nodes.drop("label").join(groups, F.col("node") == F.col("_n"), "left") \
        .withColumn("label", F.coalesce("_c", "node")).drop("_n", "_c")


def node_links(nodes: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect all linked nodes of ``nodes`` (node, n, items), a stage table."""
    postings = stage(nodes.mapInArrow(_keys(percent), "key long, node long, n long, reach long"), "postings")
    chains = _chains(postings)
    clusters = components(chains)
    sizes = clusters.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("comp", "cluster")
    held = nodes.join(clusters, "node").withColumnRenamed("comp", "cluster").join(sizes, "cluster")
    blocks = F.ceil(F.col("size") / block).cast("int")
    held = stage(held.select("node", "n", "items", "cluster", blocks.alias("blocks"),
                             F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part")), "clusters")
    total = held.count()
    one = held.withColumns({"label": F.col("node"), "query": F.lit(False)})
    links = _links(one.drop("blocks"), percent, total)
    wide = held.where("blocks > 1")
    if wide.isEmpty():
        return links
    # leaders of the groups so far, round by round, while groups merge
    cut = stage(_labelled(wide.drop("items"), links), "groups")
    groups, turn = cut.select("cluster", "label").distinct().count(), 0
    while True:
        leaders = cut.groupBy("cluster", "label").agg(F.min("node").alias("node"))
        many = leaders.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        parts = leaders.join(many, "cluster").withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("parts")).cast("int"))
        most = many.agg(F.max("parts")).first()[0]
        rows = parts.drop("parts", "label").join(wide.select("node", "n", "items"), "node") \
            .withColumns({"label": F.col("node"), "query": F.lit(False)})
        links = stage(links.unionByName(_links(rows, percent, total)), "links")
        cut = stage(_labelled(wide.drop("items"), links), "groups")
        now, turn = cut.select("cluster", "label").distinct().count(), turn + 1
        if most <= 1 or now > 0.9 * groups:
            break
        groups = now
    # every node outside its cluster's largest group asks all blocks
    largest = cut.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster") \
        .agg(F.max(F.struct("k", "label"))["label"].alias("largest"))
    outside = cut.join(largest, "cluster").where("label != largest").select("node", "cluster", "label", "blocks")
    asks = outside.join(wide.select("node", "n", "items"), "node").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True)).drop("blocks")
    index = wide.select("node", "n", "items", "cluster", "part").join(cut.select("node", "label"), "node") \
        .join(outside.select("cluster").distinct(), "cluster", "left_semi").withColumn("query", F.lit(False))
    return stage(links.unionByName(_links(index.unionByName(asks), percent, total)), "links")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    rows = chunk_table(docs)
    n_buckets = bucket_count(rows)
    rows = with_answers(rows, exchange(rows, _emit_counts(n_buckets), _sum_counts, "counts"))
    found = stage(rows.mapInArrow(per_row(_sets(percent), rows.columns, SET_SCHEMA),
                                  "doc_id long, n_shingles long, digest binary, items binary"), "sets")
    alone, shared = found.where("digest is null"), found.where("digest is not null")
    nodes = shared.groupBy("digest", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("first_id"), F.first("items").alias("items")) \
        .withColumn("node", F.monotonically_increasing_id())
    nodes = stage(nodes, "nodes")
    comps = components(node_links(nodes.select("node", "n", "items"), percent, block)).withColumnRenamed("node", "_n")
    named = nodes.select("digest", "node", "first_id", "n").join(comps, F.col("node") == F.col("_n"), "left") \
        .select("digest", "first_id", "n", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    ids = stage(named.join(smallest, "comp").select(F.col("digest").alias("_d"), F.col("n").alias("_n"), "component_id"), "ids")
    linked = shared.join(ids, (F.col("digest") == F.col("_d")) & (F.col("n_shingles") == F.col("_n"))) \
        .select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
