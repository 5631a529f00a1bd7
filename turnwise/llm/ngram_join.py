"""N-gram Jaccard join by prefix trees.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more. The join is exact on
48-bit shingle digests. ``ngram_components`` gives each document's connected component and needs no more links than span
it; ``ngram_links`` gives every link, and ``ngram_link_counts`` each document's number of links.

Digests are that short because nearly all that moves is one of them per shingle: sets of n and m shingles are told apart
wrongly with a chance of n m / 2^48, about one in a billion for ordinary documents. Set sizes are counted by 64 bits.

1. Equal word sequences form one class; a class takes part once.
2. A shuffle by shingle finds the shingles that several classes share, with their document frequency. An overlap holds
   shared shingles only, so all others leave here; each class keeps its set size.
3. In the global order (rarest first) a class can only link with one that shares a shingle of its prefix, the first
   n - ceil(0.8 n) + 1. Unshared shingles come first: a class with that many of them links with nothing. The rest form
   blocks, connected through shared prefix shingles.
4. In each block the ordered sets are stored in a trie and every class traverses it: sets that begin alike share one
   partial overlap, and a subtree is left when its sizes, its remaining lengths or the probe's remaining shingles can't
   reach the threshold any more, or when all its classes are in the probe's component already.

A block of more than ``CHUNK`` classes is dealt into chunks that are joined within themselves first. What is then in the
block's main component is not joined with itself again: only the classes outside it meet all chunks. So a group of near
copies of any size costs in proportion to its size; a block in which few classes are linked costs chunks x chunks, but
never more memory. Where every link is wanted nothing is left out: all pairs of a block's chunks are joined, one task
each, so work and rows moved grow with chunks x chunks. Links are counted inside the tasks and not written for it.

Defined results: a null or wordless text has an empty set and is its own component; a text with fewer than five words
has its whole sequence as its one shingle; rows without doc_id link like others, but never name a component; repeated
rows are rows of one class; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import stored, table, whole_row
from turnwise.llm.components import components
from turnwise.llm.registry import query

WIDTH = 5
#: Classes and shingles of a chunk; a task holds two chunks.
CHUNK, CHUNK_SHINGLES = 1000, 2_000_000
#: Document frequencies are told apart up to here; it only orders shingles, and bounds what a task holds of one.
FREQUENT = (1 << 15) - 1
DIGEST_BITS = 48
#: Ids up to which the rows to drop are broadcast.
BROADCAST_ROWS = 200_000
_ROWS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << DIGEST_BITS) - 1)


def shingles(text: bytes | None) -> tuple[np.ndarray, int, bytes]:
    """Ascending distinct digests of a text's shingles, their number by 64-bit digests, its normalised word sequence."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    sequence = b" ".join(words)
    if len(words) < WIDTH:
        whole = [xxhash.xxh3_64_intdigest(sequence, seed=1 + len(words))] if words else []
        return np.array(whole, np.uint64) & _MASK, len(whole), sequence
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - WIDTH + 1
    gram = hashed[:last].copy()
    for k in range(1, WIDTH):
        gram ^= gram >> np.uint64(31)
        gram *= _MULTIPLIER
        gram += hashed[k:last + k]
    return np.unique(gram & _MASK), len(np.unique(gram)), sequence


def _class_key(sequence: bytes, seed: int) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(sequence, seed=seed)
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _class_of(seed: int):
    """A text's class k as a column function."""
    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([_class_key(b" ".join(((t or "").encode()).lower().split()), seed)[0] for t in texts], dtype="int64")

    return key


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _keys(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                _, size, sequence = shingles(text)
                rows.append((size, *_class_key(sequence, seed)))
            n, k, check = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(check, pa.int64())],
                names=["doc_id", "n", "k", "check"])

    return run


def _entries(seed: int):
    def packed(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        rows = [len(s) for s, _, _ in held]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([s for s, _, _ in held]).view(np.int64)),
             pa.array(np.repeat(np.array([k for _, k, _ in held], np.int64), rows)),
             pa.array(np.repeat(np.array([n for _, _, n in held], np.int64), rows))], names=["shingle", "k", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                found, size, sequence = shingles(text)
                if len(found):
                    held.append((found, _class_key(sequence, seed)[0], size))
                    rows += len(found)
                if rows >= _ROWS:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    return run


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, k, n), those whose shingle has two or more classes, as (k, n, token). A token is the
    number of classes, up to FREQUENT, above the digest: tokens in ascending order are in the global order.

    The rows of the last shingle wait for the next batch. Once FREQUENT of them wait, they and all that follow are
    frequent, and none needs to wait longer.
    """
    def packed(shingle, k, n, df) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, n, df.astype(np.int64) << DIGEST_BITS | shingle)],
                                          names=["k", "n", "token"])

    wait = [np.zeros(0, np.int64)] * 3
    sent = None  # the shingle and last class of which rows were sent as frequent
    for batch in batches:
        s, k, n = (np.concatenate(pair) for pair in zip(wait, _columns(batch)))
        if not len(s):
            continue
        new = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])]
        if sent is not None and (s[0], k[0], n[0]) == sent:
            new[0] = False
        s, k, n = s[new], k[new], n[new]
        if sent is not None:
            more = int(np.searchsorted(s, sent[0], "right"))
            if more:
                yield packed(s[:more], k[:more], n[:more], np.full(more, FREQUENT))
                sent = (sent[0], k[more - 1], n[more - 1])
                s, k, n = s[more:], k[more:], n[more:]
        if not len(s):
            wait = [s, k, n]
            continue
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        counts = np.diff(np.r_[start, len(s)])
        last = start[-1]
        df = np.repeat(counts, counts)[:last]
        keep = df > 1
        if keep.any():
            yield packed(s[:last][keep], k[:last][keep], n[:last][keep], np.minimum(df[keep], FREQUENT))
        wait = [s[last:], k[last:], n[last:]]
        if len(wait[0]) >= FREQUENT:
            yield packed(*wait, np.full(len(wait[0]), FREQUENT))
            sent = (wait[0][-1], wait[1][-1], wait[2][-1])
            wait = [np.zeros(0, np.int64)] * 3
    if len(wait[0]) > 1:
        yield packed(*wait, np.full(len(wait[0]), min(len(wait[0]), FREQUENT)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, n, token) sorted by all three: the classes whose prefix holds a shared shingle."""
    def packed(k, n, shingle) -> pa.RecordBatch | None:
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
        count = np.diff(np.r_[start, len(k)])
        size = n[start]
        prefix = size - (4 * size + 4) // 5 + 1 - (size - count)
        able = prefix > 0
        if not able.any():
            return None
        values = shingle[np.repeat(able, count)]
        offsets = np.r_[0, np.cumsum(count[able])].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(k[start][able]), pa.array(size[able]), pa.array(prefix[able]),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["k", "n", "prefix", "shingles"])

    wait = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        k, n, s = (np.concatenate(pair) for pair in zip(wait, _columns(batch)))
        if not len(k):
            continue
        own = (k == k[-1]) & (n == n[-1])
        last = len(k) - int(own.sum())
        wait = [k[last:], n[last:], s[last:]]
        if last and (out := packed(k[:last], n[:last], s[:last])) is not None:
            yield out
    if len(wait[0]) and (out := packed(*wait)) is not None:
        yield out


class _Node:
    __slots__ = ("run", "children", "ends", "smallest", "largest", "longest", "uniform")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.smallest = self.largest = self.longest = 0
        self.uniform = -1


class PrefixTree:
    """Ordered sets in a trie whose nodes hold runs of ranks."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        self.parent = list(range(len(sets)))
        self.root = _Node(np.zeros(0, np.int64))
        for i, ranks in enumerate(sets):
            self._insert(i, ranks)
        self.order: list[_Node] = []  # parents before children
        stack = [self.root]
        while stack:
            node = stack.pop()
            self.order.append(node)
            stack.extend(node.children.values())
        for node in reversed(self.order):
            sizes_below = [sizes[i] for i in node.ends] + [c.smallest for c in node.children.values()]
            node.smallest = min(sizes_below, default=0)
            node.largest = max([sizes[i] for i in node.ends] + [c.largest for c in node.children.values()], default=0)
            node.longest = len(node.run) + max((c.longest for c in node.children.values()), default=0)
        self.refresh()

    def _insert(self, i: int, ranks: np.ndarray) -> None:
        node, at = self.root, 0
        while at < len(ranks):
            child = node.children.get(int(ranks[at]))
            if child is None:
                child = node.children[int(ranks[at])] = _Node(ranks[at:])
                node, at = child, len(ranks)
                break
            m = min(len(child.run), len(ranks) - at)
            differs = np.flatnonzero(child.run[:m] != ranks[at:at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(child.run):
                upper = _Node(child.run[:same])
                node.children[int(ranks[at])] = upper
                upper.children[int(child.run[same])] = child
                child.run = child.run[same:]
                child = upper
            node, at = child, at + same
        node.ends.append(i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def refresh(self) -> None:
        """Note for each subtree the component that all its sets are in, if it is one."""
        for node in reversed(self.order):
            if node.uniform >= 0:
                continue
            roots = {self.find(i) for i in node.ends}
            for c in node.children.values():
                roots.add(self.find(c.uniform) if c.uniform >= 0 else -1)
                if len(roots) > 1:
                    break
            node.uniform = roots.pop() if len(roots) == 1 else -1

    def near(self, own: np.ndarray, n: int, marked: np.ndarray) -> list[int]:
        """All sets of the tree that link with a set of ``n`` shingles and ranks ``own``; ``marked`` is all false."""
        marked[own] = True
        found: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if 5 * node.largest < 4 * n or 4 * node.smallest > 5 * n:
                continue
            if len(node.run):
                overlap += int(np.count_nonzero(marked[node.run]))
                left = min(node.longest - len(node.run), len(own) - int(np.searchsorted(own, node.run[-1], "right")))
            else:
                left = len(own)
            if 9 * (overlap + left) < 4 * (n + max(node.smallest, (4 * n + 4) // 5)):
                continue
            found += [j for j in node.ends if 9 * overlap >= 4 * (n + self.sizes[j])]
            stack.extend((c, overlap) for c in node.children.values())
        marked[own] = False
        return found

    def links(self) -> list[tuple[int, int]]:
        """Links that span every component of the sets."""
        found: list[tuple[int, int]] = []
        ranks = 1 + max((int(s[-1]) for s in self.sets if len(s)), default=-1)
        marked = np.zeros(ranks, bool)
        for i, (own, n) in enumerate(zip(self.sets, self.sizes)):
            marked[own] = True
            before = len(found)
            stack = [(self.root, 0)]
            while stack:
                node, overlap = stack.pop()
                if node.uniform >= 0 and self.find(node.uniform) == self.find(i):
                    continue
                if 5 * node.largest < 4 * n or 4 * node.smallest > 5 * n:
                    continue
                if len(node.run):
                    overlap += int(np.count_nonzero(marked[node.run]))
                    left = min(node.longest - len(node.run), len(own) - int(np.searchsorted(own, node.run[-1], "right")))
                else:
                    left = len(own)
                if 9 * (overlap + left) < 4 * (n + max(node.smallest, (4 * n + 4) // 5)):
                    continue
                for j in node.ends:
                    if 9 * overlap >= 4 * (n + self.sizes[j]) and (a := self.find(i)) != (b := self.find(j)):
                        self.parent[max(a, b)] = min(a, b)
                        found.append((i, j))
                stack.extend((c, overlap) for c in node.children.values())
            marked[own] = False
            if len(found) > before:
                self.refresh()
        return found


def _in_order(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ascending ranks, and how many ranks there are; what most sets hold is first, so they share more."""
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -count))] = np.arange(len(every))
    ranked = rank[place]
    bounds = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(ranked, bounds)], len(every)


def _tree_links(ids: list[int], sizes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of the classes of one block."""
    ordered, _ = _in_order(sets)
    return [(ids[i], ids[j]) for i, j in PrefixTree(ordered, sizes).links()]


def _all_near(sizes: list[int], sets: list[np.ndarray], sides: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked sets) for every link of a task once: between its two sides, or within its only one."""
    ordered, ranks = _in_order(sets)
    marked = np.zeros(ranks, bool)
    first = [i for i, side in enumerate(sides) if side == 0]
    second = [i for i, side in enumerate(sides) if side == 1]
    held = np.array(second or first, np.int64)
    tree = PrefixTree([ordered[j] for j in held], [sizes[j] for j in held])
    for i in first:
        found = held[np.array(tree.near(ordered[i], sizes[i], marked), np.int64)]
        if not second:
            found = found[found > i]
        if len(found):
            yield i, found


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, sizes, copies, sides, sets) of each task of rows (task, id, n, copies, side, shingles) sorted by task."""
    task, rows, sets = None, [], []
    for batch in batches:
        values, offsets = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
        for row, (t, *own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
            if t != task:
                if len(rows) > 1:
                    yield (*zip(*rows), sets)
                task, rows, sets = t, [], []
            rows.append(own)
            sets.append(values[offsets[row]:offsets[row + 1]].copy())
    if len(rows) > 1:
        yield (*zip(*rows), sets)


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every link (a, b) of each task."""
    for ids, sizes, _, sides, sets in _whole_tasks(batches):
        ids = np.array(ids, np.int64)
        for i, found in _all_near(sizes, sets, sides):
            a, b = np.full(len(found), ids[i]), ids[found]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rows linked with it) of each task, a linked class counting with its copies."""
    for ids, sizes, copies, sides, sets in _whole_tasks(batches):
        copies = np.array(copies, np.int64)
        links = np.zeros(len(ids), np.int64)
        for i, found in _all_near(sizes, sets, sides):
            links[i] += copies[found].sum()
            links[found] += copies[i]
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[some]), pa.array(links[some])],
                                         names=["id", "links"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each task of rows (task, id, n, shingles) sorted by task."""
    def joined() -> pa.RecordBatch:
        found = _tree_links(ids, sizes, sets) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                           pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    task, ids, sizes, sets = None, [], [], []
    for batch in batches:
        values, offsets = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
        for row, (t, i, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if t != task:
                yield joined()
                task, ids, sizes, sets = t, [], [], []
            ids.append(i)
            sizes.append(n)
            sets.append(values[offsets[row]:offsets[row + 1]].copy())
    yield joined()


def _links_by_task(rows: DataFrame, task: Column) -> DataFrame:
    """Links inside each task of rows (id, n, shingles); one row per task and id."""
    keyed = rows.select(task.alias("task"), "id", "n", "shingles")
    return (keyed.repartition("task").sortWithinPartitions("task", "id").mapInArrow(_join_blocks, "a long, b long"))


def _chunks_of(rows: DataFrame) -> DataFrame:
    """(block, chunks): into how many chunks a block is dealt."""
    return rows.groupBy("block").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.size("shingles")) / CHUNK_SHINGLES)).cast("int").alias("chunks"))


def _task(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def _block_links(rows: DataFrame) -> DataFrame:
    """Links that span the components of (block, id, n, shingles)."""
    dealt = stored(rows.join(_chunks_of(rows), "block")
                   .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    inner = stored(_links_by_task(dealt, _task(F.col("block"), F.col("chunk"))))
    large = dealt.filter("chunks > 1")
    if large.isEmpty():
        return inner
    # The largest component of each chunk; their smallest members are joined across the chunks.
    def with_component(links: DataFrame) -> DataFrame:
        found = components(links).withColumnRenamed("node", "id")
        return large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))

    sizes = with_component(inner).groupBy("block", "chunk", "component").agg(F.count("*").alias("size"))
    leaders = sizes.groupBy("block", "chunk").agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("m")) \
        .select((-F.col("m.c")).alias("id"))
    across = stored(_links_by_task(large.join(leaders, "id", "left_semi"), _task(F.col("block"))).union(inner))
    placed = stored(with_component(across))
    main = placed.groupBy("block", "component").agg(F.count("*").alias("size")).groupBy("block") \
        .agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("m")) \
        .select("block", (-F.col("m.c")).alias("main"))
    outside = placed.join(main, "block").filter("component <> main")
    left = outside.groupBy("block").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.size("shingles")) / CHUNK_SHINGLES)).cast("int").alias("parts"))
    outside = outside.join(left, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    meets = outside.select("id", "n", "shingles", "block", "part",
                           F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = placed.join(left, "block").select("id", "n", "shingles", "block", "chunk",
                                            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = meets.unionByName(met).dropDuplicates(["block", "chunk", "part", "id"])
    return across.union(stored(_links_by_task(both, _task(F.col("block"), F.col("chunk"), F.col("part")))))


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    """Rows (task, id, n, copies, side, shingles) of (block, id, n, copies, shingles): a task for every pair of a block's
    chunks and for each chunk by itself."""
    dealt = rows.join(_chunks_of(rows), "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select(_task(F.col("block"), low, high).alias("task"), "id", "n", "copies",
                    (F.col("chunk") > low).cast("int").alias("side"), "shingles")
            .repartition("task").sortWithinPartitions("task", "side", "id"))


def _distinct_keys(docs: DataFrame) -> tuple[int, DataFrame]:
    """A seed under which no two word sequences share k, and (doc_id, n, k) of every row under it."""
    kind = dict(docs.dtypes)["doc_id"]
    seed = 0
    while True:
        keyed = stored(docs.mapInArrow(_keys(seed), f"doc_id {kind}, n long, k long, check long"))
        clash = keyed.groupBy("k").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x <> y")
        if clash.isEmpty():
            return seed, keyed.drop("check")
        seed += 1


def _able(docs: DataFrame, seed: int) -> DataFrame:
    """(k, n, prefix, shingles) of the classes that may link with another."""
    shared = (docs.select("text").mapInArrow(_entries(seed), "shingle long, k long, n long")
              .repartition("shingle").sortWithinPartitions("shingle", "k", "n")
              .mapInArrow(_shared, "k long, n long, token long"))
    return stored(shared.repartition("k", "n").sortWithinPartitions("k", "n", "token")
                  .mapInArrow(_candidates, "k long, n long, prefix long, shingles array<long>"))


def _in_blocks(able: DataFrame) -> DataFrame:
    """Those of ``able`` whose prefix shares a shingle, with their block."""
    prefixes = able.select("id", F.explode(F.expr("slice(shingles, 1, int(prefix))")).alias("shingle"))
    leads = prefixes.groupBy("shingle").agg(F.min("id").alias("lead"), F.count("*").alias("c")).filter("c > 1")
    pairs = prefixes.join(leads.drop("c"), "shingle").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    return able.join(components(pairs).withColumnRenamed("node", "id").withColumnRenamed("component", "block"), "id")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    docs = docs.select("doc_id", "text")
    _, keyed, linked = _linked_classes(docs)
    classes = keyed.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("first")) \
        .join(linked, "k", "left").withColumn("component", F.coalesce("component", "k"))
    firsts = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = classes.select("k", "component").join(firsts, "component").select("k", "component_id")
    return keyed.join(of_class, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked_classes(docs: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """The keys' seed, (doc_id, n, k) of every row, and (k, component) of the classes that link with others. A component is named by its
    smallest k: doc_ids may be null, or stand on several texts."""
    seed, keyed = _distinct_keys(docs)
    able = _able(docs, seed).withColumnRenamed("k", "id")
    links = _block_links(_in_blocks(able))
    return seed, keyed, stored(components(links).select(F.col("node").alias("k"), "component"))


def _pairs_to_join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, k) of every row; (k, copies) of every class; the tasks of ``_chunk_pairs``, where k is the id."""
    docs = docs.select("doc_id", "text")
    seed, keyed = _distinct_keys(docs)
    copies = keyed.filter("n > 0").groupBy("k").agg(F.count("*").alias("copies"))
    able = stored(_able(docs, seed).join(copies, "k").withColumnRenamed("k", "id"))
    return keyed, copies, _chunk_pairs(stored(_in_blocks(able)))


def ngram_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link: (a, b) of linked classes, once each with a < b, and (doc_id, n_shingles, class_id) of every row.

    Rows of one class are linked with each other too, unless n_shingles is 0; a class stands for all its rows, also those
    without doc_id. A group of m near copies with different texts has up to m (m - 1) / 2 rows here.
    """
    keyed, _, tasks = _pairs_to_join(docs)
    return (tasks.mapInArrow(_join_all, "a long, b long"),
            keyed.select("doc_id", F.col("n").alias("n_shingles"), F.col("k").alias("class_id")))


def ngram_link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_links (other rows at similarity 0.8 or more, copies of the text included) of every row."""
    keyed, copies, tasks = _pairs_to_join(docs)
    counted = tasks.mapInArrow(_count_all, "id long, links long").groupBy(F.col("id").alias("k")) \
        .agg(F.sum("links").alias("links"))
    of_class = copies.join(counted, "k", "left") \
        .select("k", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return keyed.join(of_class, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row stays, that with the smallest doc_id.

    A row is known by its doc_id and its class, so an id that stands on several texts takes none of them along; rows of
    an equal doc_id and class are one row. Rows without doc_id come after all others; without words they link with
    nothing and stay. Ids and classes are what is joined, never texts, except for rows that were there more than once.
    """
    slim = docs.select("doc_id", "text")
    seed, keyed, linked = _linked_classes(slim)
    keyed = keyed.join(linked, "k", "left").withColumn("component", F.coalesce("component", "k"))
    rows = stored(keyed.groupBy("component", "doc_id", "k").agg(F.count("*").alias("c"), F.max("n").alias("n")))
    firsts = rows.filter("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first"), F.count("*").alias("all"))
    gone = rows.filter("n > 0").join(firsts.filter("all > 1"), "component").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k")))) \
        .select(F.col("doc_id").alias("gone_id"), F.col("k").alias("gone_k"))
    gone = stored(gone)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    named = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), _class_of(seed)(F.col("text")).alias("k"))
    left = named.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("k") == F.col("gone_k")), "left_anti")
    again = rows.filter("c > 1 and (n > 0 or doc_id is not null)").select(F.col("doc_id").alias("again_id"),
                                                                        F.col("k").alias("again_k"))
    if not again.isEmpty():
        here = F.col("id").eqNullSafe(F.col("again_id")) & (F.col("k") == F.col("again_k"))
        left = left.join(again, here, "left_anti").unionByName(
            left.join(again, here, "left_semi").dropDuplicates(["id", "k"]))
    return left.select("row.*")


_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
entries AS (SELECT doc_id, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 9 * count(*) >= 4 * (p.n + q.n)),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x)
  SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM sizes LEFT JOIN reach ON x = doc_id
"""


@query("op3_ngram_trie_join", _SQL)
def op3_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


_LINKS_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
sizes AS (SELECT r, doc_id, len(s)::BIGINT AS n FROM sets),
entries AS (SELECT r, unnest(s) AS g FROM sets),
links AS (
  SELECT a.r AS x, b.r AS y FROM entries a JOIN entries b ON a.g = b.g AND a.r <> b.r
  JOIN sizes p ON p.r = a.r JOIN sizes q ON q.r = b.r
  GROUP BY a.r, b.r, p.n, q.n HAVING 9 * count(*) >= 4 * (p.n + q.n)),
counts AS (SELECT x, count(*) AS c FROM links GROUP BY x)
SELECT doc_id, n AS n_shingles, coalesce(c, 0)::BIGINT AS n_links FROM sizes LEFT JOIN counts ON x = r
"""


@query("op3_ngram_link_counts", _LINKS_SQL)
def op3_ngram_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_link_counts(table(spark, sf_dir, "documents"))
