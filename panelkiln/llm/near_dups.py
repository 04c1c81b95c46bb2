"""Operator 4, exact n-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.partenum import fine_signatures, least_distance, node_of, shared_at_least, shingles_of, signatures, sketch
from panelkiln.llm.shared import MOST_HOT, cut, discard, exact_groups, free_name, fresh_dir, give_back, parted, set_for, small_batches, stored, table

#: Similarity in percent.
PERCENT = 75
#: A map task hands on its signatures by so many.
FLUSH = 1 << 20
#: About so many signatures to a bucket, and no fewer and no more buckets than that.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 21, 1 << 6, 1 << 18
#: Pairs of different components of a group are compared up to so many; a group with more gets a star and another round.
WHOLE_GROUP = 1 << 17
#: Groups are compared by tasks of about so many entries, and their pairs by so many at a time.
PER_TASK, AT_ONCE = 1 << 16, 1 << 16
#: Edges of a forest that one task joins (16 MB).
ONE_TASK = 1 << 20
#: The features of pairs' nodes are looked up by broadcast names up to so many pairs.
FEW_PAIRS = 1 << 16
#: 64-bit words of the filter that tells which documents' sets are needed.
FILTER_WORDS = 1 << 18

BLOBS = "bucket int, sigs binary, at binary, nodes binary, marks binary"
PAIRS = "bucket int, pairs binary, nodes binary, counts binary, again boolean"


def sets_of(texts: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """Position and shingle set of each text of a batch, some at a time."""
    texts = texts.tolist()
    for i in range(0, len(texts), 64):
        yield from enumerate(shingles_of(texts[i : i + 64]), i)


def _bucket_bits(n_signatures: int) -> int:
    return int(min(MOST_BUCKETS, max(LEAST_BUCKETS, n_signatures // PER_BUCKET)) - 1).bit_length()


def _deal(bits: int, sig: np.ndarray, node: np.ndarray, mark: dict | None) -> pd.DataFrame:
    """Signatures and their nodes as a row of arrays for each bucket: 32 bits of each signature beyond those of the bucket, how many each node has, and nodes' marks (0 for a node's own name)."""
    bucket = (sig >> np.uint64(64 - bits)).astype("i8")
    order = np.lexsort((node, bucket))
    bucket, sig, node = bucket[order], ((sig >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order], node[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        names, n = np.unique(node[a:b], return_counts=True)
        marks = b"" if mark is None else np.array([mark.get(x, 0) for x in names.tolist()], "<i8").tobytes()
        rows.append((int(bucket[a]), sig[a:b].tobytes(), n.astype("<u4").tobytes(), names.astype("<i8").tobytes(), marks))
    return pd.DataFrame(rows, columns=["bucket", "sigs", "at", "nodes", "marks"])


def _groups(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (signature, node) entries of a bucket whose signature has several nodes, with marks, and where each group starts."""
    each = lambda names, n: np.repeat(np.frombuffer(names, "<i8"), np.frombuffer(n, "<u4"))
    sig = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sigs"]])
    node = np.concatenate([each(x, n) for x, n in zip(pdf["nodes"], pdf["at"], strict=True)])
    marks = [each(m, n) for m, n in zip(pdf["marks"], pdf["at"], strict=True) if m]
    mark = np.concatenate(marks) if marks else node
    mark = np.where(mark == 0, node, mark)
    order = np.argsort(sig, kind="stable")
    same = np.diff(sig[order]) == 0
    keep = order[np.append(same, False) | np.insert(same, 0, False)]
    sig, node, mark = sig[keep], node[keep], mark[keep]
    order = np.lexsort((node, sig))
    sig, node, mark = sig[order], node[order], mark[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))[: len(sig)]
    sig, node, mark = sig[new], node[new], mark[new]
    # What was several entries of one node is alone by now.
    alone = np.append(True, sig[1:] != sig[:-1]) & np.append(sig[1:] != sig[:-1], True) if len(sig) else np.zeros(0, bool)
    sig, node, mark = sig[~alone], node[~alone], mark[~alone]
    return node, mark, np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])


def _pair_rows(pairs: list[np.ndarray], parts: int, shared: np.ndarray | None = None) -> pd.DataFrame:
    """Distinct pairs as arrays, dealt by a hash of the pair; and how often each node is in `shared`, dealt by node."""
    p = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), "<i8")
    to = (p[:, 0] ^ (p[:, 1] >> 7)) % parts
    rows = [(int(k), p[to == k].astype("<i8").tobytes(), None, None, False) for k in np.unique(to)]
    if shared is not None and len(shared):
        names, n = np.unique(shared, return_counts=True)
        to = names % parts
        rows += [(int(k), None, names[to == k].astype("<i8").tobytes(), n[to == k].astype("<u4").tobytes(), False) for k in np.unique(to)]
    return pd.DataFrame(rows, columns=["bucket", "pairs", "nodes", "counts", "again"])


def _star(node: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(least node, other node) of each group."""
    size = np.diff(np.append(first, len(node)))
    p = np.stack([np.repeat(node[first], size), node], 1)
    return p[p[:, 0] != p[:, 1]]


def coarse_pairs(docs: DataFrame, bits: int, parts: int) -> DataFrame:
    """Candidate pairs such that each similar pair's nodes are both in some: of all nodes that share a signature, stars.

    Nodes that share one within a task's batch make a star there, and only its centre goes on, so a signature of a hot group has a row
    of each batch at most.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, nodes, held, seen = [], [], 0, set()

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal held
            if not sigs:
                return
            sig, node = np.concatenate(sigs), np.repeat(np.array(nodes, "i8"), [len(x) for x in sigs])
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(first, len(sig)))
            local = _pair_rows([_star(node, first)], parts, node[np.repeat(size > 1, size)])
            yield pd.DataFrame({"bucket": -1 - local["bucket"], "sigs": local["pairs"], "at": local["counts"], "nodes": local["nodes"], "marks": None})
            yield _deal(bits, sig[first], node[first], None)
            sigs.clear()
            nodes.clear()
            seen.clear()
            held = 0

        for b in batches:
            for _, s in sets_of(b["text"]):
                if len(s) and (n := node_of(s)) not in seen:
                    seen.add(n)
                    nodes.append(n)
                    sigs.append(signatures(s, PERCENT))
                    held += len(sigs[-1])
                    if held >= FLUSH:
                        yield from flush()
        yield from flush()
        give_back()

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:  # pairs that map tasks found
            return pd.DataFrame({"bucket": -1 - pdf["bucket"], "pairs": pdf["sigs"], "nodes": pdf["nodes"], "counts": pdf["at"], "again": False})
        node, _, first = _groups(pdf)
        rows = _pair_rows([_star(node, first)] if len(node) else [], parts, node)
        give_back()
        return rows

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(emit, BLOBS).groupBy("bucket").applyInPandas(reduce, PAIRS)


def _pairs_within(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of each group, about AT_ONCE at a time; groups stand one after the other, `size` of each."""
    first = np.cumsum(size) - size
    for n in np.unique(size):
        at = first[size == n]
        rows = max(1, AT_ONCE // int(n))  # of the upper triangle
        for r in range(0, n - 1, rows):
            x, y = np.triu_indices(min(rows, n - r), 1, n - r)
            some = max(1, AT_ONCE // len(x))
            for i in range(0, len(at), some):
                yield (at[i : i + some, None] + (x + r)).ravel(), (at[i : i + some, None] + (y + r)).ravel()


class _Sketches:
    """Sketches of different lengths, all folded to any of those lengths."""

    def __init__(self, sketches: list[bytes]):
        self.raw, self.length, self.folded = sketches, np.array([len(x) for x in sketches]), {}

    def to(self, length: int) -> np.ndarray:
        if length not in self.folded:
            bits = np.zeros((len(self.raw), length), "u1")
            for i in np.flatnonzero(self.length >= length):
                bits[i] = np.bitwise_xor.reduce(np.frombuffer(self.raw[i], "u1").reshape(-1, length), 0)
            self.folded[length] = bits.view("u8")
        return self.folded[length]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lower bounds of the Hamming distances of pairs."""
        length, out = np.minimum(self.length[x], self.length[y]), np.zeros(len(x), "i8")
        for n in np.unique(length):
            at, bits = length == n, self.to(int(n))
            out[at] = np.bitwise_count(bits[x[at]] ^ bits[y[at]]).sum(1, dtype="i8")
        return out


MEETINGS = "task long, nodes binary, sizes binary, pairs binary, again boolean"


def fine_groups(sets: DataFrame, bits: int, parts: int, whole: int) -> DataFrame:
    """Groups of nodes, not all of one component (mark), that share a fine signature, some to a task.

    Rows with `again` have the nodes of groups of more than `whole` pairs of different components, and pairs that are their stars, dealt by a hash of the pair.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, nodes, marks, held = [], [], {}, 0
        for b in batches:
            for node, mark, features in zip(b["node"], b["mark"], b["features"], strict=True):
                nodes.append(node)
                if mark != node:
                    marks[node] = mark
                sigs.append(np.unique(fine_signatures(np.frombuffer(features, "<u8"), PERCENT)))
                held += len(sigs[-1])
                if held >= FLUSH:
                    yield _deal(bits, np.concatenate(sigs), np.repeat(np.array(nodes, "i8"), [len(x) for x in sigs]), marks)
                    sigs, nodes, marks, held = [], [], {}, 0
        if sigs:
            yield _deal(bits, np.concatenate(sigs), np.repeat(np.array(nodes, "i8"), [len(x) for x in sigs]), marks)
        give_back()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, rows = int(pdf["bucket"].iloc[0]), []
        node, mark, first = _groups(pdf)
        if len(first):
            size, done, some, held, large, stars = np.diff(np.append(first, len(node))), set(), [], 0, [], []

            def close() -> None:
                nonlocal some, held
                if some:
                    rows.append(((bucket << 32) + len(rows), np.concatenate(some).astype("<i8").tobytes(), np.array([len(x) for x in some], "<i8").tobytes(), None, False))
                some, held = [], 0

            for i in np.flatnonzero(np.minimum.reduceat(mark, first) != np.maximum.reduceat(mark, first)):
                n, m = node[first[i] : first[i] + size[i]], mark[first[i] : first[i] + size[i]]
                key = hash(n.tobytes())
                if key in done:  # the same nodes under another signature
                    continue
                done.add(key)
                if len(n) ** 2 > 2 * whole and (len(n) ** 2 - (np.unique(m, return_counts=True)[1] ** 2).sum()) // 2 > whole:
                    large.append(n)
                    stars.append(np.stack([np.full(len(n) - 1, n[0]), n[1:]], 1)[m[1:] != m[0]])
                    continue
                some.append(n)
                held += len(n)
                if held >= PER_TASK:
                    close()
            close()
            if large:
                rows.append((-1, np.unique(np.concatenate(large)).tobytes(), None, None, True))
                rows += [(-1 - b, None, None, p, True) for b, p in _pair_rows(stars, parts)[["bucket", "pairs"]].itertuples(index=False)]
        give_back()
        return pd.DataFrame(rows, columns=["task", "nodes", "sizes", "pairs", "again"])

    return sets.select("node", "mark", "features").mapInPandas(emit, BLOBS).groupBy("bucket").applyInPandas(meet, MEETINGS)


def fine_pairs(groups: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Pairs of nodes of different components within those groups that sizes and sketches don't rule out. Each task gets a node's sketch once."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for task, nodes in zip(b["task"], b["nodes"], strict=True):
                yield pd.DataFrame({"node": np.unique(np.frombuffer(nodes, "<i8"))}).assign(task=task)

    def compare(groups: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("node", ignore_index=True)
        name, mark, n, sketches = known["node"].to_numpy(), known["mark"].to_numpy(), known["size"].to_numpy(), _Sketches(known["sketch"].tolist())
        out = []
        for nodes, sizes in zip(groups["nodes"], groups["sizes"], strict=True):
            place = np.searchsorted(name, np.frombuffer(nodes, "<i8"))
            for x, y in _pairs_within(np.frombuffer(sizes, "<i8")):
                x, y = place[x], place[y]
                ok = (mark[x] != mark[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * PERCENT)
                x, y = np.divmod(np.unique(np.minimum(x[ok], y[ok]) * len(name) + np.maximum(x[ok], y[ok])), len(name))
                ok = sketches.apart(x, y) * (100 + PERCENT) <= (100 - PERCENT) * (n[x] + n[y])
                out.append(np.stack([name[x[ok]], name[y[ok]]], 1))
        rows = _pair_rows(out, parts)
        give_back()
        return rows

    groups = groups.filter("not again").select("task", "nodes", "sizes")
    known = cut(groups.mapInPandas(names, "node long, task long").join(sets.select("node", "mark", "size", "sketch"), "node"))
    return groups.groupBy("task").cogroup(known.groupBy("task")).applyInPandas(compare, PAIRS)


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for x in b["nodes"]:
            yield pd.DataFrame({"node": np.frombuffer(x, "<i8")})


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(u, v) of each pair once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in pdf["pairs"]]).reshape(-1, 2), axis=0)
        return pd.DataFrame({"u": p[:, 0], "v": p[:, 1]})

    return pairs.filter("pairs is not null").select("bucket", "pairs").groupBy("bucket").applyInPandas(run, "u long, v long")


def likely_nodes(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """(node, doc_id) of the nodes that share as many signatures as similar ones must, with the least document of each."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in pdf["nodes"]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]))
        return pd.DataFrame({"node": names, "shared": n.astype("i8")})

    def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[np.array([n >= shared_at_least(int(k), PERCENT) for n, k in zip(b["shared"], b["n"], strict=True)], bool), ["node", "doc_id"]].astype({"doc_id": "Int64"})

    shared = pairs.filter("nodes is not null").select("bucket", "nodes", "counts").groupBy("bucket").applyInPandas(count, "node long, shared long")
    sized = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    return shared.join(sized, "node").mapInPandas(enough, "node long, doc_id long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sets are similar: first by sizes and sketches, which rule out without error, then exactly."""
    short = sets.select("node", "size", "sketch")
    side = lambda c: short.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("u_size", "v_size") * 100 >= F.greatest("u_size", "v_size") * PERCENT)

    def may(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [least_distance(x, y) * (100 + PERCENT) <= (100 - PERCENT) * (m + n) for x, y, m, n in zip(b["u_sketch"], b["v_sketch"], b["u_size"], b["v_size"], strict=True)]
            yield b.loc[np.array(ok, bool), ["u", "v"]]

    left = sized.mapInPandas(may, "u long, v long")
    full = lambda c: sets.select(F.col("node").alias(c), F.col("features").alias(f"{c}_features"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["u_features"], b["v_features"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.loc[np.array(ok, bool), ["u", "v"]]

    left = cut(left)
    if left.count() <= FEW_PAIRS:
        sets = sets.join(F.broadcast(left.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "node", "left_semi")
    return left.join(full("u"), "u").join(full("v"), "v").select("u", "v", "u_features", "v_features").mapInPandas(exact, "u long, v long")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): the nodes of a task's links, each with the least that those links reach."""
    found = [b.to_numpy() for b in batches]
    if not found:
        return
    names, at = np.unique(np.concatenate(found), return_inverse=True)
    x, y = at.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[x], root[y])
        if (root[x] == root[y]).all():
            break
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root != root[root]).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(names)))
    for i in range(0, len(other), 1 << 16):
        some = other[i : i + (1 << 16)]
        yield pd.DataFrame({"u": names[some], "v": names[root[some]]})


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with column m of `least` (u, m, n = rows of u): nodes of very many edges, MOST_HOT at most by construction, get theirs by broadcast, so no task has all edges of one."""
    hot = F.col("n") >= max(32, -(-total // MOST_HOT))
    tried = edges.join(F.broadcast(least.filter(hot).select("u", "m")), "u", "left")
    rest = tried.filter("m is null").drop("m").join(least.filter(~hot).select("u", "m"), "u")
    return tried.filter("m is not null").unionByName(rest)


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of each node that has links; root is the least node reachable.

    First the links of each task become a forest. Up to `one_task` edges of those, so many as a task holds whatever the input, are joined by one more task;
    beyond that alternating large and small stars make all components at once. Every step of them is a written table (their sizes are known to the
    planner, while those of checkpoints of joins are estimated by products that grow with each step), and a round's tables go when the next round's are there.
    """
    spark = links.sparkSession
    top = fresh_dir(spark, "components")
    down = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    total = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
    step = 0
    edges = stored(links.filter("u <> v").mapInPandas(_forest, "u long, v long"), f"{top}/{step}/edges")
    before = total(edges)
    if before[0] <= one_task:
        edges = stored(edges.coalesce(1).mapInPandas(_forest, "u long, v long"), f"{top}/whole")
        before = (0, 0)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), f"{top}/{step}/least")
        large = stored(_with_least(both, least, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"{top}/{step}/large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{top}/{step}/least-of-large")
        small = _with_least(large, least, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(down(small), f"{top}/{step + 1}/edges")
        discard(spark, f"{top}/{step}")
        step, now = step + 1, total(edges)
        if now == before:
            break
        before = now
    star = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    out = cut(star.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    discard(spark, top)
    return out


def _by_node(sets: DataFrame) -> DataFrame:
    """The same rows in a checkpoint that keeps how the plan dealt them; an adaptive plan doesn't say."""
    with set_for(sets.sparkSession, spark__sql__adaptive__enabled="false"):
        return cut(sets)


def needed_sets(text: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size, sketch and features of each of `nodes`, from the text of the least document that has it; texts don't move.

    A Bloom filter of those documents' ids, of FILTER_WORDS words whatever their number, goes to all tasks; what else it lets pass falls in
    the exact join on nodes. The table is dealt by node and known to be, so joins on node leave it where it is.
    """
    word, bit = f"cast(pmod(xxhash64(doc_id), {FILTER_WORDS}) as int)", "cast(pmod(xxhash64(doc_id, 5), 64) as int)"
    words = nodes.groupBy(F.expr(word).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("b"))
    bits = np.zeros(FILTER_WORDS, "u8")
    for w, b in words.collect():
        bits[w] = np.uint64(b % (1 << 64))
    shared = text.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            passed = (shared.value[b["w"].to_numpy()] >> b["bit"].to_numpy().astype("u8")) & np.uint64(1) == 1
            rows = [(node_of(s), len(s), sketch(s), s.tobytes()) for _, s in sets_of(b["text"][passed]) if len(s)]
            yield pd.DataFrame(rows, columns=["node", "size", "sketch", "features"])

    made = text.select("text", F.expr(word).alias("w"), F.expr(bit).alias("bit")).mapInPandas(run, "node long, size long, sketch binary, features binary")
    return _by_node(made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def near_duplicates(docs: DataFrame, whole_group: int = WHOLE_GROUP) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Sets are of distinct 5-word shingles of the whole text, A-Z lower-cased, words parted by space and U+0009 to U+000D; with fewer
    words the sequence is the one shingle; null, empty and wordless texts have empty sets, link with nothing and are their own component.
    Documents link at a Jaccard similarity of at least 0.75, exactly; component_id is the least doc_id reachable by links.

    Equal sets are one node (named by a 64-bit hash of the set), so copies cost a row each. Round one: nodes that share a PartEnum signature make stars, and stars'
    pairs are verified, which already joins large groups of near copies. Round two, for the nodes met there alone: finer signatures (subsets of
    partitions), and all pairs of nodes that share one and aren't connected yet are verified. A group with more than `whole_group` such pairs gets a star and
    another round, for its nodes alone and with what is connected by then left out, until none is left or stars no longer connect anything; then it is written
    out in full. So no link between different components is lost, and pairs within a component aren't enumerated. Repeated doc_ids are rows each; null
    doc_ids never name a component that has others.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(len(s), node_of(s) if len(s) else None) for _, s in sets_of(b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_shingles": [n for n, _ in found], "node": pd.array([x for _, x in found], "Int64")})

    base = cut(text.mapInPandas(name, "doc_id long, n_shingles long, node long"))
    total = base.agg(F.sum("n_shingles")).first()[0] or 0
    linked = None
    if total:
        coarse = cut(coarse_pairs(text, _bucket_bits(total * 3 // 4), parts))
        nodes = cut(likely_nodes(coarse, base))
        if nodes.count():
            names = nodes.select("node")
            pairs = distinct_pairs(coarse)
            for side in "uv":
                pairs = pairs.join(names.withColumnRenamed("node", side), side, "left_semi")
            pairs = cut(pairs)
            sets = needed_sets(text, nodes)
            links = cut(verified(pairs, sets))
            root = components(links)
            whole, asked = whole_group, sets
            while True:
                size = asked.agg(F.sum("size")).first()[0] or 0
                marked = asked.join(root, "node", "left").withColumn("mark", F.coalesce("root", "node"))
                found = cut(fine_groups(marked, _bucket_bits(size * 3), parts, whole))
                stars = found.filter("again and pairs is not null").select((-1 - F.col("task")).cast("int").alias("bucket"), "pairs")
                near = cut(distinct_pairs(fine_pairs(found, marked, parts).select("bucket", "pairs").unionByName(stars)))
                more = cut(verified(near, asked))
                n = more.count()
                if n:
                    root = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
                left = found.filter("again and nodes is not null").select("nodes")
                if not left.limit(1).count():
                    break
                asked = _by_node(asked.join(left.mapInPandas(_named, "node long").distinct(), "node", "left_semi"))
                if not n:
                    whole = 1 << 40
            linked = root
    named = exact_groups(base.filter("node is not null"), "doc_id", "node", keep=F.min)
    bare = base.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if linked is None:
        return named.select("doc_id", "n_shingles", F.col("keep_id").alias("component_id")).unionByName(bare)
    named = cut(named)
    least = named.select("node", "keep_id").distinct().join(linked, "node").groupBy("root").agg(F.min("keep_id").alias("least"))
    of_node = linked.join(least, "root").select("node", "least")
    out = named.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "keep_id").alias("component_id"))
    return out.unionByName(bare)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), shingles as (
  select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached as (
  select doc_id, doc_id as other from documents
  union
  select reached.doc_id, y from reached join links on other = x
)
select doc_id, any_value(len(s)) as n_shingles, min(other) as component_id from sets join reached using (doc_id) group by doc_id
"""


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """One document of each component, that of the least doc_id, all its columns as they were. Documents with null ids stay.

    A Bloom filter of the ids that go lets all other rows pass where they are; only those it holds back move with their text. Where ids repeat,
    rows are numbered in the order of ids, and the numbers stand for the ids. An empty table stays one.
    """
    small_batches(spark)
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _stay(docs, "doc_id", near_duplicates(docs))
    mark = free_name(docs, "_row")
    rows = cut(docs.orderBy("doc_id", F.xxhash64("text")).withColumn(mark, F.monotonically_increasing_id()))
    return _stay(rows, mark, near_duplicates(rows.select(F.when(F.col("doc_id").isNotNull(), F.col(mark)).alias("doc_id"), "text"))).drop(mark)


def _stay(rows: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """The rows that are the least document of their component, by the column that names them."""
    gone = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")))
    stay, maybe = parted(rows, F.xxhash64(F.col(name).cast("long")), gone.select(F.xxhash64("_gone")))
    return stay.unionByName(maybe.join(gone, maybe[name] == gone["_gone"], "left_anti"))
