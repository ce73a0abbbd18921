"""N-gram Jaccard join by prefix trees: which documents link, and into which components.

The n-gram sets are put in one global order, the most frequent n-grams last. Two sets of
similarity t share at least l n-grams among the first n - ceil(t n) + l of either, for
any l; with l = 1 + n / 8, documents meet on such prefix n-grams, and those that share
too few with all others are out of it. Those left are compared in blocks of bounded
size: a block's sets stand in a trie in the global order, a set is probed against it
node by node so that common beginnings are intersected once, and subtrees whose
remaining length can't bring the overlap needed are left out.

Equal sets are one set from the start. Documents that meet are first compared in blocks of
those that share one leader, which joins most of a group of copies by a link per document.
Of what is left, documents stay that share so much of their whole sets with documents of
other components as a link asks for, and those that still share a prefix n-gram are
compared. So no links between different texts are lost, no group is expanded into its
pairs, and a passage that many documents share brings none of them together.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import discard, documents, ship, slices, stash

#: Most frequent n-grams that the global order puts last; any order gives the same links.
FREQUENT = 1 << 15
#: Prefixes are longer than one shared n-gram needs by a set's size over SPARE, so that links have to share that many more.
SPARE = 8
#: Documents in one block.
BLOCK = 256
#: Documents in a cluster that is compared as a whole in any case.
CLUSTER = 4096
#: Depths at which a trie's segments are cut.
CUTS = (64, 256)
#: Links that one task joins at once.
LINKS = 100_000
#: Documents of a frequent n-gram that one group of a window holds, about.
PIECE = 500
#: N-grams of one task that are counted together.
COUNTED = 2_000_000
_RANDOM = np.random.default_rng(7)
_BYTES = _RANDOM.integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STRETCH = 50_000  # words


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, as long as any stretch was so far."""

    n, up, down = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = 1 << n.bit_length()
            cls.up, cls.down = _powers(_BASE, cls.n), _powers(pow(_BASE, -1, 2**64), cls.n)
        return cls.up, cls.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word n-grams; of all words together if there are fewer; none without words.

    Only A-Z are lower-cased, only ASCII white space separates words. The hash of a span
    of bytes is a polynomial over random numbers for the bytes, taken from prefix sums,
    so n-grams cost a few array operations. Two n-grams share a hash with a probability
    of about 2**-64.
    """
    words = (text or "").encode().lower().split()
    found = []
    for k in range(0, max(1, len(words) - n + 1), _STRETCH):
        own = words[k : k + _STRETCH + n - 1]
        if not own:
            break
        line = np.frombuffer(b" ".join(own), np.uint8)
        up, down = _Tables.get(len(line) + 1)
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(_BYTES[line] * up[: len(line)], out=sums[1:])
        ends = np.append(np.flatnonzero(line == 32), len(line))  # no word holds a space
        starts = np.concatenate(([0], ends[:-1] + 1))
        width = min(n, len(own))
        a, b = starts[: len(own) - width + 1], ends[width - 1 :]
        found.append(_mix((sums[b] - sums[a]) * down[a]))
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.concatenate(found)
    hashes.sort()
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    return hashes[first]


@dataclass
class Order:
    """The global order: hashes by value, then the frequent ones, the most frequent last."""

    frequent: np.ndarray  # ascending hashes
    place: np.ndarray  # of each in the order of frequency

    def arrange(self, hashes: np.ndarray) -> np.ndarray:
        """The set as ascending codes: half the hash, or 2**63 and the place of a frequent one."""
        codes = hashes >> np.uint64(1)
        if len(self.frequent) and len(hashes):
            at = np.searchsorted(self.frequent, hashes)
            at[at == len(self.frequent)] = 0
            hit = self.frequent[at] == hashes
            codes[hit] = np.uint64(1 << 63) + self.place[at[hit]]
            codes.sort()
        return codes


class Trie:
    """Ascending sets, with common beginnings stored once.

    Nodes stand in arrays, those of one parent side by side, so that a search goes down
    all branches at once, a step per level. Long segments are cut at CUTS, where a branch may
    end. The arrays are made at the first search after an insert.
    """

    def __init__(self, sets: Iterable[np.ndarray] = ()):
        self.sets = list(sets)
        self.names = list(range(len(self.sets)))
        self.built = 0

    def insert(self, codes: np.ndarray, name: int) -> None:
        self.sets.append(codes)
        self.names.append(name)

    def _build(self) -> None:
        self.built = len(self.sets)
        sizes = [len(x) for x in self.sets]
        # codes as places in the ascending list of all of them
        self.codes, places = np.unique(np.concatenate(self.sets), return_inverse=True)
        flat, starts = places.ravel(), np.cumsum([0, *sizes])
        rows = [flat[starts[k] : starts[k + 1]] for k in range(len(sizes))]
        ordered = sorted(range(len(rows)), key=lambda k: rows[k].astype(">u4").tobytes())
        common = [0] * len(ordered)  # how much of a set is the beginning of the one before
        for k in range(1, len(ordered)):
            x, y = rows[ordered[k - 1]], rows[ordered[k]]
            m = min(len(x), len(y))
            differ = x[:m] != y[:m]
            at = int(differ.argmax()) if m else 0
            common[k] = at if m and differ[at] else m
        length = np.array([sizes[k] for k in ordered])
        nodes: list[tuple[int, ...]] = []  # first set, end of sets, start in flat, length, depth, sets that end here

        def below(lo: int, hi: int, depth: int) -> list[tuple[int, int, int]]:
            cuts = [lo, *(k for k in range(lo + 1, hi) if common[k] <= depth), hi]
            return [(x, y, depth) for x, y in itertools.pairwise(cuts)] if lo < hi else []

        empty = int(np.count_nonzero(length == 0))
        waiting, children = below(empty, len(ordered), 0), []
        self.roots = len(waiting)
        for lo, hi, depth in waiting:  # grows meanwhile
            end = min(common[lo + 1 : hi], default=sizes[ordered[lo]])
            stop = next((c for c in CUTS if depth < c < end), end)
            here = lo
            while stop == end and here < hi and length[here] == end:
                here += 1
            nodes.append((lo, hi, starts[ordered[lo]] + depth, stop - depth, stop, here - lo))
            down = below(here, hi, stop) if stop == end else [(lo, hi, stop)]
            children.append((len(waiting), len(down)))
            waiting.extend(down)
        self.flat, self.ordered = flat, np.array([self.names[k] for k in ordered])
        self.lo, self.hi, self.at, self.length, self.depth, self.ends = np.array(nodes, np.int64).reshape(-1, 6).T
        self.child, self.children = np.array(children, np.int64).reshape(-1, 2).T
        self.last = flat[self.at + self.length - 1]
        bounds = np.column_stack((self.lo, self.hi)).ravel()
        padded = np.append(length, 0)
        self.shortest, self.longest = (f.reduceat(padded, bounds)[::2] for f in (np.minimum, np.maximum))
        self.inside = np.zeros(len(self.codes), bool)

    def similar(self, codes: np.ndarray, percent: int, skip: np.ndarray | None = None) -> Iterator[int]:
        """Names of the sets with 100 |both| >= percent |either|, walking with the overlap so far.

        A set of size m needs an overlap of percent (n + m) / (100 + percent); a subtree
        goes when its overlap so far and the shorter of both remainders don't give that
        for its shortest feasible size. Names that `skip` marks, and subtrees that hold no
        others, are left out.
        """
        if not self.sets or not len(codes):
            return
        if self.built != len(self.sets):
            self._build()
        n = len(codes)
        least, most = -(-percent * n // 100), 100 * n // percent
        found = np.searchsorted(self.codes, codes)
        found = found[found < len(self.codes)]
        found = found[self.codes[found] == codes[: len(found)]]
        wanted = None if skip is None else np.concatenate(([0], np.cumsum(~skip[self.ordered])))
        self.inside[found] = True
        node, overlap = np.arange(self.roots), np.zeros(self.roots, np.int64)
        names: list[int] = []
        while len(node):
            keep = (self.longest[node] >= least) & (self.shortest[node] <= most)
            if wanted is not None:
                keep &= wanted[self.hi[node]] > wanted[self.lo[node]]
            node, overlap = node[keep], overlap[keep]
            if not len(node):
                break
            offset, steps = _spread(self.at[node], self.length[node])
            overlap = overlap + np.add.reduceat(self.inside[self.flat[steps]], offset, dtype=np.int64)
            depth = self.depth[node]
            rest = len(found) - np.searchsorted(found, self.last[node], "right")
            needed = -(-percent * (n + np.maximum(least, self.shortest[node])) // (100 + percent))
            keep = overlap + np.minimum(rest, np.minimum(self.longest[node], most) - depth) >= needed
            node, overlap, depth = node[keep], overlap[keep], depth[keep]
            hit = (self.ends[node] > 0) & (100 * overlap >= percent * (n + depth - overlap))
            for k in node[hit].tolist():
                names.extend(self.ordered[self.lo[k] : self.lo[k] + self.ends[k]].tolist())
            inner = self.children[node] > 0
            node, overlap = node[inner], overlap[inner]
            if len(node):
                many = self.children[node]
                node, overlap = _spread(self.child[node], many)[1], np.repeat(overlap, many)
        self.inside[found] = False
        yield from names if skip is None else (x for x in names if not skip[x])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, one after another, and where each run begins in them; no run is empty."""
    offset = np.cumsum(lengths) - lengths
    return offset, np.repeat(starts - offset, lengths) + np.arange(offset[-1] + lengths[-1])


def links_in_block(sets: list[np.ndarray], roles: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) between sets of different roles that join them: every set reaches the same ones as by all links.

    Sets that are already joined, by their roles or by links found, aren't compared again.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    group = np.unique([roles[k] for k in order], return_inverse=True)[1]
    sizes = [len(sets[k]) for k in order]
    trie = Trie(sets[k] for k in order)
    for i in range(1, len(order)):
        long_enough = bisect.bisect_left(sizes, -(-percent * sizes[i] // 100), 0, i)
        if long_enough == i or (group[long_enough:i] == group[i]).all():
            continue
        skip = group == group[i]
        skip[:long_enough] = skip[i:] = True
        for j in trie.similar(sets[order[i]], percent, skip):
            if group[i] != group[j]:
                yield order[i], order[j]
                group[group == group[j]] = group[i]


def _summaries(n: int):
    """Per text: its set's size and 128-bit digest; per task: the n-grams that it saw most often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        waiting: list[np.ndarray] = []
        held = 0

        def count() -> None:
            nonlocal held, counts
            values, times = np.unique(np.concatenate(waiting), return_counts=True)
            for v, k in zip(values[times > 2].tolist(), times[times > 2].tolist(), strict=True):
                counts[v] = counts.get(v, 0) + k
            if len(counts) > 4 * FREQUENT:
                counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT])
            waiting.clear()
            held = 0

        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = ngram_set(text, n)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                rows.append((doc, len(own), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                waiting.append(own)
                held += len(own)
                if held > COUNTED:
                    count()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], names)
        if waiting:
            count()
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: FREQUENT // 4]
        h, k = np.array([x[0] for x in top], np.uint64).view(np.int64), [x[1] for x in top]
        zero = pa.array([0] * len(top), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(top), pa.int32()), pa.array(h), pa.array(k, pa.int64()), zero, zero], names)

    names = ["kind", "id", "n", "key_1", "key_2"]
    return run


def _prefixes(order, n: int, percent: int, whole: bool = False):
    """The prefix n-grams of each text, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, codes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = order.value.arrange(ngram_set(text, n))
                size = len(own)
                if not whole:
                    own = own[: size - (percent * size + 99) // 100 + 1 + size // SPARE]
                ids.append(np.full(len(own), doc, np.int64))
                codes.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(ids))], ["gram", "id"])

    return run


def _compare(order, n: int, percent: int):
    """Links of the blocks, whose rows come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            found = [(ids[i], ids[j]) for i, j in links_in_block(sets, roles, percent)]
            if found:
                u, v = zip(*[(max(x), min(x)) for x in found], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        block, ids, roles, sets = None, [], [], []
        for batch in slices(batches):
            for key, part, role, doc, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if block != (key, part):
                    yield from close()
                    block, ids, roles, sets = (key, part), [], [], []
                ids.append(doc)
                roles.append(role)
                sets.append(order.value.arrange(ngram_set(text, n)))
        yield from close()

    return run


def _linked(blocks: DataFrame, texts: DataFrame, order, n: int, percent: int) -> DataFrame:
    """Links (u > v) between the documents of each block (key, part) whose roles differ."""
    rows = blocks.join(texts, "id").select("key", "part", "role", "id", "text")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(_compare(order, n, percent), "u long, v long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's links as a link from each vertex to the smallest that they reach here."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, top(x)) for x in parent]
    u, v = [x for x, y in found if x != y], [y for x, y in found if x != y]
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(u, v): every vertex that isn't the smallest of its component, and that smallest one.

    Each partition first reduces its own LINKS links or so to stars; one partition is
    done with that. Of several, large-star and small-star steps join the stars, in turn,
    until nothing changes. Each step is two grouped minimums and joins over written
    tables, whose skewed parts Spark can split.
    """
    ship(links.sparkSession)
    given = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    parts = -(-given.count() // LINKS)
    edges = stash(given.coalesce(max(1, parts)).mapInArrow(_stars, "u long, v long"), "stars")
    discard(given)
    seen = None
    while parts > 1:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = stash(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star-min")
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large-star")
        smallest = stash(large.groupBy("u").agg(F.min("v").alias("m")), "small-star-min")
        small = large.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        small = stash(small.where("u > v").distinct(), "small-star")
        discard(edges, least, large, smallest)
        edges = small
    return edges


def _of_several(own: DataFrame) -> DataFrame:
    """The rows of n-grams that documents of several components share, with the number k of their documents."""
    counts = own.groupBy("gram").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("k")).where("a <> b")
    counts = stash(counts.select("gram", "k"), "several")
    out = stash(own.drop("k").join(counts, "gram"), "of-several")
    discard(counts)
    return out


def _covered(own: DataFrame, rows: DataFrame, sets: DataFrame, order, n: int, percent: int) -> DataFrame:
    """The rows of `own` (gram, id, c, k) whose documents share `percent` of their whole sets with documents of other components.

    Either document of a link does. Those that have no more in common than a passage,
    however many they are, drop out here before any text is compared.
    """
    ids = stash(own.select("id", "c").distinct(), "candidates")
    grams = rows.join(ids.select("id"), "id", "left_semi").mapInArrow(_prefixes(order, n, percent, whole=True), "gram long, id long")
    grams = stash(grams.join(ids, "id"), "candidate-sets")
    several = _of_several(grams)
    discard(grams)
    needed = sets.where("id is not null").groupBy("id").agg(F.min("n").alias("n"))
    enough = several.groupBy("id").count().join(needed, "id").where(F.col("count") * 100 >= F.col("n") * percent).select("id")
    left = stash(own.join(stash(enough, "covered"), "id", "left_semi"), "covered-shared")
    discard(several, own, ids)
    return _of_several(left)


def _dealt(rows: DataFrame, size: str) -> DataFrame:
    """Rows (key, role, id) of groups of `size` documents dealt into pairs of blocks, so that any two meet in one part."""
    rows = rows.withColumn("parts", F.ceil(F.col(size) / BLOCK).cast("long")).withColumn("b", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select("key", (F.least("b", "o") * F.col("parts") + F.greatest("b", "o")).alias("part"), "role", "id")


def _blocks(own: DataFrame) -> DataFrame:
    """Where documents that share an n-gram of `own` (gram, id, c, k) are compared: key, part, role, id.

    Documents that n-grams connect, directly or by others, are a cluster. A cluster of up
    to CLUSTER documents is compared as a whole; that brings together each two that share
    an n-gram, and every document once or a few times. In a larger one, which n-grams
    shared by chance may hold together, only the documents of each n-gram are, where that
    sends fewer copies of texts than the whole: of a large group of near copies, each of
    many n-grams has nearly all documents.
    """
    heads = stash(own.groupBy("gram").agg(F.min("id").alias("head")), "cluster-heads")
    edges = own.join(heads, "gram").select(F.col("id").alias("u"), F.col("head").alias("v"))
    members = components(edges).withColumnsRenamed({"u": "id", "v": "cluster"})
    docs = own.select("id", "c").distinct().join(members, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    docs = stash(docs, "cluster-members")
    sizes = stash(docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster-sizes")
    whole = docs.join(sizes, "cluster").select("cluster", F.col("cluster").alias("key"), F.col("c").alias("role"), "id", "size")
    over = sizes.where(F.col("size") > CLUSTER)
    if over.isEmpty():
        return _dealt(whole.drop("cluster"), "size")
    large = stash(docs.join(over, "cluster").select("id", "cluster"), "large-clusters")
    digest = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    once = own.join(large, "id").groupBy("cluster", "gram", "k").agg(*digest)
    once = stash(once.groupBy("cluster", "k", "x", "y").agg(F.min("gram").alias("gram")), "grams-of-large")  # of the same documents
    copies = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK)
    each = once.groupBy("cluster").agg(F.sum(copies("k")).alias("each")).join(over, "cluster")
    each = stash(each.where(F.col("each") < copies("size")).select("cluster"), "by-gram")
    grams = own.drop("k").join(once.join(each, "cluster", "left_semi").select("gram", "k"), "gram")
    whole = whole.join(each, "cluster", "left_anti").drop("cluster")
    return _dealt(whole, "size").union(_dealt(grams.select(F.col("gram").alias("key"), F.col("c").alias("role"), "id", "k"), "k"))


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of `df`: key, n_shingles, component_id.

    Rows link when 100 |both sets| >= percent |either set|; component_id is the smallest
    key that links reach from a row. Rows without words have the set of size 0, link
    with nothing and are their own component. Keys must be integers; rows with a null key
    come out with their count and a null component_id; rows that repeat a key count as
    one document of each text. An empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    seen = stash(rows.mapInArrow(_summaries(n), "kind int, id long, n long, key_1 long, key_2 long"), "sets")
    sets = seen.where("kind = 0").select("id", "n", "key_1", "key_2")

    top = seen.where("kind = 1").groupBy("id").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "id").limit(FREQUENT).collect()
    hashes = np.array([r["id"] for r in reversed(top)], np.int64).view(np.uint64)
    ascending = np.argsort(hashes, kind="stable")
    order = spark.sparkContext.broadcast(Order(hashes[ascending], np.arange(len(hashes), dtype=np.uint64)[ascending]))
    pieces = -(-max([r["k"] for r in top], default=1) // PIECE)

    firsts = sets.where("n > 0 and id is not null").groupBy("key_1", "key_2").agg(F.min("id").alias("first"), F.first("n").alias("n"))
    firsts = stash(firsts, "first-of-set")
    chosen = firsts.select(F.col("first").alias("id"), "n").distinct()
    texts = rows.join(chosen.select("id").hint("shuffle_hash"), "id", "left_semi")
    grams = texts.mapInArrow(_prefixes(order, n, percent), "gram long, id long")
    # a frequent n-gram's documents are dealt into pieces, so that no group of the window is unbounded
    frequent = F.col("gram") < 0
    grams = grams.withColumn("piece", F.when(frequent, F.pmod(F.xxhash64("id"), F.lit(pieces))).otherwise(0).cast("int"))
    shared = grams.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("gram", "piece")))
    shared = stash(shared.where(frequent | (F.col("k") > 1)).select("gram", "id"), "shared")

    # a document links only where it shares at least `asked` prefix n-grams with another
    asked = (1 + F.floor(F.ceil(F.col("n") * percent / 100) / SPARE)).cast("long").alias("asked")
    able = stash(shared.groupBy("id").count().join(chosen, "id").select("id", "count", asked).where("count >= asked").drop("count"), "able")
    met = shared
    shared = stash(shared.join(able, "id"), "able-shared")
    discard(met, able)

    # one leader for each document: the one with which it shares most prefix n-grams
    heads = shared.groupBy("gram").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("k"))
    heads = stash(heads.where("k > 1").drop("k"), "heads")
    votes = shared.join(heads, "gram").where("leader < id").groupBy("id", "leader").count()
    chosen = stash(votes.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader")), "leaders")
    sizes = chosen.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    sizes = stash(sizes, "leader-sizes")
    part, leader = F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"), F.col("leader").alias("key")
    followers = chosen.join(sizes, "leader").select(leader, part.alias("part"), F.col("id").alias("role"), "id")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    led = sizes.select(leader, parts, F.col("leader").alias("role"), F.col("leader").alias("id"))
    links = stash(_linked(followers.union(led), texts, order, n, percent), "leader-links")
    joined = components(links)

    # what shares enough n-grams with documents of other components
    own = shared.join(joined.withColumnsRenamed({"u": "id", "v": "c"}), "id", "left")
    own = stash(own.select("gram", "id", "asked", F.coalesce("c", "id").alias("c")), "shared-components")
    discard(shared, heads)
    several = _of_several(own)
    discard(own)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("k"), "gram"))
    open_ = several.withColumn("all", F.count(F.lit(1)).over(W.partitionBy("id"))).withColumn("rank", rank).where("all >= asked")
    # both documents of a link may leave out half of what they have to share, less one: the most frequent
    open_ = stash(open_.where(F.col("rank") > F.floor((F.col("asked") - 1) / 2)).select("gram", "id", "c"), "open")
    discard(several)
    own = _of_several(open_)
    discard(open_)
    own = _covered(own, rows, sets, order, n, percent)
    blocks = _blocks(own)
    rest = stash(_linked(blocks, texts, order, n, percent), "other-links")
    joined = components(joined.union(rest))

    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("first")
    first = sets.join(firsts.drop("n"), ["key_1", "key_2"], "left").select("id", "n", first)
    found = first.join(joined.withColumnsRenamed({"u": "first", "v": "c"}), "first", "left")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "first").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents under word 5-grams and a similarity of 0.75."""
    return similar_components(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 OR words IS NULL THEN []::VARCHAR[]
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) END AS grams
  FROM w
), sized AS (SELECT doc_id, len(grams)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT x, y FROM both_ JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y
  WHERE 100 * k >= 75 * (p.n_shingles + q.n_shingles - k)
), e AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.other)
SELECT sized.doc_id, n_shingles, least(sized.doc_id, coalesce(m.other, sized.doc_id)) AS component_id
FROM sized LEFT JOIN (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1) m USING (doc_id)
"""
