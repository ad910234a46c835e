"""Near-duplicate documents by b-bit MinHash.

Each document becomes its set of word shingles (A-Z lower-cased; 52-bit hashes), and documents with
equal sets become one node, so that exact copies never meet again. Of 256 permutations' minima 2 bits
are kept, packed into eight longs; 42 bands of 6 whole minima give candidate buckets. A pair of
similarity 0.8 misses all bands with probability 5e-6. The bits are taken after a finaliser with the
permutation's number: the low bits of a minimum itself depend on no more than the low bits of the
shingle, so that unequal minima would agree in all permutations at once.

First each node is paired with its bucket's smallest. The bit counts of two signatures give their
agreement; with a chance agreement of 1/4 taken out it estimates the similarity (standard error
0.03), and pairs four and a half errors below the limit fall away. The others are confirmed on the
full sets. Where a bucket then still holds several components, the nodes that look similar across
them form families, and in each family the nodes outside its largest component are held against
all others by an index of the full sets' rarest items; only links that join components leave the task.
So no link is lost to the pairing, and a group of copies costs a few pairs for each of them.

Components come from alternating large and small stars, written to the shared folder in each round.

Defined results: texts without words have the empty set, and are linked with nothing; a text of
fewer words than a shingle is one shingle; a null doc_id is kept and linked with nothing; rows with
the same doc_id are one node; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwell.llm.common import Words, documents, gathered, mixed, settled, slices, text_bytes, written

HASHES, BANDS, ROWS, BITS = 256, 42, 6, 2
SIMILARITY = 80  # percent of the union
SHINGLE = 5
#: Pairs of which the estimate is below this aren't confirmed: the limit less four and a half standard errors.
LEAST_ESTIMATE = 0.66
#: Nodes of a bucket whose signatures meet in one task, and shingles of the sets that meet in one (twice over).
BLOCK, FAMILY = 4_000, 2_000_000

_RNG = np.random.default_rng(20_240_601)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SALT = np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits, ascending in each text) and where each text's begin."""
    words = Words(data, at)
    hashes = words.hashes(lower=True)
    owners, found = [], []
    first, whole = words.windows(hashes, k)
    owners.append(words.owner[first])
    found.append(whole)
    for n in range(1, k):  # texts of n words are one shingle
        rows = np.flatnonzero(words.counts == n)
        out = np.full(len(rows), np.uint64(n), np.uint64)
        for j in range(n):
            out = mixed(out + hashes[words.first[rows] + j])
        owners.append(rows)
        found.append(out)
    out, places = [], np.zeros(words.n, np.int64)
    owner, found = np.concatenate(owners), np.concatenate(found)
    step = 4096  # so many texts share a sort: 12 bits for the text, 52 for the hash
    for begin in range(0, words.n, step):
        own = (owner >= begin) & (owner < begin + step) if words.n > step else slice(None)
        keys = np.unique((owner[own] - begin).astype(np.uint64) << np.uint64(52) | found[own] >> np.uint64(12))
        out.append(keys & np.uint64((1 << 52) - 1))
        places[begin : begin + step] = np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=step)[: words.n - begin]
    values = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], np.cumsum(places)])


def signatures(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (8 longs) and band keys (one long a band) of non-empty sets."""
    n = len(begin)
    x = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    minima, scratch = np.empty((HASHES, n), np.uint32), np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, _A[i], out=scratch)
        np.add(scratch, _B[i], out=scratch)
        minima[i] = np.minimum.reduceat(scratch, begin)
    drawn = np.stack([mixed(minima[i] + _SALT[i]) for i in range(HASHES)]).astype(np.uint8)
    low = [np.ascontiguousarray(((drawn >> np.uint8(b)) & np.uint8(1)).T) for b in range(BITS)]
    planes = [np.ascontiguousarray(np.packbits(x, axis=1)).view("<i8") for x in low]
    keys = np.empty((n, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(n, np.uint64(band + 1), np.uint64)
        for row in minima[band * ROWS : (band + 1) * ROWS]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, band] = key
    return np.concatenate(planes, axis=1), keys.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (broadcast over all but the last axis), chance agreement taken out."""
    half = HASHES // 64
    differ = (a[..., :half] ^ b[..., :half]) | (a[..., half:] ^ b[..., half:])
    agree = 1 - np.bitwise_count(differ.view(np.uint64)).sum(-1, dtype=np.int64) / HASHES
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def _estimate_sql(a: str, b: str) -> str:
    half = HASHES // 64
    parts = [f"bit_count(({a}[{i}] ^ {b}[{i}]) | ({a}[{i + half}] ^ {b}[{i + half}]))" for i in range(half)]
    chance = 1 / (1 << BITS)
    return f"((1D - ({' + '.join(parts)}) / {HASHES}D) - {chance}D) / {1 - chance}D"


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, at = shingle_sets(*text_bytes(batch.column("text")), k)
            n = np.diff(at)
            some = np.flatnonzero(n)
            packed, keys = np.zeros((len(n), 2 * HASHES // 64), np.int64), np.zeros((len(some), BANDS), np.int64)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                packed[some], keys = signatures(values, at[some])
                s1[some] = np.add.reduceat(mixed(values), at[some])
                s2[some] = np.bitwise_xor.reduceat(mixed(values * np.uint64(3) + np.uint64(1)), at[some])
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            sig = pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), packed.shape[1]).cast(pa.list_(pa.int64()))
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), sig, bands],
                ["doc_id", "n_shingles", "s1", "s2", "sig", "bands"],
            )

    return sign


def _setter(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, at = shingle_sets(*text_bytes(batch.column("text")), k)
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["id", "items"])

    return make


def _fewer(frame: DataFrame) -> DataFrame:
    """Rows of a few numbers per node or pair, in fewer tasks and files than the shuffle's, of which the number suits whole texts."""
    spark = frame.sparkSession
    return frame.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """lo (smallest node of a component) and hi (each of its others) of the edges (a, b), which are read twice.

    In a round an edge's smaller end gives way to the smallest node it is tied to itself (large stars), and what a
    node is then tied to is tied to the smallest of it (small stars). An edge leaves one edge at most, and the table says
    whether any has moved. Both sides of the join are dealt anyway; broadcasts in each round would only fill the driver.
    """
    now = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi")
    node = Window.partitionBy("hi").orderBy("lo", "moved")
    while True:
        least = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = now.join(least.hint("merge"), "lo", "left").select(F.coalesce("m", "lo").alias("lo"), "hi", F.col("m").isNotNull().alias("moved"))
        small = large.withColumns({"m": F.first("lo").over(node), "last": F.lag("lo").over(node)}).where("last IS NULL OR last < lo")
        other = F.col("m") < F.col("lo")
        small = small.select(F.col("m").alias("lo"), F.when(other, F.col("lo")).otherwise(F.col("hi")).alias("hi"), (F.col("moved") | other).alias("moved"))
        out = written(_fewer(small), name)
        now = out.select("lo", "hi")
        if not out.agg(F.bool_or("moved")).first()[0]:
            return now


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, label (smallest node of its component) for every node of the edges (a, b), which are read twice."""
    now = stars(edges, name)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select("lo", "lo").distinct())


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, of batches in which they follow each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(batch.num_rows, bool)
        for column in columns:
            edge[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _open_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a bucket that may be linked across components, as a star for each group that hangs together."""
    for table in _groups(batches, ["bucket", "i", "j"]):
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        block, sig = table.column("block").to_numpy(), _matrix(table, "sig")
        left, right = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("i", "j"))
        near = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            near[at : at + 256] = (labels[own][:, None] != labels[right]) & (estimated(sig[own][:, None], sig[right]) >= LEAST_ESTIMATE)
        todo = near.any(1)
        while todo.any():  # breadth first from row to column to row
            rows, columns = np.zeros(len(left), bool), np.zeros(len(right), bool)
            fresh = np.zeros(len(left), bool)
            fresh[np.argmax(todo)] = True
            while fresh.any():
                rows |= fresh
                columns |= near[fresh].any(0)
                fresh = near[:, columns].any(1) & ~rows
            todo &= ~rows
            group = np.unique(np.concatenate([ids[left[rows]], ids[right[columns]]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(group) - 1, group[0])), pa.array(group[1:])], ["a", "b"])


class PrefixIndex:
    """Sets by their rarest items, to find those that may share ``percent`` of a union with another set.

    Items are ordered by how many of the sets hold them. Two sets that are linked have a first common item in
    that order, among the rarest ``100 - percent`` of each, and no more items in common than either has from
    there on. A list holds an item's sets by how much that leaves for them, so that a look-up reads
    only those for which it can be enough: boilerplate that many sets share costs them nothing.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        items = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.keys, self.codes, counts = np.unique(items, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.keys), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(self.keys))
        self.ends = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((self.rank[self.codes], owner))
        place = np.arange(len(items)) - (self.ends - self.sizes)[owner]
        early = place < self.prefix(self.sizes)[owner]
        code, owner, place = self.codes[order][early], owner[early], place[early]
        spare = (self.sizes[owner] - place) * (100 + percent) - percent * self.sizes[owner]
        order = np.lexsort((-spare, code))
        self.owner, self.less = owner[order], -spare[order]
        self.lists = np.searchsorted(code[order], np.arange(len(self.keys) + 1))
        self.held = np.zeros(len(self.keys), bool)

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """How many of its rarest items a set is found by."""
        return sizes - (self.percent * sizes + 99) // 100 + 1

    def _codes_in(self, items: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        return at[self.keys[at] == items]

    def candidates(self, items: np.ndarray) -> np.ndarray:
        """Sets that may be linked with this one, itself included."""
        codes, size = self._codes_in(items), len(items)
        codes = codes[np.argsort(self.rank[codes])]
        first = size - len(codes)  # items that no set holds are the rarest
        found = []
        for at, code in enumerate(codes[: max(int(self.prefix(np.int64(size))) - first, 0)].tolist(), first):
            a, b = self.lists[code], self.lists[code + 1]
            near = self.owner[a : a + np.searchsorted(self.less[a:b], -self.percent * size, "right")]
            found.append(near[self.percent * (size + self.sizes[near]) <= (100 + self.percent) * (size - at)])
        near = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        small, large = np.minimum(self.sizes[near], size), np.maximum(self.sizes[near], size)
        return near[100 * small >= self.percent * large]

    def linked(self, items: np.ndarray, others: np.ndarray) -> Iterator[int]:
        """Those of the sets that are linked with this one, by all items."""
        codes = self._codes_in(items)
        self.held[codes] = True
        try:
            for i in others.tolist():
                common = int(np.count_nonzero(self.held[self.codes[self.ends[i] - self.sizes[i] : self.ends[i]]]))
                if 100 * common >= self.percent * (len(items) + int(self.sizes[i]) - common):
                    yield i
        finally:
            self.held[codes] = False


def _crossed(percent: int):
    """Links between components of a family: each asking node's set against all others."""

    def cross(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        x, y = frame[asks], frame[~asks]
        ids, labels = y["id"].to_numpy(), y["label"].to_numpy()
        index = PrefixIndex(y["items"].to_list(), percent)
        parent: dict[int, int] = {}

        def root(n: int) -> int:
            while parent.get(n, n) != n:
                n = parent[n]
            return n

        out = []
        for node, label, own in zip(x["id"], x["label"].astype(int), x["items"]):
            near = index.candidates(own)
            apart = near[np.fromiter((root(int(c)) != root(label) for c in labels[near]), bool, len(near))]
            for i in index.linked(own, apart):
                other = root(int(labels[i]))
                if other != root(label):  # one link is enough to join two components
                    parent[other] = root(label)
                    out.append((node, ids[i]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return cross


def _linked(percent: int):
    def link(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        items = dict(zip(sets["id"], sets["items"]))
        keep = np.zeros(len(pairs), bool)
        for n, (a, b) in enumerate(zip(pairs["a"], pairs["b"])):
            x, y = items[a], items[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges two ascending runs
                common = int((both[1:] == both[:-1]).sum())
                keep[n] = 100 * common >= percent * (len(both) - common)
        return pairs.loc[keep, ["a", "b"]]

    return link


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) that are links, by their full sets.

    A set travels once to each task that needs it: pairs meet by the components of all pairs, and
    large components in blocks of their nodes.
    """
    tied = stars(pairs, "families")
    labels = tied.select(F.col("hi").alias("id"), F.col("lo").alias("label")).union(tied.select("lo", "lo").distinct())
    sized = labels.join(sets.select("id", F.size("items").alias("n")), "id")
    large = sized.groupBy("label").agg(F.ceil(F.sum("n") / FAMILY).alias("blocks")).where("blocks > 1")  # one for so many shingles at most
    named = pairs.join(tied.select(F.col("hi").alias("b"), F.col("lo").alias("label")), "b").join(F.broadcast(large), "label", "left")
    p, q = (F.pmod(F.xxhash64(end), F.coalesce("blocks", F.lit(1))) for end in "ab")
    placed = written(_fewer(named.select("a", "b", F.xxhash64("label", F.least(p, q), F.greatest(p, q)).alias("task"))), "placed")
    needed = placed.select(F.col("task").alias("at"), F.col("a").alias("id")).union(placed.select("task", "b")).distinct().join(sets, "id")
    return needed.groupBy("at").cogroup(placed.groupBy("task")).applyInPandas(_linked(percent), "a long, b long")


def _cross_links(shared: DataFrame, tied: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components which share a bucket.

    In buckets that hold several components, nodes that look similar across them hang together in
    families. In a family, the nodes outside its largest component are held against all others.
    """
    named = shared.select("bucket", "id").join(tied.select(F.col("hi").alias("id"), F.col("lo").alias("label")), "id", "left")
    named = written(named.withColumn("label", F.coalesce("label", "id")), "named")
    open_ = named.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n")).where("l < m")
    rest = named.join(open_.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket").join(nodes, "id")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "label", "sig")
    rest = rest.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    families = components(written(rest.mapInArrow(_open_families, "a long, b long"), "families"), "families")
    members = families.select(F.col("node").alias("id"), F.col("label").alias("family")).join(named.select("id", "label").distinct(), "id")
    members = written(_fewer(members), "families")
    own = members.join(sets.select("id", F.size("items").alias("items")), "id")
    main = own.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("items").alias("items"))
    main = main.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("items").alias("items"), F.max_by("items", F.struct("n", "label")).alias("still"))
    placed = members.join(main, "family").withColumn("asking", F.col("label") != F.col("main"))
    placed = placed.withColumns({"ps": F.ceil((F.col("items") - F.col("still")) / FAMILY), "qs": F.ceil(F.col("items") / FAMILY), "mark": F.xxhash64("id")})
    x = placed.where("asking").select("family", "id", "label", F.pmod("mark", "ps").alias("p"), F.explode(F.expr("sequence(0L, qs - 1)")).alias("q"), F.lit(True).alias("asks"))
    y = placed.select("family", "id", "label", F.explode(F.expr("sequence(0L, ps - 1)")).alias("p"), F.pmod("mark", "qs").alias("q"), F.lit(False).alias("asks"))
    dealt = x.unionByName(y).select(F.xxhash64("family", "p", "q").alias("task"), "id", "label", "asks").join(sets, "id")
    return dealt.groupBy("task").applyInPandas(_crossed(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return settled(lambda: _near_duplicates(docs, shingle, percent), docs.sparkSession, "near-duplicates")


def _near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    plain = documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"
    signed = written(plain.mapInArrow(_signer(shingle), kinds), "signatures")
    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    member = linkable.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).select("doc_id", "rep")
    member = written(member, "members")
    nodes = linkable.join(member.where("doc_id = rep"), "doc_id", "left_semi")
    nodes = nodes.select(F.col("doc_id").alias("id"), "sig", "bands")
    sigs = nodes.select("id", "sig")
    in_bucket = nodes.select("id", F.explode("bands").alias("bucket"))
    leads = in_bucket.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    shared = written(in_bucket.join(leads, "bucket").select("bucket", "id", "lead"), "buckets")
    wanted = shared.select(F.col("id").alias("doc_id")).distinct()
    sets = written(plain.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_setter(shingle), "id long, items array<long>"), "sets")
    pairs = shared.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("p")), "a")
    pairs = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("q")), "b")
    tested = written(pairs.where(f"{_estimate_sql('p', 'q')} >= {LEAST_ESTIMATE}").select("a", "b").distinct(), "pairs")
    # A doc_id of several rows with different texts joins their classes.
    reps = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    edges = written(confirmed(tested, sets, percent).union(_fewer(reps.where("a < b").select("a", "b"))), "links")
    tied = stars(edges)
    crossed = written(_cross_links(shared, tied, nodes, sets, percent), "crossed")
    tied = stars(tied.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(crossed))
    ids = signed.select("doc_id", "n_shingles").join(reps.select("doc_id", F.col("a").alias("rep")), "doc_id", "left")
    out = ids.join(tied.select(F.col("hi").alias("rep"), F.col("lo").alias("label")), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The documents' columns: one document of each component stays; of rows with one doc_id, one row."""
    verdict = near_duplicates(docs, shingle, percent).select("doc_id", "kept")
    counts = verdict.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    gone = counts.where("NOT kept OR n > 1").select(F.col("doc_id").alias("gone_"))
    twice = counts.where("kept AND n > 1").select(F.col("doc_id").alias("twice_"))
    key = docs["doc_id"].cast("long")
    # The narrow side is hashed: the texts are dealt, but not sorted.
    single = docs.join(gone.hint("shuffle_hash"), key == F.col("gone_"), "left_anti")
    if twice.isEmpty():
        return single
    again = docs.join(twice, key == F.col("twice_"), "left_semi")
    return single.union(again.dropDuplicates(["doc_id"]))


#: The rows of ``near_duplicates(docs, shingle=2)`` in DuckDB, by counting common shingles of all pairs of like size.
ORACLE = r"""
WITH RECURSIVE
cut AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words
                      ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS items FROM cut),
flat AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b
    ON a.item = b.item AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN both_ways ON other = a),
least_of AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(items)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_of ON doc_id = id
"""
