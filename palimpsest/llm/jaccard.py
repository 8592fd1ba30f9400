r"""Operator 2: exact Jaccard join of word n-gram sets, in size-banded tiles.

Text is lower-cased (A-Z); words are ``[^\x20\x09-\x0D]+``. A document's set is its
distinct ``size``-word shingles; with fewer words the whole sequence is its one
shingle; without words it is empty and links with nothing. Two documents link if
``den * |A & B| >= num * |A | B|``.

1. Every shingle of every document is counted (chunk by chunk, then per bucket).
2. A set's shingles in order of rarity: linked sets must share one of their first
   ``n - ceil(n * num / den) + 1``. A shingle that occurs once is shared with nobody,
   so most documents have no candidates and leave here. Equal sets travel as one.
3. Sets that share such a shingle, directly or through others, form clusters. A
   cluster is cut into tiles of bounded size: sets of one size band, or of two
   neighbouring bands (a band spans the factor den / num, so linked sets are never
   further apart), and within a band into parts by hash. Each pair of sets meets in
   exactly one tile.
4. In a tile each set has a bitmap of the parities of hashed shingles. The number of
   differing bits is at most that of differing shingles, which bounds the overlap from
   above; pairs that pass are intersected exactly as sorted arrays. A tile returns
   link counts and a spanning forest, never its pairs.
5. Components of the forests give the classes.

Null and empty texts are rows of their own class with 0 links. Null ids never become
a class id (all-null classes have a null id). Repeated rows link with each other unless
empty. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .columns import ASCII_LOWER, SPACE_WORDS, split_words
from .components import connected_components
from .shared import kept
from .superkmer_dedup import word_hashes
from .superkmers import RangeHash, U, gather

#: Shingles aimed at in one side of a tile.
TILE = 500_000


class Sets:
    """Shingle sets of a chunk's documents: flat sorted hashes, row cuts, digests."""

    def __init__(self, chunk: C.Chunk, size: int):
        data = ASCII_LOWER[chunk.data]
        start, end, rows = split_words(data, chunk.offsets, SPACE_WORDS)
        h = RangeHash(word_hashes(data, start, end))
        n = np.diff(rows)
        a = gather(rows[:-1], np.where(n >= size, n - size + 1, np.minimum(n, 1)))
        row_of = np.repeat(np.arange(len(n)), np.where(n >= size, n - size + 1, np.minimum(n, 1)))
        values = C.mix(h.of(a, np.minimum(a + size, rows[row_of + 1])))
        cut = np.searchsorted(row_of, np.arange(len(n) + 1)).tolist()
        parts = [np.unique(values[x:y]) for x, y in zip(cut[:-1], cut[1:])]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.parts = parts
        self.digests = [blake2b(p.tobytes() if len(p) else b"empty" + int(i).to_bytes(8, "little", signed=True), digest_size=16).digest() for p, i in zip(parts, chunk.ids)]
        self.own: dict[bytes, int] = {}  # first row of each non-empty set
        for k, d in enumerate(self.digests):
            if self.sizes[k]:
                self.own.setdefault(d, k)

    def flat(self, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate([self.parts[k] for k in rows]), np.repeat(np.arange(len(rows)), self.sizes[rows])


def counts_of(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits of shingles, which stand for them when they are counted, and in how many distinct sets they are."""
    return np.unique(sets.flat(list(sets.own.values()))[0] >> U(16), return_counts=True)


def emitter(size: int, ranges: int):
    def emit(chunk: C.Chunk) -> C.Mail:
        key, n = counts_of(Sets(chunk, size))
        return C.Mail(C.range_of(key, ranges), [*C.short(key << U(16)), n.astype(np.uint32)])

    return emit


def count(sent: C.Records) -> C.Mail:
    """Counts over all chunks of the shingles that occur more than once, back to the chunks that hold them."""
    hi, lo, n = sent.columns
    df = np.zeros(len(n), np.uint32)
    for rows in C.key_parts(lo):
        key = C.joined_key(hi[rows], lo[rows])
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        total = np.add.reduceat(n[rows[order]].astype(np.int64), np.flatnonzero(new)) if len(rows) else new
        df[rows[order]] = np.minimum(total, 2**32 - 1)[np.cumsum(new) - 1]
    k = np.flatnonzero(df > 1)
    return C.Mail(sent.of[k], [hi[k], lo[k], df[k]])


def prefixes(size: int, num: int, den: int):
    """Rows of a chunk: one per document (token null), and one per rare shared shingle of each distinct set."""

    def act(chunk: C.Chunk, replies: list[bytes]) -> pa.Table:
        sets = Sets(chunk, size)
        rows = list(sets.own.values())
        flat, of = sets.flat(rows)
        df = np.ones(len(flat), np.int64)
        found = C.opened(replies)
        if found and len(flat):
            hi, lo, n = found.columns
            key = C.joined_key(hi, lo)
            order = np.argsort(key)
            key, n = key[order], n[order]
            at = np.minimum(np.searchsorted(key, flat >> U(16)), len(key) - 1)
            df = np.where(key[at] == flat >> U(16), n[at], 1).astype(np.int64)
        sizes = sets.sizes[rows] if rows else np.zeros(0, np.int64)
        prefix = sizes - -(-sizes * num // den) + 1
        alone = np.bincount(of, df == 1, len(rows)).astype(np.int64)
        tokens, owner = [], []
        cut = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(alone < prefix).tolist():
            a, b = cut[k], cut[k] + sizes[k]
            first = np.lexsort((flat[a:b], df[a:b]))[alone[k] : prefix[k]]
            tokens.append(flat[a:b][first]), owner.append(np.full(len(first), k))
        token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        digests = pa.array(sets.digests, pa.binary())
        row = np.array(rows, np.int64)[own] if len(own) else own
        n_docs = len(sets.digests)
        return pa.table(
            [
                pa.concat_arrays([chunk.id_array(), pa.nulls(len(own), pa.int64())]),
                pa.concat_arrays([digests, digests.take(pa.array(row))]),
                pa.array(np.concatenate((sets.sizes, sets.sizes[row]))),
                pa.concat_arrays([pa.nulls(n_docs, pa.int64()), pa.array(token.view(np.int64))]),
            ],
            ["id", "node", "n", "token"],
        )

    return act


def wanted_sets(size: int):
    """The sets of the nodes that were asked for, packed: rows (node, body)."""

    def run(docs, asked):
        chunk = C.Chunk(docs.column("data").to_pylist())
        nodes = asked.column("node").to_pylist()
        if not nodes:
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.binary())], ["node", "body"])
        sets = Sets(chunk, size)
        return C.tidy(pa.table([pa.array(nodes, pa.binary()), pa.array([sets.parts[sets.own[d]].tobytes() for d in nodes], pa.binary())], ["node", "body"]))

    return run


def bitmaps(local: np.ndarray, of: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Parity bitmaps of ``n`` sets, 64 bits a word."""
    key = of * bits + (C.mix(local.astype(np.uint64)) % U(bits)).astype(np.int64)
    key.sort()
    new = np.flatnonzero(np.diff(np.concatenate(([-1], key))))
    odd = key[new][np.diff(np.append(new, len(key))) % 2 == 1]
    flat = np.zeros(n * bits // 8, np.uint8)
    np.bitwise_or.at(flat, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
    return flat.view(np.uint64).reshape(n, bits // 64)


def tile_links(parts: list[np.ndarray], side: np.ndarray, num: int, den: int):
    """Linked pairs of a tile, as arrays of partners for each set in order of size.

    ``side`` is 0 or 1 where only sets of different sides are compared, 2 where all are.
    """
    order = np.argsort([len(p) for p in parts], kind="stable")
    sizes = np.array([len(parts[k]) for k in order], np.int64)
    side = side[order]
    flat = np.concatenate([parts[k] for k in order])
    of = np.repeat(np.arange(len(parts)), sizes)
    _, local = np.unique(flat, return_inverse=True)
    bits = min(4096, max(64, 1 << int(sizes.max() - 1).bit_length()))
    sig = bitmaps(local, of, len(parts), bits)
    cut = np.cumsum(sizes) - sizes
    mark = np.zeros(int(local.max()) + 1, bool)
    for i in range(len(parts) - 1):
        n = sizes[i]
        to = int(np.searchsorted(sizes, n * den // num, "right"))
        j = np.arange(i + 1, to)
        if side[i] != 2:
            j = j[side[i + 1 : to] != side[i]]
        if not len(j):
            continue
        differ = np.bitwise_count(sig[j] ^ sig[i]).sum(1, dtype=np.int64)
        total = n + sizes[j]
        j = j[(total - differ) * (den + num) >= 2 * num * total]
        if not len(j):
            continue
        mine = local[cut[i] : cut[i] + n]
        mark[mine] = True
        both = np.add.reduceat(mark[local[gather(cut[j], sizes[j])]].astype(np.int64), np.cumsum(sizes[j]) - sizes[j])
        mark[mine] = False
        j = j[both * (den + num) >= num * (n + sizes[j])]
        if len(j):
            yield int(order[i]), order[j]


def tiled(num: int, den: int):
    """A tile's links as rows: (node, other, links); ``other`` joins the node to its tree, null for none."""

    def run(table):
        nodes, weight = table.column("node").to_pylist(), table.column("copies").to_numpy().astype(np.int64)
        parts = [np.frombuffer(b, np.uint64) for b in table.column("body").to_pylist()]
        links = np.zeros(len(nodes), np.int64)
        parent = list(range(len(nodes)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for i, js in tile_links(parts, table.column("side").to_numpy(), num, den):
            links[i] += weight[js].sum()
            links[js] += weight[i]
            for j in js.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[b] = a
        k = np.flatnonzero(links)
        return C.tidy(pa.table([pa.array([nodes[x] for x in k], pa.binary()), pa.array([nodes[root(x)] for x in k.tolist()], pa.binary()), pa.array(links[k])], ["node", "other", "links"]))

    return run


def tiles(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (tile, side, node, n, copies) from (node, cluster, n, copies): where each set has to go."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num) * 1.000001 + 1e-9)))
    sets = sets.withColumn("band", band)
    bands = sets.groupBy("cluster", "band").agg(F.sum("n").alias("volume"))
    total = bands.groupBy("cluster").agg(F.sum("volume").alias("cluster_volume"), F.collect_list(F.struct("band", F.ceil(F.col("volume") / TILE).alias("parts"))).alias("bands"))
    # A cluster has one entry a band in ``bands``: some hundred at most, as sizes are 64-bit numbers.
    placed = sets.join(total, "cluster")
    parts_of = lambda b: F.coalesce(F.try_element_at(F.transform(F.filter("bands", lambda x: x["band"] == b), lambda x: x["parts"]), F.lit(1)), F.lit(0).cast("long"))
    part = F.pmod(F.xxhash64("node"), parts_of(F.col("band")))
    b, p = F.col("band"), F.col("part")
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    at = lambda side, b1, p1, b2, p2: F.struct(side.cast("int").alias("side"), b1.alias("b1"), p1.alias("p1"), b2.alias("b2"), p2.alias("p2"))
    same = F.transform(seq(parts_of(b)), lambda q: at(F.when(q == p, 2).when(q < p, 1).otherwise(0), b, F.least(p, q), b, F.greatest(p, q)))
    up = F.transform(seq(parts_of(b + 1)), lambda q: at(F.lit(0), b, p, b + 1, q))
    down = F.transform(seq(parts_of(b - 1)), lambda q: at(F.lit(1), b - 1, q, b, p))
    one = F.array(at(F.lit(2), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    small = F.col("cluster_volume") <= TILE
    out = placed.withColumn("part", part).withColumn("at", F.explode(F.when(small, one).otherwise(F.concat(same, up, down))))
    return out.select(F.struct("cluster", "at.b1", "at.p1", "at.b2", "at.p2").alias("tile"), F.col("at.side").alias("side"), "node", "copies", "chunk")


def classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), n_links (rows linked with this one)."""
    parts, n = C.chunked(docs, id_col, text_col, chunk_bytes)
    ranges = C.ranges_for(n)
    counted = C.solve(C.emit(parts, emitter(size, ranges), n, ranges), count, ranges, n)
    act = prefixes(size, num, den)

    def with_chunk(key, left, right):
        out = act(C.Chunk(left.column("data").to_pylist()), right.column("data").to_pylist())
        return C.tidy(out.append_column("chunk", pa.array([key[0].as_py()] * out.num_rows, pa.int64())))

    # The rows feed several plans below: written once to the shared folder, read from there.
    rows = kept(parts.groupBy("chunk").cogroup(counted.groupBy("at")).applyInArrow(with_chunk, "id long, node binary, n long, token long, chunk long"))
    everyone = rows.filter("token is null").select("id", "node", "n")
    copies = everyone.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    entries = rows.filter("token is not null").select("token", "node", "n", "chunk")
    lead = entries.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("most")).filter("lead < most").select("token", "lead")
    cluster = connected_components(entries.join(lead, "token").filter("node <> lead").select("lead", "node"), "lead", "node")
    sets = kept(entries.groupBy("node").agg(F.min("chunk").alias("chunk"), F.max("n").alias("n")).join(cluster.withColumnRenamed("root", "cluster"), "node").join(copies.select("node", "copies"), "node"))
    bodies = parts.groupBy("chunk").cogroup(sets.select("chunk", "node").groupBy("chunk")).applyInArrow(wanted_sets(size), "node binary, body binary")
    placed = tiles(sets, num, den).drop("chunk").join(bodies, "node")
    linked = kept(placed.groupBy("tile").applyInArrow(tiled(num, den), "node binary, other binary, links long"))
    root = connected_components(linked.filter("node <> other"), "node", "other")
    first = root.join(copies, "node").groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_node = copies.join(root.join(first, "root").select("node", "class_id"), "node", "left").join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    of_node = of_node.select("node", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return everyone.join(of_node, "node").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class_id")).alias("component_id"), F.when(F.col("n") == 0, 0).otherwise(F.col("links")).cast("long").alias("n_links"))


def first_of_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their class.

    Of rows with one id and text, one stays (any of them); rows with one id and different texts
    are one document and stay together or go together. Rows with a null id stay, as they
    cannot be told apart. Columns may have any names.
    """
    found = classes(docs, size, num, den, id_col, text_col)
    later = found.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))
    again = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("times")).filter("times > 1").select("again")
    if not again.isEmpty():  # else the texts need no further exchange
        same = F.col("row_id") == F.col("again")
        rows = rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").dropDuplicates(["row_id", "row_text"]))
    return rows.join(later, F.col("row_id") == F.col("key"), "left_anti").select("row.*")
