"""SimHash near-duplicates: fingerprints, an exact Hamming join by binary tries, groups.

Fingerprints within 3 bits agree on at least one of four 16-bit quarters. Each
distinct fingerprint goes to its four (quarter, value) cells; a cell's fingerprints,
turned so that the shared quarter comes first, form a binary trie, which is joined
with itself: pairs of nodes go down together, differing bits add up, and a pair is
left as soon as they exceed the budget. The other 48 bits of a cell with many
fingerprints are dealt to four blocks, the most even bits first; within 3 bits one
block is equal, so the cell splits into smaller tries at four copies a fingerprint.

A cell reports a forest of links, not all pairs; groups are then joined across
cells by rounds of smallest-neighbour hooking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, map_text, texts, words, written

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Cells with more fingerprints are split, each block by so many bits and one for each doubling.
CELL, SPLIT_BITS = 2000, 2
#: Blocks that the other bits of a large cell are dealt to, and the bits of one.
BLOCKS, BLOCK_BITS = 4, 12
#: Rows that a task of the join reads (about).
TASK_ROWS = 1 << 20
#: A fingerprint of more than this share of the rows is joined apart; there are fewer
#: such fingerprints than its inverse.
HOT = 1000
#: Bytes of text whose shingles are hashed at once.
SLICE = 4 << 20
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAVES = 64

_SPREAD = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them.

    Eight bits are counted at once in the bytes of a 64-bit word, over runs of at
    most 255 hashes.
    """
    counts = np.diff(offsets)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(pieces) - pieces
    starts = offsets[full][owner] + 255 * (np.arange(len(owner)) - first[owner])
    for lane in range(8):
        spread = (hashes >> np.uint64(lane)) & _SPREAD
        sums = np.add.reduceat(spread, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(sums, first, axis=0)
        over = (2 * total > counts[full][:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= over[:, byte] << np.uint64(8 * byte + lane)
    return out


def fingerprints(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text.

    A-Z becomes a-z; words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``size`` words,
    repeats included, joined by a space; fewer words are one shingle; no word gives 0.
    """
    import pyarrow.compute as pc

    found = words(pc.ascii_lower(texts(column)))
    counts = found.counts
    # All words in one buffer, each after a space: a shingle is a slice of it.
    spaced = pc.binary_join_element_wise(pa.scalar(" "), found.dictionary, "")
    taken = spaced.take(pa.array(found.codes)) if len(found.codes) else spaced
    data = taken.buffers()[2].to_pybytes() if len(found.codes) else b""
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1].astype(np.int64) if len(found.codes) else np.zeros(1, np.int64)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), shingles)
    first = np.cumsum(shingles) - shingles
    begin = found.offsets[:-1][rows] + np.arange(len(rows)) - first[rows]
    stop = np.minimum(begin + size, found.offsets[1:][rows])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip((ends[begin] + 1).tolist(), ends[stop].tolist(), strict=True)), np.uint64, len(rows)
    )
    return majority(hashes, np.concatenate([[0], np.cumsum(shingles)]))


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fingerprint) of every row, the fingerprint as a signed 64-bit number.

    With ``hashed`` also the text's hash and length, as Spark has them.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints(batch.column("text")).view(np.int64)
        arrays = [batch.column("doc_id"), pa.array(found)]
        arrays += [batch.column(name) for name in ("hash", "size") if hashed]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "fingerprint", "hash", "size"][: len(arrays)])

    docs = columns(df, doc_id=id_col, text=text_col)
    if hashed:
        docs = docs.select("*", F.xxhash64("text").alias("hash"), F.length("text").alias("size"))
    return map_text(docs, step, "doc_id long, fingerprint long" + (", hash long, size int" if hashed else ""), most=SLICE)


class Forest:
    """Groups of numbered items."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a_root, b_root = self.root(a), self.root(b)
        if a_root != b_root:
            self.parent[max(a_root, b_root)] = min(a_root, b_root)
            self.links.append((a, b))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Trie:
    """Binary trie over sorted distinct keys, implicit: a node is a range and a bit.

    A node's keys agree above its bit; one-child chains are skipped.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def bit(self, low: int, high: int) -> int:
        """The highest bit in which the keys of a range differ; -1 for one key."""
        return int(self.keys[low] ^ self.keys[high - 1]).bit_length() - 1

    def cut(self, low: int, high: int, bit: int) -> int:
        """Where the keys with that bit set begin."""
        top = (int(self.keys[low]) >> bit | 1) << bit
        return low + int(np.searchsorted(self.keys[low:high], np.uint64(top)))


def trie_join(left: np.ndarray, right: np.ndarray | None, forest: Forest, budget: int = BUDGET) -> None:
    """Links items of sorted keys within ``budget`` bits.

    ``right`` None joins ``left`` with itself. Items of ``right`` are numbered after
    those of ``left``. A pair of nodes is left when the bits in which their common
    prefixes differ exceed the budget, or when all of their items are one group
    already.
    """
    a, b = Trie(left), Trie(left if right is None else right)
    shift = 0 if right is None else len(left)
    if not len(a.keys) or not len(b.keys):
        return
    stack = [((0, len(a.keys)), (0, len(b.keys)))]

    def one_group(x: tuple[int, int], y: tuple[int, int]) -> bool:
        if x[1] - x[0] + y[1] - y[0] > 256:
            return False
        first = forest.root(x[0])
        return all(forest.root(i) == first for i in range(x[0], x[1])) and all(forest.root(i + shift) == first for i in range(y[0], y[1]))

    while stack:
        x, y = stack.pop()
        same = right is None and x == y
        if same and x[1] - x[0] == 1:
            continue
        bit_x, bit_y = a.bit(*x), b.bit(*y)
        top = max(bit_x, bit_y)
        if not same:
            # Bits above the higher branching bit are settled on both sides.
            settled = int(a.keys[x[0]]) >> (top + 1) ^ int(b.keys[y[0]]) >> (top + 1)
            if settled.bit_count() > budget:
                continue
        n, m = x[1] - x[0], y[1] - y[0]
        if n * m <= LEAVES or top < 0:
            differ = _bits(a.keys[x[0] : x[1], None] ^ b.keys[None, y[0] : y[1]]) <= budget
            for i, j in zip(*(v.tolist() for v in np.nonzero(differ)), strict=True):
                if not same or i < j:
                    forest.link(x[0] + i, y[0] + j + shift)
            continue
        if n + m > 16 and one_group(x, y):
            continue
        if bit_x == top:
            at = a.cut(*x, top)
            parts_x = [(x[0], at), (at, x[1])]
        else:
            parts_x = [x]
        if bit_y == top:
            at = b.cut(*y, top)
            parts_y = [(y[0], at), (at, y[1])]
        else:
            parts_y = [y]
        if same:
            stack += [(parts_x[0], parts_x[1]), (parts_x[0], parts_x[0]), (parts_x[1], parts_x[1])]
        else:
            stack += [(p, q) for p in parts_x for q in parts_y]


def near_links(prints: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b): links that join all fingerprints within BUDGET bits, column ``fingerprint``.

    Each pair of distinct fingerprints within the budget is linked directly or by a
    chain of links. Links of a cell of more than LEAVES pairs are a forest, fewer
    than its fingerprints. ``rows`` is the number of fingerprints, counted if not given.
    """
    spark = prints.sparkSession
    rows = prints.count() if rows is None else rows
    quarter = [F.struct(F.lit(q).alias("q"), F.shiftrightunsigned("fingerprint", 48 - 16 * q).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("v")) for q in range(4)]
    cells = prints.select("fingerprint", F.explode(F.array(*quarter)).alias("cell")).select("fingerprint", "cell.q", "cell.v")
    # The key begins with the cell's own quarter, so a cell is a sub-trie.
    turned = "shiftleft(fingerprint, 16 * q) | shiftrightunsigned(fingerprint, 64 - 16 * q)"
    cells = cells.withColumn("key", F.expr(f"if(q = 0, fingerprint, {turned})"))
    # There are at most 4 * 2^16 cells, so what is known of large ones may be broadcast.
    ones = F.array(*(F.sum(F.shiftrightunsigned("key", p).bitwiseAND(F.lit(1))) for p in range(48)))
    large = cells.groupBy("q", "v").agg(F.count("*").alias("count"), ones.alias("ones")).where(F.col("count") > CELL)
    even = "transform(array_sort(transform(ones, (x, i) -> struct(abs(2 * x - count) as off, i as at))), x -> cast(x.at as tinyint))"
    deep = F.expr(f"least({BLOCK_BITS}, cast(ceil(log2(count / {CELL})) as int) + {SPLIT_BITS})")
    large = large.select("q", "v", F.expr(even).alias("at"), deep.alias("deep"))
    large = large.select("q", "v", F.expr(f"slice(at, 1, {BLOCKS} * deep)").alias("at"))
    joined = cells.join(F.broadcast(large), ["q", "v"], "left")
    # Block b of a large cell has the bits at[b], at[b + BLOCKS], ...; a cell that isn't large has one block, 0.
    part = f"aggregate(filter(at, (p, i) -> i % {BLOCKS} = b), 0L, (x, p) -> x * 2 + (shiftrightunsigned(key, cast(p as int)) & 1L))"
    parts_of = f"if(at is null, array(0L), transform(sequence(0, {BLOCKS - 1}), b -> (b + 1) * {1 << BLOCK_BITS}L + {part}))"
    own = f"(q * 65536L + v) * {(BLOCKS + 1) << BLOCK_BITS}L"
    work = joined.select("key", F.expr(own).alias("own"), F.explode(F.expr(parts_of)).alias("part")).select((F.col("own") + F.col("part")).alias("cell"), "key")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * rows // TASK_ROWS))
    return work.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_linked, "a long, b long")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the cells of a task, whose rows (cell, key) come cell by cell."""
    held: list[np.ndarray] = []
    of = -1

    def made(cells: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        ends = cell_links(cells, keys)
        turn = (16 * (ends[0] // (65536 * ((BLOCKS + 1) << BLOCK_BITS)))).astype(np.uint64)
        back = [np.where(turn == 0, e, e >> turn | e << (np.uint64(64) - np.maximum(turn, np.uint64(1)))).view(np.int64) for e in ends[1:]]
        return pa.RecordBatch.from_arrays([pa.array(e) for e in back], ["a", "b"])

    for batch in batches:
        cells, keys = batch.column("cell").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
        if not len(cells):
            continue
        first = int(np.searchsorted(cells, of, side="right")) if cells[0] == of else 0
        held.append(keys[:first])
        if first == len(cells):
            continue
        last = int(np.searchsorted(cells, cells[-1]))
        whole = np.concatenate([*held, keys[first:last]])
        if len(whole):
            before = len(whole) - (last - first)
            yield made(np.concatenate([np.full(before, of), cells[first:last]]), whole)
        of, held = int(cells[-1]), [keys[last:]]
    whole = np.concatenate([np.zeros(0, np.uint64), *held])
    if len(whole) > 1:
        yield made(np.full(len(whole), of), whole)


def cell_links(cells: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, a, b): links within each run of equal cells, whose keys are distinct.

    Runs that are one leaf of the join are compared all at once, others by their trie.
    """
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cells)])
    leaf = sizes * sizes <= LEAVES
    within = np.repeat(leaf, sizes)
    found_a, found_b = [], []
    for step in range(1, int(sizes[leaf].max(initial=1))):
        at = np.flatnonzero(within[:-step] & (cells[step:] == cells[:-step]))
        at = at[_bits(keys[at] ^ keys[at + step]) <= BUDGET]
        found_a.append(at)
        found_b.append(at + step)
    for start, size in zip(starts[~leaf].tolist(), sizes[~leaf].tolist(), strict=True):
        order = start + np.argsort(keys[start : start + size])
        grown = Forest(size)
        trie_join(keys[order], None, grown)
        if grown.links:
            ends = order[np.array(grown.links)]
            found_a.append(ends[:, 0])
            found_b.append(ends[:, 1])
    a, b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (found_a, found_b))
    return cells[a], keys[a], keys[b]


def groups(links: DataFrame) -> DataFrame:
    """(node, group) of every node of the links (a, b): group is its component's least node.

    Nodes are of any type with an order. Rounds of hooking to the least neighbour, by
    turns at the larger and the smaller nodes, until the edges form stars. Each round
    is a pair of shuffled aggregations over the edges that are left; each is written to
    the shared folder, and removed once the next is there. No round gathers a node's
    neighbours: they are aggregated, and joined with one row a node, which adaptive
    execution splits where a node has very many.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        # At every node: hook its larger neighbours to its least neighbour or itself.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # At every node: hook its smaller neighbours and itself to the least of them.
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    return pairs.union(edges.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())


#: Stands for a missing id; a fingerprint's node is its least id and itself, so that
#: nodes of different fingerprints differ and a component's least node has its least id.
_NO_ID = (1 << 63) - 1


def print_groups(prints: DataFrame) -> tuple[DataFrame, int]:
    """((fingerprint, n, least, head), rows): of every fingerprint its rows and its component.

    ``least`` is the least id reachable, null if there is none; ``head`` the
    fingerprint that stands for the component. Written to the shared folder.
    """
    ids = F.struct(F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("least"), F.col("fingerprint").alias("of"))
    each = written(prints.groupBy("fingerprint").agg(ids.alias("node"), F.count("*").alias("n")), "distinct")
    size = each.agg(F.count("*").alias("prints"), F.sum("n").alias("rows")).head()
    links = near_links(each, size["prints"])
    for end in ("a", "b"):
        links = links.join(each.select(F.col("fingerprint").alias(end), F.col("node").alias(f"{end}_node")), end)
    found = groups(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    of = each.join(found.select("node", F.col("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = F.when(F.col("group.least") != _NO_ID, F.col("group.least"))
    out = written(of.select("fingerprint", "n", least.alias("least"), F.col("group.of").alias("head")), "components")
    discard(each)
    return out, size["rows"] or 0


def with_group(prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` with ``least`` and ``head`` of their fingerprint's component.

    Fingerprints of more than a thousandth of the rows, which are fewer than a
    thousand, are broadcast; rows of the others meet their component in a shuffle.
    """
    of, rows = print_groups(prints)
    hot = F.broadcast(of.where(F.col("n") * HOT > rows).drop("n"))
    cold = prints.join(F.broadcast(of.where(F.col("n") * HOT > rows).select("fingerprint")), "fingerprint", "left_anti")
    return prints.join(hot, "fingerprint").unionByName(cold.join(of.where(F.col("n") * HOT <= rows).drop("n"), "fingerprint"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``fingerprint`` as 16 hexadecimal digits; ``component_id`` is the least doc_id
    reachable over fingerprints that differ in at most 3 bits. Null and empty texts
    have fingerprint 0, linked like any other; a row without an id links like any
    other, and has no component where no row of its component has an id; repeated
    rows are kept, and texts that share an id are linked by their fingerprints alone;
    other columns take no part; an empty table gives no row.
    """
    prints = written(with_fingerprint(df, id_col, text_col), "prints")
    out = with_group(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all its columns.

    The row with the least id stays, of texts that share it the one with the least
    hash, of rows that repeat both any one; rows without an id come last, and one
    stays where a group has no other. Null and empty texts are one group; other
    columns go along, whatever their names; an empty table gives an empty one.

    Rows are chosen by id, text hash and length; the texts themselves cross one
    shuffle, of a semi-join with what was chosen.
    """
    text = F.col(f"`{text_col}`").cast("string")
    key = {"_id": F.col(f"`{id_col}`").cast("long"), "_hash": F.xxhash64(text), "_size": F.length(text)}
    prints = written(with_fingerprint(docs, id_col, text_col, hashed=True), "prints")
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("size").alias("_size"))
    # Rows alike are one before they meet in their group; no task gets a group's rows.
    alike = with_group(prints).groupBy("head", named.alias("row")).agg(F.count("*").alias("rows"))
    chosen = alike.groupBy("head").agg(F.min(F.struct("row", "rows")).alias("c"))
    chosen = written(chosen.select("c.row._id", "c.row._hash", "c.row._size", (F.col("c.rows") > 1).alias("again")), "chosen")
    discard(prints)
    taken = [f"_kantele{name}" for name in key]
    rows = docs.select("*", *(of.alias(f"_kantele{name}") for name, of in key.items()))

    def of(some: DataFrame) -> DataFrame:
        some = some.select(*(F.col(name).alias(f"c{name}") for name in key))
        same = [rows[f"_kantele{name}"].eqNullSafe(some[f"c{name}"]) for name in key]
        return rows.join(some, same, "left_semi")

    out = of(chosen.where("not again"))
    if not chosen.where("again").isEmpty():
        out = out.unionByName(of(chosen.where("again")).dropDuplicates(taken))
    return out.drop(*taken)
