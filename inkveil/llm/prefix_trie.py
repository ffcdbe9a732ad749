"""Conversation prefix trie: z-fast tries of bounded batches, whose expanded nodes Spark adds up.

A conversation is a string of turns.  A prefix is named by a 128-bit hash that runs along the
conversation, so a compacted trie needs no turns, only these names: a node is kept under the name
at its handle, the depth in its edge that is divisible by the highest power of two, and the exit
node of a conversation is found by a fat binary search over handles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, stored

#: Turns of a conversation that are inserted as one string; longer ones are cut at multiples of it.
SECTION = 512
#: Turns that a trie may take before it is written out and a new one begun.
BATCH = 400_000

Name = tuple[Column, Column]


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Node:
    """The end of an edge: depths (top, depth] of the conversation ``path``."""

    __slots__ = ("top", "depth", "path", "parent", "weights", "least")

    def __init__(self, top: int, depth: int, path: _Path, parent: _Node | None, weights, least: int):
        self.top, self.depth, self.path, self.parent, self.weights, self.least = top, depth, path, parent, weights, least


class _Path:
    """A string of turns at depths base + 1, …: names of its prefixes, 16 bytes each, and bytes of its turns."""

    __slots__ = ("base", "names", "sizes", "length")

    def __init__(self, base: int, names: bytes, sizes: np.ndarray):
        self.base, self.names, self.sizes, self.length = base, names, sizes, len(sizes)

    def name(self, depth: int) -> bytes:
        at = 16 * (depth - self.base)
        return self.names[at:at + 16]


class ZFastTrie:
    """Compacted trie over named prefixes.  All strings between the same multiples of SECTION share a forest."""

    def __init__(self):
        self.handles: dict[bytes, _Node] = {}  # name at the handle's depth -> node
        self.edges: dict[bytes, _Node] = {}    # name of an edge's first turn -> node
        self.nodes: list[_Node] = []
        self.turns = 0

    def _exit(self, path: _Path) -> tuple[_Node | None, int]:
        """The deepest node whose whole path begins the string, and its depth: fat binary search."""
        low, high, parent = path.base, path.base + path.length, None
        while low < high:
            at = two_fattest(low, high)
            node = self.handles.get(path.name(at))
            if node is None:
                high = at - 1
            elif node.depth <= path.base + path.length and node.path.name(node.depth) == path.name(node.depth):
                low, parent = node.depth, node
            else:  # the string leaves inside this node's edge
                return node.parent, node.top
        return parent, low

    def _place(self, node: _Node) -> None:
        self.handles[node.path.name(two_fattest(node.top, node.depth))] = node
        self.edges[node.path.name(node.top + 1)] = node

    def insert(self, path: _Path, weights: np.ndarray, least: int) -> None:
        """Adds a string that ends at its last turn; ``weights`` are summed and ``least`` is the least in each node."""
        end = path.base + path.length
        parent, depth = self._exit(path)
        self.turns += path.length
        if depth == end and parent is not None:
            parent.weights = parent.weights + weights
            parent.least = min(parent.least, least)
            return
        below = self.edges.get(path.name(depth + 1))
        if below is None:
            self._add(_Node(depth, end, path, parent, weights, least))
            return
        split = self._leaves(path, below, depth, min(end, below.depth))
        # only nodes at which a string ends have weights of their own; others get theirs from below
        ends_here = split == end
        middle = _Node(depth, split, path if ends_here else below.path, parent,
                       weights if ends_here else 0 * weights, least if ends_here else below.least)
        del self.handles[below.path.name(two_fattest(below.top, below.depth))]
        below.top, below.parent = split, middle
        self._place(below)
        self._add(middle)
        if not ends_here:
            self._add(_Node(split, end, path, middle, weights, least))

    def _leaves(self, path: _Path, node: _Node, low: int, high: int) -> int:
        """The last depth at which the string agrees with the node's path; names make this a binary search."""
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if path.name(mid) == node.path.name(mid) else (low, mid - 1)
        return low

    def _add(self, node: _Node) -> None:
        self.nodes.append(node)
        self._place(node)

    def expand(self) -> Iterator[_Node]:
        """All nodes, with weights and least members of all strings through them."""
        for node in sorted(self.nodes, key=lambda n: -n.depth):
            yield node
            if node.parent is not None:
                node.parent.weights = node.parent.weights + node.weights
                node.parent.least = min(node.parent.least, node.least)


_NODES = "depth long, a long, b long, above_a long, above_b long, size long, least long"


def _written(trie: ZFastTrie, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per depth of every edge, in batches."""
    columns: list[list[np.ndarray]] = [[] for _ in range(7 + len(names))]
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns],
                                          names=["depth", "a", "b", "above_a", "above_b", "size", "least", *names])

    for node in trie.expand():
        path, n = node.path, node.depth - node.top
        lo = node.top - path.base
        found = np.frombuffer(path.names, np.int64, 2 * (n + 1), 16 * lo).reshape(-1, 2)
        parts = [np.arange(node.top + 1, node.depth + 1), found[1:, 0], found[1:, 1], found[:-1, 0], found[:-1, 1],
                 path.sizes[lo:lo + n], np.full(n, node.least), *(np.full(n, w) for w in node.weights.tolist())]
        for c, p in zip(columns, parts, strict=True):
            c.append(p)
        held += n
        if held >= 20_000:
            yield batch()
            columns, held = [[] for _ in columns], 0
    if held:
        yield batch()


def partial_nodes(strings: DataFrame, weights: list[str]) -> DataFrame:
    """Nodes of every depth with sums over the strings of one batch: see ``nodes``.

    ``strings`` has conv_id, section, and arrays a, b (names of the prefixes, that before the
    section first) and size; rows lie as they come, each task builds tries of at most BATCH turns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "section", "a", "b", "size")]
            added = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in weights], axis=1).astype(np.int64)
            for i, (conv, section, a, b, size) in enumerate(zip(*columns, strict=True)):
                names = np.stack((a.values.to_numpy(), b.values.to_numpy()), axis=1)
                path = _Path(section.as_py() * SECTION, np.ascontiguousarray(names).tobytes(), size.values.to_numpy())
                trie.insert(path, added[i], conv.as_py())
                if trie.turns >= BATCH:
                    yield from _written(trie, weights)
                    trie = ZFastTrie()
        yield from _written(trie, weights)

    return strings.select("conv_id", "section", "a", "b", "size", *weights).mapInArrow(
        run, _NODES + "".join(f", {w} long" for w in weights))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, at, i, x, y, size): turns numbered from 0 in each conversation.

    Order: turn (null first), then role, then text; equal rows in any order.  Null roles and texts
    are empty; rows without a conv_id belong to no conversation.  Turns are dealt by
    ranges of that order, so a conversation of any length is many tasks; a part is one conversation's
    turns in one of them, and (part, at) keeps the order.  x and y are hashes of (role, text).
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    sized = (turns.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
             .withColumn("tie", F.monotonically_increasing_id()))
    dealt = (sized.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
                     F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role").alias("y"),
                     F.octet_length("text").cast("long").alias("size")))
    rows = stored(dealt, "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (rows.join(starts, ["conv_id", "part"])
            .select("conv_id", "part", "at", (F.col("at") - F.col("first") + F.col("start")).alias("i"), "x", "y", "size"))


def _mark(depth: Column) -> Name:
    """What a turn adds to the name of a prefix: hashes of its place and content."""
    return F.xxhash64(depth, "x", "y"), F.xxhash64(F.lit("second"), depth, "y", "x")


def named(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, size) of each prefix of the conversations in ``turns`` (conv_id, part, at, depth, …).

    The name of a prefix is the exclusive or of what its turns add, so a long conversation is summed
    part by part; depths count from 1.
    """
    a, b = _mark(F.col("depth"))
    marked = stored(turns.select("conv_id", "part", "at", "depth", "size", a.alias("ma"), b.alias("mb")), "marked")
    within = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy("conv_id", "part").agg(F.bit_xor("ma").alias("pa"), F.bit_xor("mb").alias("pb"))
    zero = F.lit(0).cast("long")
    starts = parts.select("conv_id", "part", F.coalesce(F.bit_xor("pa").over(earlier), zero).alias("sa"),
                          F.coalesce(F.bit_xor("pb").over(earlier), zero).alias("sb"))
    return (marked.withColumn("a", F.bit_xor("ma").over(within)).withColumn("b", F.bit_xor("mb").over(within))
            .join(starts, ["conv_id", "part"])
            .select("conv_id", "depth", F.col("a").bitwiseXOR(F.col("sa")).alias("a"),
                    F.col("b").bitwiseXOR(F.col("sb")).alias("b"), "size"))


def strings(prefixes: DataFrame) -> DataFrame:
    """(conv_id, section, a, b, size): prefixes cut at multiples of SECTION turns, that before a section first."""
    row = F.struct("depth", "a", "b", "size")
    section = F.floor((F.col("depth") - 1) / SECTION).cast("int")
    own = prefixes.select("conv_id", section.alias("section"), row.alias("row"))
    border = (prefixes.where(F.col("depth") % SECTION == 0)
              .select("conv_id", (section + 1).alias("section"), row.alias("row")))
    rows = (own.unionByName(border).groupBy("conv_id", "section")
            .agg(F.array_sort(F.collect_list("row")).alias("rows")))
    root = F.when(F.col("section") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    sizes = F.when(F.col("section") == 0, F.col("rows.size")).otherwise(F.expr("slice(rows.size, 2, size(rows))"))
    return (rows.select("conv_id", "section", F.concat(root, F.col("rows.a")).alias("a"),
                        F.concat(root, F.col("rows.b")).alias("b"), sizes.alias("size"))
            .where(F.size("size") > 0))


def _summed(cut: DataFrame, weights: list[str]) -> DataFrame:
    """Partial nodes of all tasks added up by name."""
    return (partial_nodes(cut, weights).groupBy("depth", "a", "b", "above_a", "above_b")
            .agg(F.max("size").alias("size"), F.min("least").alias("conv_id"), *(F.sum(w).alias(w) for w in weights)))


def nodes(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of ``prefixes`` with its counts, and the root.

    Columns: a, b (name), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved.  ``conversations`` (conv_id) also has those without a turn, members of the root.

    Sums over subtrees need no walk: each node lies in the hand of its smallest member, and the
    members' nodes are added up along the same trie.  A member's own nodes are the end of its path,
    so a node's sum is that of its members, less what its smallest member has above it.
    """
    cut = stored(strings(prefixes), "strings")
    own = stored(_summed(cut.withColumn("n_convs", F.lit(1)), ["n_convs"]), "nodes")
    above = own.groupBy(F.col("above_a").alias("a"), F.col("above_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = own.join(above, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    weighed = stored(inner.withColumn("saves", (F.col("n_convs") - 1) * F.col("size"))
                     .withColumn("leaf", (F.col("n_children") == 0).cast("long")), "weighed")

    held = weighed.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    owners = held.withColumnRenamed("conv_id", "owner")
    members = cut.join(owners, cut["conv_id"] == owners["owner"], "left").select(
        cut["*"], *(F.coalesce(c, F.lit(0)).alias(c) for c in ("saves", "leaf")))
    below = _summed(members, ["saves", "leaf"]).select("a", "b", F.col("saves").alias("all_saves"), F.col("leaf").alias("all_leaves"))

    # what the smallest member has above a node: running sums in sections, so that no path is one task
    section = F.floor(F.col("depth") / SECTION)
    placed = weighed.withColumn("section", section)
    blocks = placed.groupBy("conv_id", "section").agg(F.sum("saves").alias("s"), F.sum("leaf").alias("l"))
    earlier = Window.partitionBy("conv_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("conv_id", "section", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"),
                           F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l"))
    within = Window.partitionBy("conv_id", "section").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    upper = (placed.withColumn("ws", F.coalesce(F.sum("saves").over(within), F.lit(0)))
             .withColumn("wl", F.coalesce(F.sum("leaf").over(within), F.lit(0)))
             .join(starts, ["conv_id", "section"])
             .withColumn("over_s", F.col("ws") + F.col("s")).withColumn("over_l", F.col("wl") + F.col("l")))
    parents = weighed.select(F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv_id").alias("owner"))
    every = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    least = every.first()["conv_id"]
    deep = (upper.join(below, ["a", "b"]).join(parents, ["above_a", "above_b"], "left")
            .select("a", "b", "conv_id", "depth",
                    F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("owner")).alias("parent_conv_id"),
                    "n_convs", "n_children", (F.col("all_leaves") - F.col("over_l")).alias("n_leaves"),
                    (F.col("all_saves") - F.col("over_s")).alias("saved")))
    sums = weighed.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.sum("leaf").alias("n_leaves"),
                       F.coalesce(F.sum("saves"), F.lit(0)).alias("saved")).first()
    zero = F.lit(0).cast("long")
    root = (every.where(F.col("n_convs") > 0)
            .select(zero.alias("a"), zero.alias("b"), "conv_id", zero.alias("depth"),
                    F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(sums["n_children"]).alias("n_children"),
                    F.lit(sums["n_leaves"] or 1).alias("n_leaves"), F.lit(sums["saved"]).alias("saved")))
    return deep.unionByName(root)


def ends(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): digest of the ids of the conversations that end at a prefix.

    A digest is one stream of all ids in order, so those of one prefix pass through one task; they
    are sorted by Spark and never held together.
    """
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("name"))
    zero = F.lit(0).cast("long")
    at = (conversations.join(last, "conv_id", "left")
          .select("conv_id", F.coalesce("name.a", zero).alias("a"), F.coalesce("name.b", zero).alias("b")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        here, running = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"a": here[0], "b": here[1], "ends_sha256": running.hexdigest()}])

        for batch in batches:
            for conv, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "a", "b")), strict=True):
                if (a, b) != here:
                    if here is not None:
                        yield row()
                    here, running = (a, b), hashlib.sha256(str(conv).encode())
                else:
                    running.update(f",{conv}".encode())
        if here is not None:
            yield row()

    return (at.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
            .mapInArrow(digest, "a long, b long, ends_sha256 string"))


def trie(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix, the root included; see ``nodes`` and ``ends``.

    Ids are not null and distinct in ``conversations``; without any there are no nodes.
    """
    none = F.sha2(F.lit("").cast("binary"), 256)
    return (nodes(prefixes, conversations).join(ends(prefixes, conversations), ["a", "b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")))


def prefixes_of(turns: DataFrame) -> DataFrame:
    """Prefixes of conversations as they are: (conv_id, depth, a, b, size)."""
    return named(numbered(turns).withColumn("depth", F.col("i") + 1))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Prefixes and ids of conversations whose first turns are those of the first one of their group.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c % ``group``,
    all if it has fewer and none if there is none, then its own turns after its first h.
    """
    rows = stored(numbered(turns), "numbered")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = stored(plan.join(heads, "base", "left")
                  .withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))), "rebuilt")
    begun = (plan.withColumnRenamed("conv_id", "c")
             .join(rows.where(F.col("i") < most).withColumnRenamed("conv_id", "base"), "base")
             .where(F.col("i") < F.col("h"))
             .select(F.col("c").alias("conv_id"), F.lit(-1).alias("part"), F.col("i").alias("at"),
                     (F.col("i") + 1).alias("depth"), "x", "y", "size"))
    own = (rows.join(plan.select("conv_id", "h", "k"), "conv_id").where(F.col("i") >= F.col("h"))
           .select("conv_id", "part", "at", (F.col("i") - F.col("h") + F.col("k") + 1).alias("depth"), "x", "y", "size"))
    return stored(named(begun.unionByName(own)), "prefixes"), plan.select("conv_id")


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prepare(spark).read.parquet(f"{folder}/conversations.parquet")
    return trie(*rebuilt(turns))


# crc32 of a decimal number in SQL: eight shifts for each byte
_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
    lambda v, b: list_reduce([xor(v, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, c::VARCHAR AS s, count(*) AS n FROM t GROUP BY c),
c AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM n),
p AS (SELECT c.c, t.i AS pos, r, x FROM c JOIN t ON t.c = c.base AND t.i < c.h
      UNION ALL
      SELECT c.c, t.i - c.h + least(c.h, coalesce(n.n, 0)), r, x
      FROM c JOIN t ON t.c = c.c AND t.i >= c.h LEFT JOIN n ON n.c = c.base),
w AS (SELECT c, list(md5(r) || md5(x) ORDER BY pos) AS w, list(strlen(x) ORDER BY pos) AS z FROM p GROUP BY c),
a AS (SELECT c, coalesce(w, []::VARCHAR[]) AS w, coalesce(z, []::BIGINT[]) AS z FROM c LEFT JOIN w USING (c)),
m AS (SELECT c, w, z, unnest(range(0, len(w) + 1)) AS d FROM a),
u AS (SELECT w[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(min(z[d]), 0) AS z,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(w) = d), '') AS members FROM m GROUP BY ALL),
f AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN f USING (k)),
b AS (SELECT k[1:e] AS k, sum((n_convs - 1) * z) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves,
       b.saved::BIGINT AS saved_tokens, sha256(v.members) AS ends_sha256
FROM v JOIN b ON b.k = v.k LEFT JOIN v AS o ON v.d > 0 AND o.k = v.k[1:v.d - 1]
"""
