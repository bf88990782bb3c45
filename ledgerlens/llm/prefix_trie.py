"""Prefix trie of conversations: chained digests name every prefix, groups of equal ones are nodes, sums run over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stash, ship, stash

#: Ids that are joined into one piece before pieces of a group are put in order.
PIECE = 20_000


def turn_key(role, text):
    """SHA-256 of one turn, role and text told apart by the role's length."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def chained(batches: Iterator[pa.RecordBatch], borrowed: int) -> Iterator[pa.RecordBatch]:
    """Rows (base, conv_id, h, said, chars), in order of base, base's own conversation first, conversation and turn, to the
    prefixes of every rebuilt conversation: (conv_id, depth, up, node, chars, ended).

    One conversation's last digest and the base's first `borrowed` turns are all that is held.
    """
    cols: tuple[list, ...] = ([], [], [], [], [], [])
    base = conv = None
    first: list[tuple[bytes, int]] = []  # the base's own turns
    node, depth, seen, open_ = b"", 0, 0, False

    def put(c, d, up, this, n):
        for col, v in zip(cols, (c, d, up, this, n, False)):
            col.append(v)

    def taken():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], ["conv_id", "depth", "up", "node", "chars", "ended"])
        for c in cols:
            c.clear()
        return out

    def grow(said, n):
        nonlocal node, depth
        up, node, depth = node, hashlib.sha256(node + said).digest(), depth + 1
        put(conv, depth, up, node, n)

    for batch in batches:
        for b, c, h, said, n in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                if open_:
                    cols[5][-1] = True  # the last prefix of the conversation before
                if b != base:
                    base, first = b, []
                if len(cols[0]) > 20_000:
                    yield taken()
                conv, node, depth, seen, open_ = c, b"", 0, 0, True
                put(c, 0, None, b"", 0)
                for x in first[:h] if c != b else ():
                    grow(*x)
            if c == b and len(first) < borrowed:
                first.append((said, n))
            if c == b or seen >= h:
                grow(said, n)
            seen += 1
            if len(cols[0]) > 50_000:  # a long conversation: all but the row that may be its last
                last = [col.pop() for col in cols]
                yield taken()
                for col, v in zip(cols, last):
                    col.append(v)
    if open_:
        cols[5][-1] = True
    yield taken()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, conv_id) in order to (node, first id, ids joined by commas), at most PIECE ids each."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "least", "ids"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != node or len(ids) >= PIECE):
                yield piece()
                ids = []
            node = k
            ids.append(c)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least, ids) in order to (node, digest of the ids of all pieces)."""
    node, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == node:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def prefixes(turns: DataFrame, base=None, borrowed=None, most: int = 0) -> DataFrame:
    """Every prefix of every conversation: (conv_id, depth, up, node, chars, ended), depth 0 being the empty one.

    turns: conv_id (long), turn, role, text. node is the SHA-256 of the parent's node and the turn, so equal prefixes have
    equal nodes; chars are the code points of the last turn's text. Texts are hashed where they are read and don't travel.
    base and borrowed, columns of conv_id, let a conversation begin with the first `borrowed` (at most `most`) turns of the
    conversation `base` in place of as many of its own.
    """
    base = F.col("conv_id") if base is None else base
    borrowed = F.lit(0) if borrowed is None else borrowed
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(base.cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"), borrowed.cast("int").alias("h"), F.col("turn"), turn_key(role, text).alias("said"), F.length(text).cast("long").alias("chars"))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "said")
    return rows.select("base", "conv_id", "h", "said", "chars").mapInArrow(lambda b: chained(b, most), "conv_id long, depth long, up binary, node binary, chars long, ended boolean")


def prefix_trie(prefix: DataFrame) -> DataFrame:
    """The trie of prefixes(): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows group by (depth, node), combined map-side. A conversation that is the least member of a node is that of every
    deeper node on its way, so nodes fall into chains, one conversation's each: within a chain sums run from its deep end,
    and each chain's total is exploded to all ancestors above the chain. A chain of any length thus costs one row per
    ancestor, not one per pair of its nodes. The ids that end at a node are joined in pieces of a range of (node, id) and
    hashed piece by piece in order, so copies in any number pass through a task as a stream.

    Defined results: rows without conv_id are left out before; turns that tie in order come in order of their digests;
    equal rows are turns of their own; an empty table has no node, not even the root.
    """
    spark = prefix.sparkSession
    ship(spark)
    prefix, old = stash(prefix, "prefixes")
    nodes = prefix.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("ended").cast("long")).alias("n_ends"),
        F.max("chars").alias("chars"), F.min("up").alias("up"),
    )
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("own_leaf")
    nodes, nodes_at = stash(nodes.select("depth", "node", "conv_id", "n_convs", "n_ends", "up", *own), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("own_saved").alias("saved"), F.sum("own_leaf").alias("leaves"))
    above = prefix.join(chains, "conv_id").where(F.col("depth") < F.col("top"))
    child = nodes.where(F.col("depth") > 0).select((F.col("depth") - 1).alias("depth"), F.col("up").alias("node"), F.lit(1).cast("long").alias("child"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    told = child.unionByName(above.select("depth", "node", F.lit(0).cast("long").alias("child"), "saved", "leaves"))
    told = told.groupBy("depth", "node").agg(*[F.sum(c).alias(c) for c in ("child", "saved", "leaves")])
    # what ends at a node: pieces of a range, then each node's pieces in order
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = prefix.where("ended").select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    ends = ends.mapInArrow(_pieces, "node binary, least long, ids string").repartition("node").sortWithinPartitions("node", "least")
    ends = ends.mapInArrow(_hashed, "node binary, ends_sha256 string")
    # within a chain, from its deep end
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("conv_id").orderBy("depth")
    whole = nodes.join(told, ["depth", "node"], "left").join(ends, "node", "left")
    whole = whole.select(
        "depth", "conv_id", "up", "n_convs", F.coalesce("child", F.lit(0)).alias("n_children"), "ends_sha256", (F.row_number().over(first) == 1).alias("is_top"),
        (F.sum("own_leaf").over(down) + F.coalesce("leaves", F.lit(0))).alias("n_leaves"), (F.sum("own_saved").over(down) + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
    )
    # a chain's first node hangs on another conversation's; the root's is one row, and most chains hang there
    root = nodes.where(F.col("depth") == 0).select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("root_conv"))
    tops = nodes.join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"], "left_semi").where(F.col("depth") > 1)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"), F.col("conv_id").alias("parent"))
    tops = tops.join(parents, ["depth", "up"]).select("conv_id", "depth", "parent")
    whole = whole.join(F.broadcast(root), "depth", "left").join(tops, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.when(~F.col("is_top"), F.col("conv_id")).otherwise(F.coalesce("parent", "root_conv")))
    none = hashlib.sha256(b"").hexdigest()
    out, _ = stash(whole.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "trie")
    for path in (old, nodes_at):
        drop_stash(spark, path)
    return out


def op11_prefix_trie(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    c = F.col("conv_id")
    return prefix_trie(prefixes(turns, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5))


OP11_SQL = r"""
WITH RECURSIVE own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, s, k, v) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM own
  UNION ALL
  SELECT conv_id, s, k + 1, xor(b >> 1, 3988292384 * (b & 1)) FROM (
    SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE v END AS b FROM crc WHERE k < 8 * length(s))
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = 8 * length(s)
), rebuilt AS (
  SELECT c.conv_id, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL SELECT c.conv_id, o.k + c.h, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, length(text) AS chars,
         sha256(length(role) || ':' || role || text) AS said FROM rebuilt
), prefix AS (
  SELECT conv_id, depth, chars, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), marked AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM prefix
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM marked GROUP BY ALL
), linked AS (
  SELECT n.*, p.node AS up, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN prefix p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN nodes q ON q.depth = p.depth AND q.node = p.node
), children AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT a.depth, a.node, sum(CASE WHEN c.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN prefix a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node GROUP BY ALL
)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN children c USING (depth, node) JOIN sums s USING (depth, node)
"""
