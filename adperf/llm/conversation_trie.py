"""Prefix trie of conversations, from sorted sequences and range minima over what neighbours share.

A node is a distinct sequence of first turns. Sorted distinct conversations have
the members of any node side by side, and the number of turns that neighbours
share says where a node ends: a candidate prefix of depth d reaches right and left
as long as every shared length on the way is d or more. A sparse table has the
minima of all stretches of 2^k neighbours, so each candidate finds both ends by
itself in a number of lookups that grows with the logarithm, without a stack and
independent of the others. Sums over members and over subtrees are differences of
running totals.

The sorted conversations are dealt to tasks by range. Only prefixes of the first
and the last conversation of a task can go on in another one: these open nodes
are joined by key afterwards; all others are finished where they lie.

Defined results: a NULL role or text is an empty one; turns of a conversation are
ordered by turn (NULL first), then role and text. Rows without a conversation id
belong to no conversation. Repeated rows are turns of their own. No conversations
give no nodes, not even a root. Other columns are left out, whatever their names.
A single conversation is held in one task at 24 bytes a turn; turns are told apart
by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adperf.session import materialize

from . import common

#: Bytes of a turn in a sequence: digest of role and text, then the number of bytes of the text.
ITEM = 24
#: Turns in a task of the sorted sequences, on average.
TURNS = 1 << 19

#: Fixed value: digest of no members.
NOBODY = hashlib.sha256(b"").hexdigest()

NODES = (
    "part int, place long, until long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``seq``, the turns in order as items of ``ITEM`` bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    size = F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")
    return (
        turns.select("conv_id", F.row_number().over(order).alias("pos"), F.unhex(F.concat(F.substring(said, 1, 32), size)).alias("item"))
        .groupBy("conv_id")
        .agg(F.expr("listagg(item) WITHIN GROUP (ORDER BY pos)").alias("seq"))
    )


def rebuilt(seqs: DataFrame, base: Column, kept: Column) -> DataFrame:
    """Each conversation after the first ``kept`` turns of conversation ``base`` in place of as many of its own."""
    own = seqs.select("conv_id", base.alias("base"), (ITEM * kept.cast("int")).alias("head"), F.col("seq").alias("own"))
    other = seqs.select(F.col("conv_id").alias("base"), F.col("seq").alias("other"))
    head = F.coalesce(F.expr("substring(other, 1, head)"), F.lit(b""))
    return own.join(other, "base", "left").select("conv_id", F.concat(head, F.expr("substring(own, head + 1)")).alias("seq"))


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by sequence and number: one digest of the comma-joined ids of each sequence, as a stream."""
    last, running = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        digests, ids = batch.column("digest"), batch.column("conv_id").to_numpy()
        runs = digests.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        done, found = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            part = ",".join(map(str, ids[a:b].tolist())).encode()
            if running is not None and runs[a] == last:
                running.update(b"," + part)
                continue
            if running is not None:
                done.append(last)
                found.append(running.hexdigest())
            last, running = runs[a], hashlib.sha256(part)
        yield pa.record_batch({"digest": pa.array(done, pa.binary()), "ends": pa.array(found, pa.string())})
    if running is not None:
        yield pa.record_batch({"digest": pa.array([last], pa.binary()), "ends": pa.array([running.hexdigest()], pa.string())})


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k has the minimum of each 2^k neighbours."""
    table, size = [values], 1
    while 2 * size <= len(values):
        table.append(np.minimum(table[-1][:-size], table[-1][size:]))
        size *= 2
    return table


def right_ends(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last sequence that shares ``depth`` turns with ``at``; value i of the table is what i shares with i - 1."""
    end, n = at.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        level = table[k]
        start = np.minimum(end + 1, len(level) - 1)
        go = (end + (1 << k) < n) & (level[start] >= depth)
        end += go << k
    return end


def left_ends(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First sequence that shares ``depth`` turns with ``at``."""
    end = at.copy()
    for k in range(len(table) - 1, -1, -1):
        start = np.maximum(end - (1 << k) + 1, 0)
        go = (end - (1 << k) >= 0) & (table[k][np.minimum(start, len(table[k]) - 1)] >= depth)
        end -= go << k
    return end


def _range_min(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum from a to b, both included."""
    level = np.int64(np.floor(np.log2(b - a + 1)))
    out = np.empty(len(a), table[0].dtype)
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(table[k][a[here]], table[k][b[here] - (1 << k) + 1])
    return out


def shared_turns(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it; -1 for the first."""
    sizes = np.diff(bounds)
    both = np.minimum(sizes[1:], sizes[:-1])
    owner = np.repeat(np.arange(len(both)), both)
    step = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(both)])[:-1], both)
    differ = codes[bounds[:-2][owner] + step] != codes[bounds[1:-1][owner] + step]
    shared = both.copy()
    np.minimum.at(shared, owner[differ], step[differ])
    return np.concatenate([[-1], shared])


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct sequences of one task: its nodes, those that can go on in another task with a key."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.concat_batches(batches)
    part = TaskContext.get().partitionId()
    seq = rows.column("seq")
    offsets = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
    body = np.frombuffer(seq.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = (offsets - offsets[0]) // ITEM
    items = body.reshape(-1, ITEM)
    codes = np.unique(np.ascontiguousarray(items).view(f"V{ITEM}").ravel(), return_inverse=True)[1] if len(items) else np.zeros(0, int)
    lengths = np.ascontiguousarray(items[:, 16:]).view(">i8").ravel().astype(np.int64)
    members, low = rows.column("n").to_numpy(), rows.column("low").to_numpy()

    sizes = np.diff(bounds)
    shared = shared_turns(codes, bounds)
    table = _minima(shared)
    # candidates: every prefix that the sequence before does not have
    new = sizes - shared
    base = np.concatenate([[0], np.cumsum(new)])[:-1]
    at = np.repeat(np.arange(len(sizes)), new)
    depth = np.arange(len(at)) - base[at] + shared[at] + 1
    right = right_ends(table, at, depth)
    end = base[right] + new[right] - 1
    rest = depth > 0
    above = np.full(len(at), -1)
    up = left_ends(table, at[rest], depth[rest] - 1)
    above[rest] = base[up] + depth[rest] - 1 - shared[up] - 1

    total = np.concatenate([[0], np.cumsum(members)])
    n_convs = total[right + 1] - total[at]
    conv_id = _range_min(_minima(low), at, right)
    size = np.zeros(len(at), np.int64)
    size[rest] = lengths[bounds[at[rest]] + depth[rest] - 1]

    path = np.arange(sizes[-1] + 1)
    last_path = left_ends(table, np.full(len(path), len(sizes) - 1), path)
    open_ids = np.unique(np.concatenate([np.arange(sizes[0] + 1), base[last_path] + path - shared[last_path] - 1]))
    closed = np.ones(len(at), bool)
    closed[open_ids] = False

    children = np.bincount(above[rest & closed], minlength=len(at)) if len(at) else np.zeros(0, int)
    count = lambda values: np.concatenate([[0], np.cumsum(np.where(closed, values, 0))])
    leaves, saved = count(children == 0), count((n_convs - 1) * size)
    here = np.arange(len(at))
    rank = np.searchsorted(open_ids, end, "right") - 1
    keys = np.full(len(at), None, object)
    keys[open_ids] = _prefix_keys(body, bounds, at[open_ids], depth[open_ids])
    ends = rows.column("ends").take(pa.array(np.where(depth == sizes[at], at, 0)))
    whole = pa.compute.if_else(pa.array(depth == sizes[at]), ends, pa.scalar(None, pa.string()))
    parent_open = np.where(rest, ~closed[above], False)
    yield pa.record_batch({
        "part": np.full(len(at), part, np.int32),
        "place": np.where(closed, here, np.searchsorted(open_ids, here)),
        "until": np.where(closed, end, rank),
        "key": pa.array(keys, pa.binary()),
        "parent_key": pa.array(np.where(parent_open, keys[above], None), pa.binary()),
        "conv_id": conv_id,
        "depth": depth,
        "parent_conv_id": pa.array(conv_id[above], mask=~rest | parent_open),
        "n_convs": n_convs,
        "n_children": children.astype(np.int64),
        "n_leaves": leaves[end + 1] - leaves[here],
        "saved_tokens": saved[end + 1] - saved[here],
        "bytes": size,
        "ends": whole,
    })


def _prefix_keys(body: np.ndarray, bounds: np.ndarray, at: np.ndarray, depth: np.ndarray) -> list[bytes]:
    """A digest of each prefix; those of one sequence come by growing depth and are hashed on from one another."""
    found, running, whose, done = [], None, -1, 0
    for i, d in zip(at.tolist(), depth.tolist()):
        if i != whose:
            running, whose, done = hashlib.blake2b(digest_size=16), i, 0
        running.update(body[ITEM * (bounds[i] + done) : ITEM * (bounds[i] + d)].tobytes())
        done = d
        found.append(running.digest())
    return found


def _joined_open(nodes: DataFrame) -> DataFrame:
    """The open nodes of all tasks as whole nodes, by ``key``."""
    parts = nodes.where(F.col("key").isNotNull())
    joined = materialize(
        parts.groupBy("key").agg(
            F.min(F.struct("part", "place")).alias("since"),
            F.max(F.struct("part", F.col("until").alias("place"))).alias("till"),
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"),
            F.max("bytes").alias("bytes"),
            F.max("ends").alias("ends"),
            F.max("parent_key").alias("parent_key"),
            F.sum("n_children").alias("children"),
            F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"),
        )
    )
    below = joined.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open"))
    n_children = F.col("children") + F.coalesce("open", F.lit(0))
    own = joined.join(below, "key", "left").select(
        joined["*"],
        n_children.alias("n_children"),
        F.when(n_children == 0, 1).otherwise(0).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"),
    )
    # running totals over the open places, in the order of the sequences; a node counts where it begins
    places = parts.select(F.struct("part", "place").alias("since")).join(own.select("since", "leaf", "own"), "since", "left")
    places = places.select(
        "since", F.col("since.part").alias("part"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("own", F.lit(0)).alias("own")
    )
    within = Window.partitionBy("part").orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    tasks = places.groupBy("part").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    offsets = tasks.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"past_{c}") for c in ("leaf", "own")))
    running = places.select("part", "since", *(F.sum(c).over(within).alias(c) for c in ("leaf", "own")))
    running = running.join(offsets, "part").select(
        "since", (F.col("leaf") + F.col("past_leaf")).alias("leaf"), (F.col("own") + F.col("past_own")).alias("own")
    )
    first, last = (
        running.select(F.col("since").alias(name), F.col("leaf").alias(f"{name}_leaf"), F.col("own").alias(f"{name}_own"))
        for name in ("since", "till")
    )
    return own.join(first, "since").join(last, "till").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children",
        (F.col("leaves") + F.col("till_leaf") - F.col("since_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("till_own") - F.col("since_own") + F.col("own")).alias("saved_tokens"),
        "ends",
    )


def trie(seqs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``seqs`` (``conv_id``, ``seq``)."""
    spark = seqs.sparkSession
    seqs = materialize(seqs.select("conv_id", "seq", F.unhex(F.substring(F.sha2("seq", 256), 1, 32)).alias("digest")))
    turns = seqs.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()[0] // ITEM
    parts = max(common.shuffle_parts(spark), -(-turns // TURNS))
    common.bound_batches(spark)
    ends = (
        seqs.select("digest", "conv_id").repartition(parts, "digest").sortWithinPartitions("digest", "conv_id")
        .mapInArrow(_member_digests, "digest binary, ends string")
    )
    distinct = seqs.groupBy("digest", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    distinct = materialize(distinct.join(ends, "digest").drop("digest"))
    nodes = materialize(distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(_trie, NODES))
    opened = materialize(_joined_open(nodes))
    parents = common.broadcast_if_small(
        opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up")), F.octet_length("parent_key")
    )
    closed = nodes.where(F.col("key").isNull()).drop("key")
    every = closed.unionByName(opened.drop("key"), allowMissingColumns=True).join(parents, "parent_key", "left")
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )


#: Of the query over ``conversations``; the digest function of 32 bits is written out.
SQL = """
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, count(*) AS own_turns, conv_id - conv_id % 5 AS base,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, step: xor(x >> 1, (x & 1) * 3988292384::BIGINT)
      )
    )) % 9 AS h
  FROM said GROUP BY conv_id
),
heads AS (SELECT c.conv_id, s.pos AS d, s.role, s.text FROM convs c JOIN said s ON s.conv_id = c.base AND s.pos <= c.h),
turns AS (
  SELECT * FROM heads
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.own_turns, 0)) + s.pos - c.h AS d, s.role, s.text
  FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base
),
prefixes AS (
  SELECT conv_id, d, strlen(text) AS bytes,
    string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS p
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
lasts AS (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p, prefixes.d AS d, min(prefixes.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(string_agg(CAST(prefixes.conv_id AS VARCHAR), ',' ORDER BY prefixes.conv_id) FILTER (lasts.d = prefixes.d), '') AS ends
  FROM prefixes JOIN lasts USING (conv_id) GROUP BY p, prefixes.d
),
children AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
subtrees AS (
  SELECT left(p, 32 * k) AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM valued) GROUP BY 1
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN subtrees USING (p) LEFT JOIN nodes up ON v.d > 0 AND up.p = left(v.p, 32 * (v.d - 1))
"""
