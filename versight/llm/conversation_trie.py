"""Prefix trie of conversations, from the Cartesian tree over the common prefixes of neighbours.

1. Conversations become sequences of turn digests; equal ones form one class. Classes are sorted by
   their sequence over ranges of partitions, and each partition is a block: a prefix of turns
   is then an interval of classes.
2. lcp[i] is what classes i - 1 and i share. Each block finds all nearest smaller values of its part with a
   stack. Equal values with none smaller between them are one node: a branching prefix whose
   interval ends at the nearest smaller value on either side, and whose parent has the larger of both.
   The stack carries what the interval sums up to: members, leaves, code points, least id.
3. A block cannot close what reaches beyond it: at most one node for each value that is a minimum of all
   that lies before or behind it. For these, the minima of blocks tell in which block the
   nearest smaller value is, and a join with that block's open nodes which one it is.
4. A node stands for the depths between its parent's and its own, in each of which it has the same members;
   so does each class that is no prefix of another. These missing depths are expanded.

A node's saved tokens are sums over its subtree, which prefix sums over sorted classes give: all
members' code points less each distinct turn's once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from versight.llm.shared import written

#: Bytes of a list of ids in one row, and rows that a task holds before it emits them.
LIST_BYTES, HELD_ROWS = 4096, 2048
_INF = 1 << 62

# Where an interval begins: class i, prefix sums before it (members, their code points, leaves), those of
# distinct code points behind it, its own turns and code points by depth. Where it ends: the sums before class i.
_LEFT = "struct<i: long, members: long, points: long, leaves: long, fresh: long, cum: array<long>>"
_RIGHT = "struct<i: long, members: long, points: long, leaves: long, fresh: long>"
_NODE = f"kind string, block int, gid long, v int, u int, parent long, least long, seps long, size long, n_leaves long, base long, widths array<long>, ends long, near_left {_LEFT}, near_right {_RIGHT}, tail {_LEFT}, head {_RIGHT}, tail_least long, head_least long, above int, before int, left_v int, left_gid long, right_v int, right_gid long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order (null first, then of equal turns the lesser digest), each with digest h and code points w.

    Null roles and texts are empty; rows without a conv_id are in no conversation. What is gathered
    for a conversation is 16 bytes and two numbers a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("h"), F.length(text).cast("long").alias("w"))
    own = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda t: F.struct(t["h"].alias("h"), t["w"].alias("w"))).alias("turns"))


def rebuilt(turns: DataFrame, period: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % period; h is crc32(c) % most."""
    c = F.col("conv_id")
    sources = turns.where(c % period == 0).select(c.alias("source"), F.slice("turns", 1, most - 1).alias("first"))
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    first = F.coalesce(F.slice("first", 1, h), F.slice("turns", 1, 0))
    return turns.withColumn("source", c - c % period).join(sources, "source", "left").select("conv_id", F.concat(first, own).alias("turns"))


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Open:
    """A node on the stack: its value, where it begins, its last position and what lies between them."""

    __slots__ = ("gid", "v", "left", "last", "least", "seps", "head", "head_least", "before")

    def __init__(self, gid, v, left, last, least, head, head_least, before):
        self.gid, self.v, self.left, self.last, self.least, self.seps, self.head, self.head_least, self.before = gid, v, left, last, least, 1, head, head_least, before


def _widths(cum: list[int], u: int, v: int) -> list[int]:
    """Code points of the first d - 1 turns for the depths d from u + 1 to v."""
    return [cum[d - 1] if d > 0 else 0 for d in range(u + 1, v + 1)]


def _closed(node: _Open, right: dict, least: int, u: int, parent: int) -> dict:
    left = node.left
    size = right["members"] - left["members"]
    base = right["points"] - left["points"] - (right["fresh"] - left["fresh"]) - left["cum"][-1]
    return {"kind": "node", "gid": node.gid, "v": node.v, "u": u, "parent": parent, "least": least, "seps": node.seps, "size": size, "n_leaves": right["leaves"] - left["leaves"], "base": base, "widths": _widths(left["cum"], u, node.v), "ends": left["i"] if len(left["cum"]) - 1 == node.v else None}


def _sweep(rows: Iterator[dict], start: int, first_lcp: int, end_lcp: int) -> Iterator[dict]:
    """Nodes, leaves and open nodes of one block; the next block begins with ``end_lcp``."""
    stack: list[_Open] = []
    sums = dict.fromkeys(("members", "points", "leaves", "fresh"), 0)
    seq, i, lowest, least_of_all = None, start, first_lcp, None
    cur, low_left, before = None, None, _INF  # the class since the last position, and where the popped began
    held = None  # the class before position i: (id, sums before it, code points by depth)

    def settle(x: int, at: int, gid: int) -> Iterator[dict]:
        """Position ``at`` with value x: classes before it are complete."""
        nonlocal cur, low_left
        cum, own = held["left"]["cum"], held
        top = stack[-1]
        u, parent = (top.v, top.gid) if top.v >= x else (x, gid)
        if len(cum) - 1 > u:
            sums["leaves"] += 1
            yield {"kind": "leaf", "gid": None, "v": len(cum) - 1, "u": u, "parent": parent, "least": own["id"], "seps": 0, "size": own["size"], "n_leaves": 1, "base": (own["size"] - 1) * cum[-1], "widths": _widths(cum, u, len(cum) - 1), "ends": own["left"]["i"]}
        cur, low_left = own["id"], own["left"]
        right = {"i": at} | sums
        while stack and stack[-1].v > x:
            node = stack.pop()
            cur = min(cur, node.least)
            low_left = node.left
            under = stack[-1] if stack else None
            if node.left is not None:
                u, parent = (under.v, under.gid) if under.v >= x else (x, gid)
                yield _closed(node, right, cur, u, parent)
            else:
                yield {"kind": "open", "gid": node.gid, "v": node.v, "least": cur, "seps": node.seps, "near_right": right, "head": node.head, "head_least": node.head_least, "before": node.before, "right_v": x, "right_gid": gid}

    for row in rows:
        x = first_lcp if seq is None else _common(seq, row["hs"])
        lowest = min(lowest, x)
        if seq is not None:
            yield from settle(x, i, i)
        if stack and stack[-1].v == x:
            stack[-1].least, stack[-1].seps = min(stack[-1].least, cur), stack[-1].seps + 1
            top = stack[-1]
        else:
            # nothing smaller before it in this block: its interval begins in an earlier one
            alone = not stack
            top = _Open(i, x, None if alone else low_left, None, cur if cur is not None else _INF, {"i": i} | sums if alone else None, (cur if cur is not None else _INF) if alone else None, before if alone else None)
            if alone:
                before = x
            stack.append(top)
        cum = [0, *np.cumsum(row["ws"]).tolist()] if row["ws"] else [0]
        seen = dict(sums)
        sums["members"] += row["size"]
        sums["points"] += row["size"] * cum[-1]
        sums["fresh"] += cum[-1] - cum[max(x, 0)]
        held = {"id": row["least"], "size": row["size"], "left": {"i": i} | seen | {"fresh": sums["fresh"], "cum": cum}}
        top.last = held["left"]
        least_of_all = row["least"] if least_of_all is None else min(least_of_all, row["least"])
        seq, i = row["hs"], i + 1
    yield from settle(end_lcp, i, i)
    tail, above = cur, _INF
    for k in range(len(stack) - 1, -1, -1):
        node, under = stack[k], stack[k - 1] if k else None
        since = min(node.least, tail)
        found = {"kind": "open", "gid": node.gid, "v": node.v, "least": since, "seps": node.seps, "near_left": node.left, "tail": node.last, "tail_least": tail, "above": min(above, _HIGH), "head": node.head, "head_least": node.head_least, "before": node.before}
        if node.left is not None:
            found |= {"left_v": under.v, "left_gid": under.gid}
        yield found
        tail, above = since, node.v
    yield {"kind": "block", "v": lowest, "least": least_of_all, "near_right": {"i": i - start} | sums}


_HIGH = (1 << 31) - 1


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _swept(classes: DataFrame, starts: dict[int, tuple[int, int, int]]) -> DataFrame:
    """What ``_sweep`` finds in each block."""
    spark, schema = classes.sparkSession, _schema(_NODE)
    shared = spark.sparkContext.broadcast(starts)

    def flushed(found: list[dict], block: int) -> pa.RecordBatch:
        for x in found:
            x["block"] = block
            for k in ("least", "head_least", "tail_least"):
                if x.get(k) == _INF:
                    x[k] = None
            if x.get("before") is not None:
                x["before"] = min(x["before"], _HIGH)
        return pa.RecordBatch.from_pylist(found, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, batch.num_rows, HELD_ROWS) for row in batch.slice(i, HELD_ROWS).to_pylist())
        row = next(rows, None)
        while row is not None:
            block, ahead = row["block"], [row]

            def own() -> Iterator[dict]:
                while ahead[0] is not None and ahead[0]["block"] == block:
                    now, ahead[0] = ahead[0], next(rows, None)
                    yield now

            found = []
            for x in _sweep(own(), *shared.value[block]):
                found.append(x)
                if len(found) >= HELD_ROWS:
                    yield flushed(found, block)
                    found = []
            yield flushed(found, block)
            row = ahead[0]

    dealt = classes.select("block", "k", "hs", "ws", "size", "least").repartitionById(max(1, len(starts)), F.col("block")).sortWithinPartitions("block", "k")
    return written(dealt.mapInArrow(run, _NODE), "nodes")


def _steps_down(minima: np.ndarray) -> list[np.ndarray]:
    """Minima of the runs of 1, 2, 4 ... blocks that begin at each block."""
    levels = [minima]
    while (1 << len(levels)) <= len(minima):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _run_min(levels: list[np.ndarray], begin: int, end: int) -> int:
    """Least value of blocks begin to end - 1."""
    if begin >= end:
        return _INF
    j = (end - begin).bit_length() - 1
    return int(min(levels[j][begin], levels[j][end - (1 << j)]))


def _next_below(levels: list[np.ndarray], begin: int, v: int) -> int | None:
    """The first block from ``begin`` on whose minimum is below v."""
    at, n = begin, len(levels[0])
    for j in range(len(levels) - 1, -1, -1):
        if at + (1 << j) <= n and levels[j][at] >= v:
            at += 1 << j
    return at if at < n else None


def _last_below(levels: list[np.ndarray], end: int, v: int) -> int | None:
    """The last block before ``end`` whose minimum is below v."""
    at = end
    for j in range(len(levels) - 1, -1, -1):
        if at - (1 << j) >= 0 and levels[j][at - (1 << j)] >= v:
            at -= 1 << j
    return at - 1 if at > 0 else None


def _reaching(nodes: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """Open nodes with the blocks that hold their ends, sums over all blocks and the least id between; the number of blocks; where the last one ends."""
    spark = nodes.sparkSession
    blocks = sorted(nodes.where("kind = 'block'").select("block", "v", "least", "near_right").collect(), key=lambda r: r.block)
    totals = np.array([[r.near_right[k] for k in ("members", "points", "leaves", "fresh")] for r in blocks], np.int64)
    offsets = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(totals, axis=0)])
    low, least = (np.array([r[k] for r in blocks], np.int64) for k in ("v", "least"))
    shared = spark.sparkContext.broadcast((offsets, _steps_down(low), _steps_down(least), len(blocks)))
    ddl = _NODE + ", left_block int, right_block int, between long"
    schema = _schema(ddl)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, low, least, n = shared.value
        for batch in batches:
            found = batch.to_pylist()
            for x in found:
                b = x["block"]
                for side in ("near_left", "near_right", "tail", "head"):
                    if x[side] is not None:
                        for k, more in zip(("members", "points", "leaves", "fresh"), offsets[b].tolist(), strict=True):
                            x[side][k] += more
                x["left_block"] = _last_below(low, b, x["v"]) if x["near_left"] is None and x["v"] >= 0 else None
                right = _next_below(low, b + 1, x["v"]) if x["near_right"] is None and x["v"] >= 0 else None
                x["right_block"] = (n if right is None else right) if x["near_right"] is None and x["v"] >= 0 else None
                far = [] if x["left_block"] is None else [_run_min(least, x["left_block"] + 1, b)]
                far += [] if x["right_block"] is None else [_run_min(least, b + 1, x["right_block"])]
                x["between"] = min([_INF, *far])
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    opened = written(nodes.where("kind = 'open'").mapInArrow(reach, ddl), "open")
    return opened, len(blocks), [sum(r.near_right["i"] for r in blocks), *offsets[-1].tolist()]


def _resolved(opened: DataFrame, n_blocks: int, end: list[int]) -> DataFrame:
    """Open nodes with both ends, by joins with the open nodes of the blocks that hold them; pieces of one node merged."""
    spark = opened.sparkSession
    rights = opened.where("head is not null").select(F.col("block").alias("right_block"), F.col("v").alias("rv"), "before", F.col("head").alias("r"), F.col("head_least").alias("r_least"), F.col("gid").alias("r_gid"))
    behind = spark.createDataFrame([(n_blocks, -1, _HIGH, tuple(end), None, None)], rights.schema)
    lefts = opened.where("tail is not null").select(F.col("block").alias("left_block"), F.col("v").alias("lv"), "above", F.col("tail").alias("l"), F.col("tail_least").alias("l_least"), F.col("gid").alias("l_gid"))
    own = opened.where("v >= 0").drop("above", "before", "head", "tail", "head_least", "tail_least").alias("o")
    left, right = lefts.alias("f"), rights.unionByName(behind).alias("t")
    met = own.join(left, (F.col("o.left_block") == F.col("f.left_block")) & F.expr("f.lv < o.v and o.v <= f.above"), "left")
    met = met.join(right, (F.col("o.right_block") == F.col("t.right_block")) & F.expr("t.rv < o.v and o.v <= t.before"), "left")
    near, far = F.coalesce("near_left", "l"), F.coalesce("near_right", "r")
    lv, rv = F.coalesce("left_v", "lv"), F.coalesce("right_v", "rv")
    met = met.select("gid", "v", "seps", near.alias("a"), far.alias("z"), lv.alias("lv"), rv.alias("rv"), F.coalesce("left_gid", "l_gid").alias("lg"), F.coalesce("right_gid", "r_gid").alias("rg"), F.least("least", "between", "l_least", "r_least").alias("least"))
    u = F.greatest("lv", "rv")
    cum = F.concat(F.array(F.lit(0).cast("long")), F.col("a.cum"))  # at d: code points of the first d - 1 turns
    base = F.expr("z.points - a.points - (z.fresh - a.fresh) - element_at(a.cum, -1)")
    return met.select("gid", "v", u.alias("u"), F.when(F.col("lv") >= F.col("rv"), F.col("lg")).otherwise(F.col("rg")).alias("parent"), "least", "seps", F.expr("z.members - a.members").alias("size"), F.expr("z.leaves - a.leaves").alias("n_leaves"), base.alias("base"), F.slice(cum, u + 2, F.col("v") - u).alias("widths"), F.when(F.size("a.cum") - 1 == F.col("v"), F.col("a.i")).alias("ends"), F.col("a.i").alias("from"), F.col("z.i").alias("to"))


def _end_lists(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256) of (ends, conv_id): ids of a class in order, packed by ranges, hashed as a stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, parts, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for of, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of != now or size > LIST_BYTES:
                    if parts:
                        out.append((now, first, ",".join(parts)))
                    now, first, parts, size = of, c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
                if len(out) >= HELD_ROWS:
                    yield batch_of(out)
                    out = []
        yield batch_of([*out, (now, first, ",".join(parts))] if parts else out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["ends", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = of, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["ends", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["ends", "ends_sha256"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = members.select("ends", "conv_id").repartitionByRange(n, "ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(pack, "ends long, first long, ids string")
    return packed.repartition(n, "ends").sortWithinPartitions("ends", "first").mapInArrow(digest, "ends long, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has conv_id (unique) and turns, an array of (h: a digest of 16 bytes, w: code points);
    an empty array is a conversation without turns, a member of the root. An empty table gives an
    empty result. The root's parent is null.
    """
    spark = sequences.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hs = F.transform("turns", lambda t: t["h"])
    own = written(sequences.select("conv_id", hs.alias("hs"), F.transform("turns", lambda t: t["w"]).alias("ws"), F.unhex(F.md5(F.array_join(F.transform(hs, F.hex), "").cast("binary"))).alias("key")), "sequences")
    classes = own.groupBy("key").agg(F.any_value("hs").alias("hs"), F.any_value("ws").alias("ws"), F.count("*").alias("size"), F.min("conv_id").alias("least"))
    ranged = classes.repartitionByRange(n, "hs").sortWithinPartitions("hs")
    place = F.monotonically_increasing_id()
    classes = written(ranged.select(F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND((1 << 33) - 1).alias("k"), "key", "hs", "ws", "size", "least"), "classes")
    edges = sorted(classes.groupBy("part").agg(F.count("*").alias("n"), F.min_by("hs", "k").alias("first"), F.max_by("hs", "k").alias("last")).collect(), key=lambda r: r["part"])
    if not edges:
        return spark.createDataFrame([], _RESULT)
    starts: dict[int, tuple[int, int, int]] = {}
    at = 0
    lcps = [-1, *(_common(a["last"], b["first"]) for a, b in zip(edges, edges[1:], strict=False)), -1]
    for b, e in enumerate(edges):
        starts[b] = (at, lcps[b], lcps[b + 1])
        at += e["n"]
    numbers = spark.createDataFrame([(e["part"], b, starts[b][0]) for b, e in enumerate(edges)], "part int, block int, start long")
    classes = classes.join(F.broadcast(numbers), "part")  # one row a partition
    nodes = _swept(classes, starts)
    opened, n_blocks, end = _reaching(nodes)
    pieces = written(_resolved(opened, n_blocks, end), "resolved")

    fields = ["v", "u", "parent", "least", "seps", "size", "n_leaves", "base", "widths", "ends"]
    merged = pieces.groupBy("from", "to", "v").agg(F.sum("seps").alias("seps"), *(F.min_by(c, "gid").alias(c) for c in fields if c not in ("v", "seps"))).select(*fields)
    whole = nodes.where("kind in ('node', 'leaf')").select(*fields, (F.col("kind") == "leaf").alias("leaf")).unionByName(merged.withColumn("leaf", F.lit(False)))
    least_of = nodes.where("kind = 'node'").select("gid", "least").unionByName(pieces.select("gid", "least")).toDF("parent", "parent_least")
    known = whole.join(least_of, "parent", "left")
    each = known.select("*", F.posexplode("widths").alias("pos", "before"))
    depth = F.col("u") + 1 + F.col("pos")
    bottom = depth == F.col("v")
    branches = F.when(F.col("leaf"), 0).otherwise(F.col("seps") + 1 - F.when(F.col("ends").isNotNull(), 1).otherwise(0))
    rows = each.select(
        F.col("least").alias("conv_id"),
        depth.cast("long").alias("depth"),
        F.when(depth == 0, F.lit(None)).when(F.col("pos") == 0, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("size").alias("n_convs"),
        F.when(bottom, branches).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("base") - (F.col("size") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(bottom, F.col("ends")).alias("ends"),
    )
    ids = own.select("conv_id", "key").join(classes.select("key", (F.col("start") + F.col("k")).alias("ends")), "key")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    ended = rows.where("ends is not null").join(_end_lists(ids), "ends").drop("ends")
    return ended.unionByName(rows.where("ends is null").drop("ends").withColumn("ends_sha256", none)).select(*(c.split()[0] for c in _RESULT.split(", ")))


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of a table (conv_id, turn, role, text); other columns aren't read."""
    return prefix_trie(rebuilt(ordered_turns(conversations)))
