"""Operator 11: the prefix trie of conversations, by an external mergesort that knows common prefixes.

Every conversation is rebuilt from the first turns of its hundred's first conversation and its own later turns; a node of the
trie is a distinct sequence of first turns. A turn is a token of 16 bytes, of the SHA-256 of its role and text, so a
conversation is a byte string whose order is that of its turns, and no text is shuffled. Equal conversations are one class
with a count, its smallest member and the digest of its members' ids (streamed in order, never held).

1. Runs. Tasks sort classes and front-code them: the number of turns shared with the class before, then the other turns. A
   bounded sample of classes gives splitters, and a run leaves its task as compressed blocks for each range between splitters.
2. Merge. A range's blocks are held compressed, and of each run one is open. A loser tree combines the runs: of two classes
   that share different numbers of turns with the last winner the one that shares more comes first, unread; turns known to be
   shared are never compared again.
3. Nodes. The merged stream keeps the open path as a stack. A class closes the nodes below what it shares with the one
   before it; a closed node is finished: it adds its members, leaves and savings to its parent and goes out with its
   parent's smallest member once that parent is closed.
4. Edges of ranges. Only first turns of splitters can be in several ranges. Those nodes leave each range as partial sums, at most
   ``SPLITTER`` for each splitter whatever the input; they are added up, and their own tree is solved by the same rules.

Memory: a range's compressed blocks, one open block for each run, the open path, and finished children of open nodes.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then by token, and repeated rows are
repeated turns; rows without a conversation id take no part; without conversations there is no node, not even the root;
turns of any length and conversations of any number of turns are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, groups, only, shuffles, table

#: Bytes of a token; turns that a splitter keeps; splitters sampled for each range; turns of a run and of a block.
TOKEN, SPLITTER, SAMPLED, RUN_TURNS, BLOCK_TURNS = 16, 256, 16, 1 << 20, 1 << 14
#: First turns that a conversation takes from its hundred's first one: fewer than this.
HEADS = 6
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (tokens in hexadecimal, joined), lens (code points of each text) of (conv_id, turn, role, text)."""
    at = only(turns, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null")
    at = at.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    token = F.substring(F.unhex(F.sha2(said, 256)), 1, TOKEN)
    own = at.select("conv_id", F.struct("turn", token.alias("token"), F.length("text").cast("long").alias("len")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda t: F.struct(t["token"].alias("token"), t["len"].alias("len"))).alias("own"))
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("first"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {HEADS} as int)")
    both = own.withColumns({"h": h, "at": F.expr("conv_id - conv_id % 100")}).join(heads, F.col("at") == F.col("first"), "left")
    whole = both.select("conv_id", F.expr("concat(slice(coalesce(head, slice(own, 1, 0)), 1, h), slice(own, h + 1, size(own)))").alias("t"))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda t: F.hex(t["token"])), "").alias("path"), F.transform("t", lambda t: t["len"]).alias("lens"))


def member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, conv_id) in order -> seq, ends: SHA-256 of a class's ids, comma-joined."""
    schema = pa.schema([("seq", pa.binary()), ("ends", pa.string())])
    last, state = None, None
    for b in batches:
        rows = []
        for seq, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if seq != last:
                if state is not None:
                    rows.append((last, state.hexdigest()))
                last, state = seq, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        if rows:
            yield batch(schema, *zip(*rows))
    if state is not None:
        yield batch(schema, [last], [state.hexdigest()])


def classes(whole: DataFrame) -> DataFrame:
    """path, lens, n, low (smallest member), ends of each distinct sequence; ``whole`` is read twice. Frequent sequences leave
    a task once; of their members only ids and a digest meet."""
    named = whole.withColumn("seq", F.unhex(F.sha2(F.col("path").cast("binary"), 256)))
    sums = named.groupBy("seq").agg(F.first("path").alias("path"), F.first("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    ends = named.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(member_digests, "seq binary, ends string")
    return sums.join(ends, "seq").select("path", "lens", "n", "low", "ends")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share, of which the first ``known`` are known to be equal."""
    most = min(len(a), len(b)) // TOKEN
    while known < most and a[known * TOKEN : (known + 1) * TOKEN] == b[known * TOKEN : (known + 1) * TOKEN]:
        known += 1
    return known


def runs(splitters: list[bytes]):
    """Classes -> (part, run, no, block): sorted runs, cut at the splitters into front-coded blocks."""
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("no", pa.int32()), ("block", pa.binary())])

    def coded(rows, press):
        shared = [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        turns = [len(r[0]) // TOKEN for r in rows]
        begin, held = 0, 0
        for i in range(len(rows) + 1):
            if i == len(rows) or held >= BLOCK_TURNS:
                some = slice(begin, i)
                numbers = [shared[some], turns[some], [r[2] for r in rows[some]], [r[3] for r in rows[some]]]
                lens = [x for r, k in zip(rows[some], shared[some]) for x in r[1][k:]]
                raw = np.array([i - begin, *(x for c in numbers for x in c), *lens], dtype="<i8").tobytes()
                raw += b"".join(bytes.fromhex(r[4]) for r in rows[some]) + b"".join(r[0][k * TOKEN :] for r, k in zip(rows[some], shared[some]))
                yield press.compress(raw)
                begin, held = i, 0
            if i < len(rows):
                held += turns[i] - shared[i] + 1

    def emit(rows, run):
        press, out, at = zstandard.ZstdCompressor(level=1), [], 0
        rows.sort(key=lambda r: r[0])
        while at < len(rows):
            part = bisect_right(splitters, rows[at][0])
            end = len(rows)
            if part < len(splitters):
                end = at + bisect_right(rows[at:], False, key=lambda r, s=splitters[part]: r[0] >= s)
            out += [(part, run, no, x) for no, x in enumerate(coded(rows[at:end], press))]
            at = end
        return batch(schema, *zip(*out))

    def run(batches):
        from pyspark import TaskContext

        rows, size, number = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for path, lens, *other in zip(*(b.column(k).to_pylist() for k in range(5))):
                rows.append((bytes.fromhex(path), lens, *other))
                size += len(lens) + 1
                if size >= RUN_TURNS:
                    yield emit(rows, number)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield emit(rows, number)

    return run


def opened(blocks: list[bytes]) -> Iterator[tuple]:
    """Classes of a run, block by block: (key, turns shared with the one before, lens, n, low, ends)."""
    opener, key, lens = zstandard.ZstdDecompressor(), b"", []
    for block in blocks:
        raw = opener.decompress(block)
        count = int.from_bytes(raw[:8], "little")
        shared, turns, n, low = np.frombuffer(raw, "<i8", 4 * count, 8).reshape(4, count).tolist()
        fresh = sum(turns) - sum(shared)
        new = np.frombuffer(raw, "<i8", fresh, 8 + 32 * count).tolist()
        ends = 8 + 32 * count + 8 * fresh
        tokens, at = ends + 32 * count, 0
        for i in range(count):
            more = turns[i] - shared[i]
            key = key[: shared[i] * TOKEN] + raw[tokens + at * TOKEN : tokens + (at + more) * TOKEN]
            lens = lens[: shared[i]] + new[at : at + more]
            at += more
            yield key, shared[i], lens, n[i], low[i], raw[ends + 32 * i : ends + 32 * (i + 1)]


def merged(streams: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The classes of sorted runs in order, each with the turns that it shares with the one before in place of those it shares
    in its run; a loser tree over (run, turns shared with the last winner), where -1 marks a run that has ended."""
    k = 1
    while k < len(streams):
        k *= 2
    heads = [next(s, None) for s in streams] + [None] * (k - len(streams))
    loser: list[tuple[int, int]] = [(0, -1)] * k

    def play(a: tuple[int, int], b: tuple[int, int], node: int) -> tuple[int, int]:
        """The smaller one; the other stays at the node, with what it shares with the smaller one if that became known."""
        if a[1] == b[1] and a[1] >= 0:
            x, y = heads[a[0]][0], heads[b[0]][0]
            c = common(x, y, a[1])
            if x[c * TOKEN :] > y[c * TOKEN :]:
                a, b = b, a
            loser[node] = (b[0], c)
        else:
            if a[1] < b[1]:
                a, b = b, a
            loser[node] = b
        return a

    level = [(r, 0 if heads[r] else -1) for r in range(k)]
    while len(level) > 1:
        half = len(level) // 2
        level = [play(level[2 * i], level[2 * i + 1], half + i) for i in range(half)]
    winner = level[0]
    while winner[1] >= 0:
        run, have = winner
        head = heads[run]
        yield head[0], have, *head[2:]
        heads[run] = new = next(streams[run], None)
        winner = (run, new[1] if new else -1)
        node = (run + k) // 2
        while node:
            winner = play(winner, loser[node], node)
            node //= 2


NODE = pa.schema([
    ("mark", pa.binary()), ("parent_mark", pa.binary()), ("chars", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])
NODES = "mark binary, parent_mark binary, chars long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def mark_of(key: bytes, depth: int) -> bytes:
    """Name of the node at this depth of a path."""
    return hashlib.sha256(key[: depth * TOKEN]).digest()


class Open:
    """A node on the open path; ``mark`` if it may be in other ranges, too."""

    __slots__ = ("chars", "children", "depth", "done", "ends", "leaves", "low", "mark", "n", "saved")

    def __init__(self, depth: int, chars: int, mark: bytes | None):
        self.depth, self.chars, self.mark = depth, chars, mark
        self.n = self.children = self.leaves = self.saved = 0
        self.low, self.ends, self.done = None, None, []

    def row(self, parent_mark=None, parent=None) -> tuple:
        return self.mark, parent_mark, self.chars, self.low, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.ends or (None if self.mark else NO_MEMBERS)


def finished(stream: Iterator[tuple], edges: list[bytes]) -> Iterator[tuple]:
    """Rows of NODES: finished nodes, and partial sums of those that are first turns of the range's ``edges``."""
    path = [Open(0, 0, mark_of(b"", 0))]

    def close():
        node, parent = path.pop(), path[-1] if path else None
        if parent:
            parent.n += node.n
            parent.low = node.low if parent.low is None else min(parent.low, node.low)
        if node.mark:
            yield node.row(parent.mark if parent else None)
        else:
            node.leaves += node.children == 0
            node.saved += (node.n - 1) * node.chars
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            if parent.mark:
                yield node.row(parent.mark)
            else:
                parent.done.append(node)
        for child in node.done:
            yield child.row(None, node.low)
        node.done = []

    some = False
    for key, shared, lens, n, low, ends in stream:
        some = True
        while len(path) > shared + 1:
            yield from close()
        edge = max((common(key, e) for e in edges), default=0)
        for d in range(shared + 1, len(lens) + 1):
            path.append(Open(d, lens[d - 1], mark_of(key, d) if d <= edge else None))
        top = path[-1]
        top.n += n
        top.low = low if top.low is None else min(top.low, low)
        top.ends = ends.hex()
    while some and path:
        yield from close()


def batched(rows: Iterator[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch(NODE, *zip(*held))
            held = []
    if held:
        yield batch(NODE, *zip(*held))


def nodes_of(splitters: list[bytes]):
    def run(batches):
        for g in groups(batches, ["part"]):
            part = g.column("part")[0].as_py()
            by_run: dict[int, list[bytes]] = {}
            for r, block in zip(g.column("run").to_pylist(), g.column("block").to_pylist()):
                by_run.setdefault(r, []).append(block)
            edges = splitters[max(0, part - 1) : part + 1]
            yield from batched(finished(merged([opened(x) for x in by_run.values()]), edges))

    return run


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Added-up rows of the nodes at the edges of ranges -> their final rows, children before parents, then parents' names."""
    rows = [r for b in batches for r in b.to_pylist()]
    at = {r["mark"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        r["ends_sha256"] = r["ends_sha256"] or NO_MEMBERS
        parent = at.get(r["parent_mark"])
        if parent:
            r["parent_conv_id"] = parent["conv_id"]
            parent["n_children"] += 1
            parent["n_leaves"] += r["n_leaves"]
            parent["saved_tokens"] += r["saved_tokens"]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, NODE)


def trie(turns: DataFrame, parts: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The nodes, one row each; ``parts`` ranges (shuffle partitions by default). What the result reads stays in ``scratch``."""
    spark = turns.sparkSession
    scratch, parts = scratch or Scratch(spark), parts or shuffles(spark)
    whole = scratch.cut(rebuilt(turns))
    known = scratch.cut(classes(whole))
    scratch.drop(whole)
    every = max(1, known.count() // (SAMPLED * parts))
    # At most about SAMPLED * parts paths of at most SPLITTER turns, whatever the input.
    sample = sorted({bytes.fromhex(r[0]) for r in known.filter(F.pmod(F.xxhash64("path"), F.lit(every)) == 0).select(F.expr(f"substring(path, 1, {2 * TOKEN * SPLITTER})")).collect()} - {b""})
    splitters = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    blocks = known.mapInArrow(runs(splitters), "part int, run long, no int, block binary")
    out = scratch.cut(blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "run", "no").mapInArrow(nodes_of(splitters), NODES))
    scratch.drop(known)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edge = out.filter("mark is not null").groupBy("mark").agg(F.max("parent_mark").alias("parent_mark"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    edge = scratch.cut(edge.select(*NODE.names).repartition(1).mapInArrow(solved, NODES))
    # One row for each first turns of a splitter: at most SPLITTER * (parts - 1) + 1.
    above = F.broadcast(edge.select(F.col("mark").alias("parent_mark"), F.col("conv_id").alias("above")))
    inner = out.filter("mark is null").join(above, "parent_mark", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    shown = [c for c in NODE.names if c not in ("mark", "parent_mark", "chars")]
    return inner.select(*shown).unionByName(edge.select(*shown))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: DuckDB has no crc32: eight steps for each byte of the decimal number.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"
ORACLE = f"""
WITH said AS (SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS tok, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(tok ORDER BY turn NULLS FIRST, tok) AS t, list(len ORDER BY turn NULLS FIRST, tok) AS n, ({CRC32}) % {HEADS} AS h FROM said GROUP BY conv_id),
whole AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, o.h), list_slice(o.t, o.h + 1, len(o.t))) AS t, list_concat(list_slice(coalesce(b.n, []), 1, o.h), list_slice(o.n, o.h + 1, len(o.n))) AS n
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
firsts AS (SELECT conv_id, len(t) AS turns, unnest(range(len(t) + 1)) AS depth, t, n FROM whole),
named AS (SELECT *, array_to_string(list_slice(t, 1, depth), '') AS key FROM firsts),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN n[depth] ELSE 0 END) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256 FROM named GROUP BY key, depth),
kids AS (SELECT substr(key, 1, 32 * (depth - 1)) AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
up AS (SELECT substr(key, 1, 32 * a) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_node) GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM full_node x JOIN up u USING (key) LEFT JOIN node p ON x.depth > 0 AND p.key = substr(x.key, 1, 32 * (x.depth - 1))
"""
