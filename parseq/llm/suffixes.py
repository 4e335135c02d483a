"""Operator 2: exact substring dedup with sorted suffixes.

A byte goes when it lies in a ``WINDOW``-byte string that also starts earlier (smaller doc_id, or earlier in the document).

1. Sampling. A window's anchor is the start of its least ``GRAM``-byte gram by hash, so equal windows have equal anchors at
   equal offsets. Neighbouring windows with one anchor are one item: the suffix at the anchor and the text before it.
2. Sieve. Hashes of anchors' grams, as sorted and delta-coded blocks, tell which grams occur once only; their items can't
   repeat and are left out. Of a gram that a run has more than once one entry decides for other runs; the rest are live.
3. Sorted runs. Each task sorts its items as strings (suffix, then the text before the anchor read backwards), keeps the
   earliest of equal ones and marks the others, and front-codes the rest: the length of the prefix shared with the item
   before, then the remaining bytes. A run is exchanged as one compressed block for each part of the anchors' hash range.
4. Merge. A loser tree combines the runs of a part. It carries prefix lengths: of two items that share different lengths
   with the last winner the longer one wins unread, and for equal lengths only the bytes after them are compared.
5. Windows. Common prefixes of neighbours, to the right and (after a second sort) to the left of an anchor, split the
   items of an anchor into classes of equal windows for each offset; all but the earliest window of a class are marked.
6. Frequent grams. Where a frequent passage begins or ends, the items of one gram differ in their contexts, and all would meet in
   one part. The sieve counts each gram exactly. Every gram with more than half of an average part's items, so at most two for
   each part, is split by offsets: each window of its items becomes an item of its own, dealt by the hash of its 100 bytes.
   These items take the same way as all others (sorted runs, equal ones leave a run once, loser trees, bytes compared).

Nothing is compared in pairs, and items that many documents share leave each run once.

Defined results: null and short texts lose nothing; rows without an id can't be ranked and stay whole; rows that share an
id count as one document (the same offsets go in each); texts of any length and any bytes are processed whole, in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, documents, groups, mix64, only, sha, shuffles

WINDOW, GRAM, STEP, RUN_ITEMS, PARTS = 100, 20, 1 << 20, 100_000, 4
#: Items of a gram from which on the sieve reports its count, and items that are split by offsets at a time.
COUNTED, SPLIT = 1 << 10, 1 << 12
LEFT = WINDOW - GRAM
#: A record: the suffix, the bytes before the anchor backwards, and both lengths; shorter parts are padded with zeros.
RECORD = WINDOW + LEFT + 2


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position but the last ones."""
    v = data.astype(np.uint64)
    for width in (1, 2, 4):
        v = v[:-width] | v[width:] << np.uint64(8 * width)
    n = len(data) - GRAM + 1
    return gram_hash(v[:n], v[8 : 8 + n], v[GRAM - 8 : GRAM - 8 + n])


def gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of grams given as the 64-bit words at 0, 8 and GRAM - 8."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h = mix64(h ^ b * np.uint64(0xC2B2AE3D27D4EB4F))
    return mix64(h ^ c * np.uint64(0x165667B19E3779F9))


def chained(words, seed: int) -> np.ndarray:
    """Hash of rows given as 64-bit words, one array for each word of the rows; each word is mixed into all that came before."""
    h = np.uint64(seed)
    for w in words:
        h = mix64(h ^ w * np.uint64(0x9E3779B97F4A7C15))
    return h


def words(rows: np.ndarray, starts) -> list[np.ndarray]:
    """The 64-bit word of each row at each start."""
    return [np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel() for at in starts]


def items(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each item the number of its text, first window, last window, anchor (in data) and the
    anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, none.view(np.uint64)
    h = grams(data)
    low = np.uint64((1 << 32) - 1)
    least, span = h & ~low | np.arange(len(h), dtype=np.uint64), 1
    while 2 * span <= LEFT + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    more = LEFT + 1 - span
    least = np.minimum(least[: len(least) - more], least[more:])
    anchor = (least & low).astype(np.int64)
    of = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
    good = np.arange(len(anchor)) + WINDOW <= ends[of]
    new = good.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | ~good[:-1]
    done = good.copy()
    done[:-1] &= new[1:] | ~good[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(done)
    return of[first], first, last, anchor[first], h[anchor[first]]


def slices(ids, raw) -> tuple[list, list]:
    """Texts cut so that each window starts in one piece: (id, offset) and the bytes of each piece."""
    where, pieces = [], []
    for doc, data in zip(ids, raw):
        for at in range(0, max(0, len(data) - WINDOW + 1), STEP):
            where.append((doc, at))
            pieces.append(data[at : at + STEP + WINDOW - 1])
    return where, pieces


def chunks(pairs):
    """Groups of (id, bytes) of about STEP bytes."""
    held, size = [], 0
    for doc, data in pairs:
        held.append((doc, data))
        size += len(data)
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def records(data: np.ndarray, base: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The record of each item; base is where its text begins in data."""
    right, left = last + WINDOW - anchor, anchor - first
    out = np.zeros((len(first), RECORD), np.uint8)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    a = base + anchor + LEFT
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    out[:, :WINDOW] = view[a] * (np.arange(WINDOW) < right[:, None])
    view = np.lib.stride_tricks.sliding_window_view(padded, LEFT)
    out[:, WINDOW : WINDOW + LEFT] = view[a - LEFT][:, ::-1] * (np.arange(LEFT) < left[:, None])
    out[:, -2], out[:, -1] = right, left
    return out


def shared(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        at = differs.argmax(1)
        out[1:] = np.where(differs[np.arange(len(at)), at], at, rows.shape[1])
    return out


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def block_of(n: int, lcp: np.ndarray, numbers: list[np.ndarray], rest: bytes, press) -> bytes:
    return press.compress(n.to_bytes(4, "little") + lcp.astype(np.uint8).tobytes() + b"".join(map(planes, numbers)) + rest)


def front_coded(rows: np.ndarray, doc: np.ndarray, anchor: np.ndarray, press) -> bytes:
    """A block: number of rows, shared lengths, documents and anchors, remaining bytes."""
    lcp = shared(rows)
    return block_of(len(rows), lcp, [doc, anchor], rows[np.arange(RECORD) >= lcp[:, None]].tobytes(), press)


def decoded(block: bytes, opener) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = opener.decompress(block)
    n = int.from_bytes(raw[:4], "little")
    lcp = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    doc, anchor = unplanes(raw[4 + n : 4 + 9 * n]), unplanes(raw[4 + 9 * n : 4 + 17 * n])
    own = np.arange(RECORD) >= lcp[:, None]
    values = np.zeros((n, RECORD), np.uint8)
    values[own] = np.frombuffer(raw, np.uint8, offset=4 + 17 * n)
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(values, source, 0), lcp, doc, anchor


def sieve_blocks(parts: int):
    """(id, compressed text) -> (part, block) with the hashes, places and extents of anchors; ``known`` ones are live. The
    first entry of a gram also tells how many the block holds."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def emit(found):
        press = zstandard.ZstdCompressor(level=1)
        h, doc, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h, kind="stable")
        h, doc, place = h[order], doc[order], place[order]
        again = np.concatenate([[False], h[1:] == h[:-1]])
        known = again | np.concatenate([again[1:], [False]])
        first = np.flatnonzero(~again)
        held = np.zeros(len(h), np.int64)
        held[first] = np.diff(first, append=len(h))
        part = np.where(again, mix64((doc ^ place).view(np.uint64)) % np.uint64(parts), h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in range(parts):
            at = order[edges[p] : edges[p + 1]]
            if len(at):
                out.append((p, block_of(len(at), known[at], [np.diff(h[at].view(np.int64), prepend=0), doc[at], place[at], held[at]], b"", press)))
        return batch(schema, *zip(*out))

    def run(batches):
        opener, found, size = zstandard.ZstdDecompressor(), [], 0
        for b in batches:
            raw = (opener.decompress(z.as_py()) for z in b.column(1))
            for held in chunks(zip(b.column(0).to_pylist(), raw)):
                where, pieces = slices(*zip(*held))
                if not pieces:
                    continue
                ends = np.cumsum([len(x) for x in pieces])
                starts = np.concatenate([[0], ends[:-1]])
                of, first, last, anchor, h = items(np.frombuffer(b"".join(pieces), np.uint8), starts, ends)
                doc, offset = np.array(where, dtype=np.int64).reshape(-1, 2).T
                place = (anchor - starts[of] + offset[of]) << 16 | (anchor - first) << 8 | (last + WINDOW - anchor)
                found.append((h, doc[of], place))
                size += len(of)
                if size >= 4 * RUN_ITEMS:
                    yield emit(found)
                    found, size = [], 0
        if size:
            yield emit(found)

    return run


def sieved(least: int):
    """Blocks by part -> (doc_id, place) of the items whose gram occurs elsewhere too, and (gram, n) of the grams that occur
    ``least`` times or more."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for g in groups(batches, ["part"]):
            found = []
            for block in g.column("block"):
                raw = opener.decompress(block.as_py())
                n = int.from_bytes(raw[:4], "little")
                h, doc, place, held = (unplanes(raw[4 + n + 8 * k * n : 4 + n + 8 * (k + 1) * n]) for k in range(4))
                found.append((np.cumsum(h), doc, place, held, np.frombuffer(raw, np.uint8, n, 4) > 0))
            h, doc, place, held, known = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            again = h[order][1:] == h[order][:-1]
            live = known.copy()
            live[order[1:][again]] = True
            live[order[:-1][again]] = True
            first = np.concatenate([[0], np.flatnonzero(~again) + 1])
            total = np.add.reduceat(held[order], first)
            often = total >= least
            rows, grams = int(live.sum()), int(often.sum())
            none = pa.nulls(rows, pa.int64())
            yield batch(schema, doc[live], place[live], none, none)
            yield batch(schema, pa.nulls(grams, pa.int64()), pa.nulls(grams, pa.int64()), h[order][first[often]], total[often])

    return run


def split(rows: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records -> a record for each of their windows: the window is the suffix, nothing is before it."""
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    found = []
    for o in range(LEFT + 1):
        own = np.flatnonzero((left >= o) & (right >= WINDOW - o))
        out = np.zeros((len(own), RECORD), np.uint8)
        out[:, :o] = rows[own, WINDOW : WINDOW + o][:, ::-1]
        out[:, o:WINDOW] = rows[own, : WINDOW - o]
        out[:, -2] = WINDOW
        found.append((out, doc[own], anchor[own] - o))
    return tuple(np.concatenate(x) for x in zip(*found))


def spans(gone: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and marks (start << 12 | length) of the windows marked in ``gone``, by item and offset."""
    edge = np.diff(gone.astype(np.int8), axis=1, prepend=0, append=0)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return doc[row], (anchor[row] - high + 1) << 12 | (high - 1 - low + WINDOW)


def runs(parts: int, hot: np.ndarray):
    """(id, compressed text, places) -> (part, block, marks): sorted front-coded runs and marks of repeats inside a run; the
    items of ``hot`` grams are split by offsets, a bounded number at a time."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("marks", pa.binary())])

    def ordered(rows, doc, anchor, part):
        """Records by part, then by bytes, each once (the earliest), and marks of the others."""
        order = np.lexsort((anchor, doc))
        rows, doc, anchor, part = rows[order], doc[order], anchor[order], part[order]
        keys = np.concatenate([part.astype(">u4").view(np.uint8).reshape(-1, 4), rows], 1)
        order = np.argsort(keys.view(f"S{RECORD + 4}").ravel(), kind="stable")
        rows, doc, anchor, part = rows[order], doc[order], anchor[order], part[order]
        same = np.concatenate([[False], (rows[1:] == rows[:-1]).all(1)])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
        repeat = same & ((doc != doc[head]) | (anchor != anchor[head]))
        mark = np.stack([doc[repeat], (anchor[repeat] - rows[repeat, -1]) << 12 | (rows[repeat, -2].astype(np.int64) + rows[repeat, -1])], 1)
        return rows[~same], doc[~same], anchor[~same], part[~same], mark

    def blocks(rows, doc, anchor, part, mark, press):
        edges, shares = np.searchsorted(part, np.arange(parts + 1)), np.linspace(0, len(mark), parts + 1).astype(int)
        out = []
        for p in range(parts):
            s, e = edges[p], edges[p + 1]
            m = mark[shares[p] : shares[p + 1]]
            if e > s or len(m):
                out.append((p, front_coded(rows[s:e], doc[s:e], anchor[s:e], press) if e > s else None, press.compress(planes(m[:, 0]) + planes(m[:, 1])) if len(m) else None))
        if out:
            yield batch(schema, *zip(*out))

    def emit(found):
        press = zstandard.ZstdCompressor(level=1)
        rows, doc, anchor = (np.concatenate(x) for x in zip(*found))
        gram = words(rows, (0, 8))
        rows, doc, anchor, part, mark = ordered(rows, doc, anchor, (mix64(gram[0] ^ mix64(gram[1])) % np.uint64(parts)).astype(np.int64))
        often = np.isin(gram_hash(*words(rows, (0, 8, GRAM - 8))), hot)
        if not often.any():
            yield from blocks(rows, doc, anchor, part, mark, press)
            return
        held, marks = [tuple(x[~often] for x in (rows, doc, anchor, part))], [mark]
        rows, doc, anchor = rows[often], doc[often], anchor[often]
        for at in range(0, len(rows), SPLIT):
            made = split(*(x[at : at + SPLIT] for x in (rows, doc, anchor)))
            window = chained(words(made[0], (*range(0, WINDOW - 8, 8), WINDOW - 8)), 1)
            *some, mark = ordered(*made, (window % np.uint64(parts)).astype(np.int64))
            held.append(some)
            marks.append(mark)
            # What is left of several slices goes out together, so that blocks stay few and large.
            if at + SPLIT >= len(rows) or sum(len(h[0]) for h in held) >= 4 * RUN_ITEMS:
                *run, mark = ordered(*(np.concatenate(x) for x in zip(*held)))
                yield from blocks(*run, np.concatenate([*marks, mark]), press)
                held, marks = [], []

    def run(batches):
        opener, found, size = zstandard.ZstdDecompressor(), [], 0
        for b in batches:
            for doc, z, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                place = np.unique(np.asarray(places.values, dtype=np.int64))
                data = np.frombuffer(opener.decompress(z.as_py()), np.uint8)
                for at in range(0, len(place), RUN_ITEMS):
                    some = place[at : at + RUN_ITEMS]
                    anchor, left, right = some >> 16, some >> 8 & 255, some & 255
                    fits = anchor + right <= len(data)
                    anchor, left, right = anchor[fits], left[fits], right[fits]
                    found.append((records(data, np.zeros(len(anchor), np.int64), anchor - left, anchor + right - WINDOW, anchor), np.full(len(anchor), doc), anchor))
                    size += len(anchor)
                    if size >= RUN_ITEMS:
                        yield from emit(found)
                        found, size = [], 0
        if size:
            yield from emit(found)

    return run


def prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two records of which the first ``known`` bytes are equal; reads only the others."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return RECORD - (x.bit_length() + 7) // 8


def merged(keys: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree: numbers of the records in order (runs laid end to end), and the length of the
    prefix that each shares with the one before."""
    k = 1
    while k < len(keys):
        k *= 2
    base, total = [], 0
    for r in keys:
        base.append(total)
        total += len(r)
    at = [0] * k
    end = -1  # the prefix length of an exhausted run: smaller than any, so it never wins
    loser, shared_len = [0] * k, [0] * k

    def play(node: int) -> tuple[int, int]:
        """First round: winner of a subtree and the length it shares with the empty last winner."""
        if node >= k:
            r = node - k
            return r, 0 if r < len(keys) and keys[r] else end
        (a, m), (b, n) = play(2 * node), play(2 * node + 1)
        if m == 0 and n == 0:
            x, y = keys[a][0], keys[b][0]
            c = prefix(x, y, 0)
            if x <= y:
                loser[node], shared_len[node] = b, c
                return a, 0
            loser[node], shared_len[node] = a, c
            return b, 0
        if m >= n:
            loser[node], shared_len[node] = b, n
            return a, m
        loser[node], shared_len[node] = a, m
        return b, n

    if k == 1:
        return list(range(total)), list(lcps[0]) if keys else []
    winner, have = play(1)
    order, out = [], []
    for _ in range(total):
        order.append(base[winner] + at[winner])
        out.append(have)
        i = at[winner] = at[winner] + 1
        own = keys[winner]
        have = lcps[winner][i] if i < len(own) else end
        node = (winner + k) >> 1
        while node:
            n = shared_len[node]
            if n > have:
                other = loser[node]
                loser[node], shared_len[node] = winner, have
                winner, have = other, n
            elif n == have and n != end:
                other = loser[node]
                x, y = keys[winner][at[winner]], keys[other][at[other]]
                c = prefix(x, y, n)
                if c == RECORD or x[c] < y[c]:
                    shared_len[node] = c
                else:
                    loser[node], shared_len[node] = winner, c
                    winner, have = other, n
            node >>= 1
    return order, out


def repeats(rows: np.ndarray, lcp: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted records of a part -> documents and marks (start << 12 | length) of windows that also start earlier."""
    new = lcp < GRAM
    new[:1] = True
    group = np.cumsum(new)
    live = np.bincount(group)[group] > 1
    if not live.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Of neighbours that stay next to each other only the rows between them go, and those are of other groups.
    rows, lcp, doc, anchor, group = rows[live], np.minimum(lcp[live], WINDOW), doc[live], anchor[live], group[live]
    n = len(rows)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    back = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows[:, WINDOW : WINDOW + LEFT]], 1)
    by_left = np.argsort(back.view(f"S{LEFT + 4}").ravel(), kind="stable")
    left_lcp = shared(back[by_left]) - 4
    rank = np.lexsort((anchor, doc))
    gone = np.zeros((n, LEFT + 1), bool)
    for o in range(LEFT + 1):
        owners = rank[(left[rank] >= o) & (right[rank] >= WINDOW - o)]
        if len(owners) < 2:
            continue
        to_right = np.cumsum(new | (lcp < WINDOW - o))
        to_left = np.empty(n, np.int64)
        to_left[by_left] = np.cumsum(left_lcp < o)
        # An item owns the offsets from its least (100 - right) to its left length.
        _, head, of = np.unique(to_right[owners] * np.int64(n + 1) + to_left[owners], return_index=True, return_inverse=True)
        first = owners[head[of]]
        gone[owners, o] = (doc[first] != doc[owners]) | (anchor[first] != anchor[owners])
    return spans(gone, doc, anchor)


def resolved(batches):
    """Blocks by part -> (doc_id, mark)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())])
    opener = zstandard.ZstdDecompressor()
    for g in groups(batches, ["part"]):
        for m in g.column("marks").to_pylist():
            if m:
                yield batch(schema, *unplaned(opener.decompress(m), 2))
        found = [decoded(x, opener) for x in g.column("block").to_pylist() if x]
        del g
        if not found:
            continue
        rows, doc, anchor = (np.concatenate([p[i] for p in found]) for i in (0, 2, 3))
        lcps = [p[1].tolist() for p in found]
        del found
        keys, at = [], 0
        for x in lcps:
            raw = rows[at : at + len(x)].tobytes()
            keys.append([raw[i : i + RECORD] for i in range(0, len(raw), RECORD)])
            at += len(x)
        order, lcp = merged(keys, lcps)
        del keys, lcps, raw
        rows, doc, anchor = rows[order], doc[order], anchor[order]
        yield batch(schema, *repeats(rows, np.array(lcp, dtype=np.int64), doc, anchor))


def unplaned(raw: bytes, n: int) -> list[np.ndarray]:
    """``n`` arrays of one length laid end to end."""
    size = len(raw) // n
    return [unplanes(raw[k * size : (k + 1) * size]) for k in range(n)]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, z: the compressed UTF-8 bytes of each text."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield batch(pa.schema([("doc_id", pa.int64()), ("z", pa.binary())]), b.column(0), [press.compress((t.as_py() or "").encode()) for t in b.column(1)])

    return docs.mapInArrow(run, "doc_id long, z binary")


def marks(docs: DataFrame, parts: int, most: int | None = None) -> DataFrame:
    """doc_id, marks: repeated windows of each document as start << 12 | length. Grams of more than ``most`` items are split by
    offsets (default: half of an average part's items)."""
    known = docs.filter("doc_id is not null")
    blocks = known.mapInArrow(sieve_blocks(parts), "part int, block binary").repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    told = Scratch(docs.sparkSession).cut(blocks.mapInArrow(sieved(COUNTED if most is None else most + 1), "doc_id long, place long, gram long, n long"))
    if most is None:
        most = max(COUNTED, told.filter("gram is null").count() // (2 * parts))
    # Their items together are at most all items: two grams for each part.
    hot = np.array([r.gram for r in told.filter(F.col("n") > most).select("gram").collect()], np.int64).view(np.uint64)
    live = told.filter("gram is null").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    sorted_runs = known.join(live, "doc_id").select("doc_id", "z", "places").mapInArrow(runs(parts, hot), "part int, block binary, marks binary")
    found = sorted_runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(resolved, "doc_id long, mark long")
    return found.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def removed(size: int, found: np.ndarray) -> np.ndarray:
    """Maximal removed runs [start, end) of a text of ``size`` bytes."""
    start = found >> 12
    end = np.minimum(start + (found & 4095), size)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    start, end = start[start < size], end[start < size]
    if not len(start):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]], 1)


def dedup(docs: DataFrame, parts: int | None = None, with_text: bool = False, most: int | None = None) -> DataFrame:
    """PARTS parts of the hash range for each shuffle partition, so that what a worker merges at once stays small; ``most`` as
    in :func:`marks`.

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start, end in bytes), and kept (bytes) if asked."""
    z = packed(only(docs, doc_id="long", text="string"))
    found = marks(z, parts or PARTS * shuffles(docs.sparkSession), most).withColumnRenamed("doc_id", "id__")
    joined = z.join(found, F.col("doc_id") == F.col("id__"), "left").select("doc_id", "z", "marks")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", span), ("kept", pa.binary())])

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, z, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = opener.decompress(z.as_py())
                spans = removed(len(data), np.asarray(found.values, dtype=np.int64) if found.is_valid else np.zeros(0, np.int64)).tolist()
                kept = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)])) if spans else data
                rows.append((doc, len(data), len(data) - len(kept), len(spans), sha(kept), [{"start": s, "end": e} for s, e in spans], kept if with_text else None))
            yield batch(schema, *(zip(*rows) if rows else [()] * 7))

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept binary")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
