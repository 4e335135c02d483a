"""A positional inverted index in delta-coded blocks.

A row is a block of a term's documents in order: their differences, numbers of occurrences and differences of positions as
variable-length integers, with the least and greatest document, the number of postings, and the offset of its first posting
in the whole index. Blocks are dealt by ranges of (term, document), so a frequent term is many blocks in many ranges.

Words are found, sorted and coded where texts are read, so what is shuffled is a row for each word of a shelf (WIDE neighbouring
document numbers) that a task has seen: codes of documents, of their numbers of positions, and of positions. A block takes them over
as they are. Arrays do the work; Python's own loops are over documents and blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..seq import cut, scratch

#: Documents of a block at most, and positions from which on one ends.
DOCS, POSITIONS = 128, 1 << 14
#: Document numbers of a shelf.
WIDE = 2048
#: Bytes of text or codes, and positions of opened blocks, that a task works on at a time (or one document, row or block).
HELD, OPEN = 1 << 23, 1 << 18
SHELF = "token string, shelf long, ids binary, counts binary, at binary"
SHELVES = pa.schema([("token", pa.string()), ("shelf", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])
ROWS = pa.schema([("token", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("at", pa.binary())])
BLOCK = "term string, low long, high long, docs int, n long, data binary, p int, k long"
BLOCKS = pa.schema([("term", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("docs", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("p", pa.int32()), ("k", pa.int64())])
OPENED = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int64()))])
LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))


def laid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative integers: seven bits each, the highest bit says that more follow. And where each
    integer's begin, with the end."""
    x = np.asarray(x, np.uint64)
    width = np.ones(len(x), np.int64)
    for bits in range(7, 64, 7):
        more = x >> np.uint64(bits) > 0
        if not more.any():
            break
        width += more
    ends = np.append(0, np.cumsum(width))
    at = np.repeat(np.arange(len(x)), width)
    k = np.arange(len(at)) - ends[at]
    out = (x[at] >> (7 * k).astype(np.uint64)) & np.uint64(127)
    return (out | (np.uint64(128) * (k + 1 < width[at]))).astype(np.uint8), ends


def coded(x: np.ndarray) -> bytes:
    return laid(x)[0].tobytes()


def uncoded(data: bytes | np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    k = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * k).astype(np.uint64), first).astype(np.int64)


def block(docs: list[int], positions: list[list[int]]) -> bytes:
    """Documents from the block's least on, occurrences, positions: each as differences."""
    counts = [len(p) for p in positions]
    deltas = [np.diff(p, prepend=0) for p in positions]
    return coded(np.concatenate([np.diff(docs, prepend=docs[0]), counts, *deltas]))


def contents(low: int, docs: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block its documents, their numbers of positions, and all positions."""
    x = uncoded(data)
    counts = x[docs : 2 * docs]
    return low + np.cumsum(x[:docs]), counts, sums(x[2 * docs :], counts)


def unblock(low: int, docs: int, data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, counts, places = contents(low, docs, data)
    return ids, np.split(places, np.cumsum(counts)[:-1])


def differences(x: np.ndarray, first: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    """Of runs that begin at ``first``: the first of each less its ``base``, and each other less the one before it."""
    out = np.diff(x, prepend=0)
    out[first] = x[first] - base
    return out


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums inside runs of these sizes, none of which is empty."""
    total, first = np.cumsum(x), np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - x[first], sizes)


def binaries(coded: tuple[np.ndarray, np.ndarray], bounds: np.ndarray) -> pa.Array:
    """Codes cut at these integers, the last bound being the end."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(coded[1][bounds].astype(np.int32)), pa.py_buffer(coded[0])])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binaries that aren't null, and where each begins, with the end."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of items whose sizes sum to about HELD."""
    part = np.cumsum(sizes) // HELD
    return list(pairwise([0, *np.flatnonzero(np.diff(part, prepend=0, append=-1)).tolist()]))


def shelves(tokens: Callable[[np.ndarray], pa.Array], word: np.ndarray, ids: np.ndarray, first: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of the shelves of sorted pairs (word, document), whose ascending positions begin at ``first``; ``tokens`` gives words."""
    shelf = ids // WIDE
    heads = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (shelf[1:] != shelf[:-1])))
    bounds, first = np.append(heads, len(ids)), np.append(first, len(places))
    codes = binaries(laid(differences(ids, heads, shelf[heads] * WIDE)), bounds), binaries(laid(np.diff(first)), bounds), binaries(laid(differences(places, first[:-1])), first[bounds])
    return pa.RecordBatch.from_arrays([tokens(word[heads]).cast(pa.string()), pa.array(shelf[heads]), *codes], schema=SHELVES)


def words_of(ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
    """The shelves of some documents' words, none of which goes beyond its document."""
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[k] for k in order]
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    letter = LETTER[raw]
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[letter])).dictionary_encode()
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    word = words.indices.to_numpy().astype(np.uint16 if len(words.dictionary) <= 1 << 16 else np.int32)
    order = np.argsort(word, kind="stable")
    word, doc, place = word[order], doc[order], place[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])))
    return shelves(lambda w: words.dictionary.take(pa.array(w)), word[first], ids[doc[first]], first, place)


def of_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Shelves of the words [A-Za-z]+ of each text, with their positions."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for start, end in pieces(np.array([len(t) for t in texts], np.int64)):
                rows = words_of(ids[start:end], texts[start:end])
                if rows is not None:
                    yield rows

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SHELF)


def of_positions(postings: DataFrame) -> DataFrame:
    """The same of token, doc_id, position."""

    def run(batches):
        for b in batches:
            counts = pc.list_value_length(b.column(2)).to_numpy()
            if len(counts):
                places = b.column(2).flatten().to_numpy().astype(np.int64)
                yield shelves(lambda k, b=b: b.column(0).take(pa.array(k)), np.arange(len(counts)), b.column(1).to_numpy(), np.cumsum(counts) - counts, places)

    whole = postings.groupBy("token", F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list("position")).alias("at"))
    return whole.mapInArrow(run, SHELF)


def rows_of(batch: pa.RecordBatch) -> pa.Table:
    """token, doc_id, n, at of each document of shelves."""
    (ids, bounds), (counts, _), (at, _) = (bytes_of(batch.column(k)) for k in (2, 3, 4))
    sizes, n = np.diff(np.append(0, np.cumsum(ids < 128))[bounds]), uncoded(counts)
    docs = np.repeat(batch.column(1).to_numpy() * WIDE, sizes) + sums(uncoded(ids), sizes)
    ends = np.append(0, np.flatnonzero(at < 128) + 1)
    codes = binaries((at, ends), np.append(0, np.cumsum(n)))
    return pa.Table.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(docs), pa.array(n), codes], schema=ROWS)


def blocks_of(rows: pa.Table, last: bool, docs: int, positions: int) -> tuple[dict, pa.Table]:
    """Columns of the blocks of rows in order of words and shelves, k within these rows, and the rows that wait for more: unless
    these are the ``last``, blocks that meet the last shelf. Rows of the same word and document become one."""
    rows = rows.combine_chunks()
    fresh, doc = begun(rows["token"]), rows["doc_id"].to_numpy()
    if (~fresh[1:] & (doc[1:] < doc[:-1])).any():
        rows = rows.take(pa.array(np.lexsort((doc, np.cumsum(fresh))))).combine_chunks()
        doc = rows["doc_id"].to_numpy()
    if (again := np.append(False, ~fresh[1:] & (doc[1:] == doc[:-1]))).any():
        rows = merged(rows, np.flatnonzero(~again))
        fresh, doc = fresh[~again], doc[~again]
    n, heads = rows["n"].to_numpy(), np.append(np.flatnonzero(fresh), len(doc))
    total, cuts = np.append(0, np.cumsum(n)), []
    for a, b, m in zip(heads[:-1].tolist(), heads[1:].tolist(), np.diff(total[heads]).tolist()):
        while a < b:
            cuts.append(a)
            a = min(b, a + docs, b if m <= positions else int(np.searchsorted(total, total[a] + positions)))
    ends = np.array([*cuts[1:], len(doc)], np.int64)
    if not last:
        shelf = np.searchsorted(doc[heads[-2] :], doc[-1] // WIDE * WIDE) + heads[-2]
        ends = ends[: np.searchsorted(ends, shelf, "right")]
    cuts = np.array(cuts[: len(ends)], np.int64)
    taken = int(ends[-1]) if len(ends) else 0
    (d, d_at), (c, c_at) = laid(differences(doc[:taken], cuts, doc[cuts])), laid(n[:taken])
    codes, at = bytes_of(rows["at"].combine_chunks())
    spans = [memoryview(x) for x in (d, c, codes)]
    bounds = [(x[cuts].tolist(), x[ends].tolist()) for x in (d_at, c_at, at)]
    data = [b"".join([x[a:b] for x, a, b in zip(spans, k[::2], k[1::2])]) for k in zip(*(y for x in bounds for y in x))]
    term = rows["token"].combine_chunks().take(pa.array(cuts))
    return {"term": term, "low": doc[cuts], "high": doc[ends - 1], "docs": ends - cuts, "n": total[ends] - total[cuts], "data": data, "k": total[cuts]}, rows.slice(taken)


def begun(token: pa.ChunkedArray) -> np.ndarray:
    """Whether a row's word is another than that of the row before it."""
    token = token.combine_chunks()
    return np.append(True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))


def merged(rows: pa.Table, first: np.ndarray) -> pa.Table:
    """The rows from each of ``first`` to the next as one, with all their positions in order."""
    at = rows["at"].to_pylist()
    runs = [at[a] if b == a + 1 else coded(np.diff(np.sort(np.concatenate([np.cumsum(uncoded(x)) for x in at[a:b]])), prepend=0)) for a, b in pairwise([*first.tolist(), len(at)])]
    out = rows.take(pa.array(first)).to_pydict() | {"n": np.add.reduceat(rows["n"].to_numpy(), first), "at": runs}
    return pa.Table.from_pydict(out, ROWS)


def build(postings: DataFrame) -> DataFrame:
    """token, doc_id, position, or shelves -> the index, written: term, low, high, docs, n, data, offset."""
    parts, most = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), (DOCS, POSITIONS)

    def run(batches):
        from pyspark import TaskContext

        p, k, rest = TaskContext.get().partitionId(), 0, ROWS.empty_table()

        def closed(last: bool) -> pa.RecordBatch:
            nonlocal k, rest
            done, rest = blocks_of(rest, last, *most)
            done |= {"p": np.full(len(done["k"]), p), "k": done["k"] + k}
            k += int(done["n"].sum())
            return pa.RecordBatch.from_arrays([x if isinstance(x := done[f.name], pa.Array) else pa.array(x, f.type) for f in BLOCKS], schema=BLOCKS)

        for b in batches:
            b = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, SHELVES)], schema=SHELVES)
            for start, end in pieces(np.diff(bytes_of(b.column(4))[1])) if b.num_rows else ():
                if end > start:
                    rest = pa.concat_tables([rest, rows_of(b.slice(start, end - start))])
                    yield closed(False)
        if rest.num_rows:
            yield closed(True)

    # Written first, as Spark reads rows twice to deal them by ranges.
    rows = cut(postings if "shelf" in postings.columns else of_positions(postings))
    blocks = cut(rows.select(*SHELVES.names).repartitionByRange(parts, "token", "shelf").sortWithinPartitions("token", "shelf").mapInArrow(run, BLOCK))
    scratch(rows.sparkSession).drop(rows)
    sizes = blocks.groupBy("p").agg(F.sum("n").alias("m"))
    # The window orders one row for each shuffle partition.
    starts = F.broadcast(sizes.select("p", F.coalesce(F.sum("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")))
    return blocks.join(starts, "p").withColumn("offset", F.col("first") + F.col("k")).drop("p", "k", "first")


def opened(index: DataFrame) -> DataFrame:
    """term, doc_id, at (positions) of blocks."""

    def out(held: list) -> pa.RecordBatch:
        terms, ids, counts, places = zip(*held)
        term = pa.array(terms, pa.string()).take(pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids])))
        offsets = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32)
        return pa.RecordBatch.from_arrays([term, pa.array(np.concatenate(ids)), pa.ListArray.from_arrays(offsets, np.concatenate(places)).cast(OPENED.field("at").type)], schema=OPENED)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for term, low, docs, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                held.append((term, *contents(low, docs, data)))
                size += len(held[-1][3])
                if size >= OPEN:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return index.select("term", "low", "docs", "data").mapInArrow(run, "term string, doc_id long, at array<long>")


def phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, n: how often the words follow each other in a document. Only blocks of these words are opened; a document's positions,
    each moved back by its word's place, are those that all words share."""
    places = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(k).cast("long").alias("k")) for k, w in enumerate(words)])
    own = opened(index.filter(F.col("term").isin(*set(words)))).withColumn("w", F.explode(places)).filter("w.term = term")
    moved = own.select("doc_id", F.transform("at", lambda x: x - F.col("w.k")).alias("at"))
    both = moved.groupBy("doc_id").agg(F.collect_list("at").alias("all")).filter(F.size("all") == len(words))
    return both.select("doc_id", F.size(F.aggregate(F.slice("all", 2, max(1, len(words))), F.col("all")[0], lambda a, x: F.array_intersect(a, x))).cast("long").alias("n")).filter("n > 0")
