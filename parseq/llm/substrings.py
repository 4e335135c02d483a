"""Operator 10: substring dedup by hashed lines and sentences.

A text is cut at line feeds and after sentence ends; units are normalised (lower case, single spaces) and hashed. Of all
occurrences of a unit the earliest one (smallest doc_id, then position) stays, and the others go. What stays keeps its
original characters, and the removed spans are given as offsets into the original text.

Two options restrict this: ``min_words`` leaves out shorter units, and with ``min_run`` repeats go only where consecutive ones
hold so many words together (blank units between them don't count, and go with them), so that a passage of short lines goes
as a long sentence does, while a lone common phrase in a text of its own stays.

Spark takes the minimum of each digest with partial aggregation, so a passage that a third of all documents share is one
row for each task; the winners, not the repeats, then travel back to their documents, which no frequent unit can skew.

Defined results: null texts are empty; documents without an id can't be ranked and stay as they are; rows that share an
id count as one document (all keep the units that it keeps); texts of any length are processed whole; extra columns stay.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, only, sha, texts

MIN_WORDS, MIN_RUN = 1, 1
#: The run length of ``op10_substrings`` and of the pipeline, which have to leave texts without repeated passages alone.
PASSAGE = 15
END = re.compile(r"\n|(?<=[.!?]) ")


def units(text: str) -> list[tuple[int, int]]:
    """[start, end) of each unit with its separator, covering the text."""
    cuts = [m.end() for m in END.finditer(text)]
    bounds = [0, *cuts] if not cuts or cuts[-1] < len(text) else [0, *cuts[:-1]]
    return list(zip(bounds, [*bounds[1:], len(text)])) if text else []


def marked(text: str, min_words: int) -> list[tuple[int, bytes]]:
    """Position and digest of each unit that is long enough."""
    out = []
    for k, (s, e) in enumerate(units(text)):
        words = text[s:e].lower().split()
        if len(words) >= min_words:
            out.append((k, hashlib.md5(" ".join(words).encode()).digest()))
    return out


def winners(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, kept (positions of the units whose earliest occurrence is there)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for b in batches:
            first: dict[bytes, tuple[int, int]] = {}
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                for k, d in marked(text, min_words):
                    if d not in first or (doc, k) < first[d]:
                        first[d] = (doc, k)
            both = np.frombuffer(b"".join(first), dtype="<i8").reshape(-1, 2)
            at = list(zip(*first.values())) or [(), ()]
            yield batch(schema, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), *at)

    found = docs.filter("doc_id is not null").mapInArrow(run, "a long, b long, doc_id long, pos int")
    return found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "pos")).alias("first")).select("first.*").groupBy("doc_id").agg(F.collect_list("pos").alias("kept"))


def removals(text: str, cuts: list[tuple[int, int]], kept: set[int], min_words: int, min_run: int) -> list[tuple[int, int]]:
    """First and last unit of each run of repeats that is long enough."""
    out, first, last, total = [], None, None, 0
    for k, (s, e) in enumerate(cuts):
        n = len(text[s:e].split())
        if n >= min_words and k not in kept:
            first, last, total = k if first is None else first, k, total + n
        elif n:
            if first is not None and total >= min_run:
                out.append((first, last))
            first, total = None, 0
    if first is not None and total >= min_run:
        out.append((first, last))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    bounds = [0, *(x for span in spans for x in span), len(text)]
    return "".join(text[s:e] for s, e in zip(bounds[::2], bounds[1::2]))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, text, then n_units, n_removed, removed (array of start, end), kept_text."""
    slim = only(docs, doc_id="long", text="string")
    joined = slim.join(winners(slim, min_words).withColumnRenamed("doc_id", "id__"), F.col("doc_id") == F.col("id__"), "left").select("doc_id", "text", "kept")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed", span), ("kept_text", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, kept in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = text.as_py()
                text = raw or ""
                cuts = units(text)
                gone = [] if doc is None else removals(text, cuts, set(kept.as_py() or ()), min_words, min_run)
                spans = [(cuts[a][0], cuts[z][1]) for a, z in gone]
                rows.append((doc, raw, len(cuts), sum(z - a + 1 for a, z in gone), [{"start": s, "end": e} for s, e in spans], without(text, spans)))
            yield batch(schema, *(zip(*rows) if rows else [()] * 6))

    return joined.mapInArrow(run, "doc_id long, text string, n_units long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")


def rewrite(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with its columns, the texts without what :func:`dedup` removes (and ``n_chars`` as their new length, if there)."""
    found = winners(only(docs, doc_id="long", text="string"), min_words).select(F.col("doc_id").alias("id__"), F.col("kept").alias("kept__"))
    joined = docs.join(found, F.col("doc_id") == F.col("id__"), "left").drop("id__")
    at, ids = docs.columns.index("text"), docs.columns.index("doc_id")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            out = []
            for doc, text, kept in zip(b.column(ids).to_pylist(), b.column(at), b.column(b.num_columns - 1)):
                raw = text.as_py()
                if doc is not None and raw:
                    cuts = units(raw)
                    raw = without(raw, [(cuts[a][0], cuts[z][1]) for a, z in removals(raw, cuts, set(kept.as_py() or ()), min_words, min_run)])
                out.append(raw)
            columns = b.columns[:-1]
            columns[at] = pa.array(out, columns[at].type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in out], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op10_substrings(spark: SparkSession, sf_dir: str, min_run: int = PASSAGE) -> DataFrame:
    done = dedup(documents(spark, sf_dir), min_run=min_run)
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return done.select("doc_id", "n_units", "n_removed", F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).alias("removed_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), spans.alias("removed_spans"))


def op10_substrings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeat goes, however short."""
    return op10_substrings(spark, sf_dir, MIN_RUN)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS u FROM documents),
raw AS (SELECT doc_id, generate_subscripts(u, 1) - 1 AS k, unnest(u) AS unit, len(u) AS n, text FROM d),
pos AS (SELECT doc_id, k, n, unit, text, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM raw),
placed AS (SELECT doc_id, k, s, substr(text, s + 1, length(unit) + 1) AS orig, array_to_string(list_filter(regexp_split_to_array(lower(unit), '\s+'), lambda x: x <> ''), ' ') AS norm,
  len(list_filter(regexp_split_to_array(unit, '\s+'), lambda x: x <> '')) AS words FROM pos WHERE s < length(text)),
rep AS (SELECT *, words >= {MIN_WORDS} AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS again FROM placed),
run AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, again OR words = 0 ORDER BY k) AS grp FROM rep),
ends AS (SELECT *, min(k) FILTER (again) OVER w AS low, max(k) FILTER (again) OVER w AS high, sum(words) OVER w AS total FROM run WINDOW w AS (PARTITION BY doc_id, again OR words = 0, grp)),
mark AS (SELECT *, coalesce((again OR words = 0) AND k BETWEEN low AND high AND total >= {PASSAGE}, false) AS gone FROM ends),
spans AS (SELECT doc_id, string_agg(b || '-' || f, ',' ORDER BY b) AS removed_spans FROM (SELECT doc_id, min(s) AS b, max(s + length(orig)) AS f FROM mark WHERE gone GROUP BY doc_id, grp) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*)::BIGINT AS n_units, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, coalesce(sum(length(orig)) FILTER (WHERE gone), 0)::BIGINT AS removed_chars,
  coalesce(string_agg(orig, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(removed_spans, '') AS removed_spans
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

ORACLE_ALL = ORACLE.replace(f"total >= {PASSAGE}", f"total >= {MIN_RUN}")
