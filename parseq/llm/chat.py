"""Operator 3: chat formatting by schema fingerprints.

The nested field paths of a record (or of a table's schema) are hashed; the hash selects a declarative mapping that says
where roles and texts are: of the layouts whose paths are all there the one with most paths, in the order below. It is
looked for once for each hash. Other fields don't matter. Each turn becomes ``### role: text</turn>`` and a line feed; a backslash escapes every control
character inside roles and texts, so no text can imitate a turn and reading back gives exactly what went in.

Defined results: null texts and roles are empty strings; turns with equal numbers are ordered by role, then text, and
repeated rows are repeated turns; a null conversation id is one conversation of its own; null turn numbers come first;
a record that gives no turns (no JSON object, no known layout, an empty list of turns, nested more deeply than Python follows,
or holding halves of characters, which no text can) gives one row with its fingerprint and a reason; contents that are lists of parts are their
texts in order (parts without a text, and values that aren't text, as JSON), turns that aren't objects have no role; other
columns are ignored. A conversation is streamed turn by turn
in one task's order, never held whole, as its digest is sequential.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, only, table

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"

#: Layouts by name: the field paths that mark one, and where its turns are. ``turns`` is the path of a list whose items
#: have ``role`` and ``text``; ``fixed`` lists (role, path) of single fields; ``row`` is for tables with a row per turn.
LAYOUTS = {
    "messages": {"turns": "messages", "role": "role", "text": "content"},
    "shared": {"turns": "conversations", "role": "from", "text": "value"},
    "completion": {"fixed": [("user", "prompt"), ("assistant", "completion")]},
    "response": {"fixed": [("user", "prompt"), ("assistant", "response")]},
    "instruction": {"fixed": [("user", "instruction"), ("assistant", "output")]},
    "instruction with input": {"fixed": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    "question": {"fixed": [("user", "question"), ("assistant", "answer")]},
    "rows": {"row": True, "role": "role", "text": "text", "order": "turn", "id": "conv_id"},
}
#: Names that other layouts use for the three roles.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def marks(layout: dict) -> list[str]:
    if "turns" in layout:
        return [f"{layout['turns']}[].{layout[k]}" for k in ("role", "text")]
    return [layout[k] for k in ("id", "order", "role", "text")] if "row" in layout else [p for _, p in layout["fixed"]]


def fingerprint(paths) -> str:
    """Hash of the nested field paths of a record or schema."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def best_layout(paths) -> tuple[str, dict | None]:
    """Name and mapping of the layout with most marks, all of which are there (or have fields below them)."""
    there = set(paths) | {p[:k] for p in paths for k, c in enumerate(p) if c in ".["}
    fit = [(name, x) for name, x in LAYOUTS.items() if there.issuperset(marks(x))]
    return max(fit, key=lambda f: len(marks(f[1]))) if fit else ("", None)


#: Fingerprint -> (name, mapping), filled as fingerprints are met.
BY_FINGERPRINT: dict[str, tuple[str, dict | None]] = {}


def select(paths) -> tuple[str, dict | None]:
    """Fingerprint and mapping for the field paths."""
    mark = fingerprint(paths)
    if mark not in BY_FINGERPRINT:
        if len(BY_FINGERPRINT) >= 1 << 16:
            BY_FINGERPRINT.clear()
        BY_FINGERPRINT[mark] = best_layout(paths)
    return mark, BY_FINGERPRINT[mark][1]


def paths_of(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value; list items share the path ``name[]``. Names that hold a mark of a path are quoted."""
    if isinstance(value, dict):
        for k, v in value.items():
            k = json.dumps(k) if re.search(r'[].["]', k) else k
            yield from paths_of(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from paths_of(v, f"{at}[]")
    else:
        yield at


def paths_of_schema(kind: T.DataType, at: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from paths_of_schema(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from paths_of_schema(kind.elementType, f"{at}[]")
    else:
        yield at


def plain(value) -> str:
    """Text of a value: parts of a list in order, anything but text as JSON, null as nothing."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "".join(plain(x["text"]) if isinstance(x, dict) and "text" in x else plain(x) for x in value)
    return json.dumps(value, ensure_ascii=False)


#: An escape that may be half of a character; most records have none, and needn't be looked through.
LONE = re.compile(r"\\u[dD][89a-fA-F]")


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]], str | None]:
    """Fingerprint and canonical turns of one JSON record, or the reason why there are none."""
    try:
        value = json.loads(record or "null")
        if LONE.search(record or ""):
            json.dumps(value, ensure_ascii=False).encode()
        if isinstance(value, dict):
            return mapped(value)
    except UnicodeEncodeError:
        return fingerprint([]), [], "halves of characters"
    except RecursionError:
        return fingerprint([]), [], "nested too deeply"
    except ValueError:
        pass
    return fingerprint([]), [], "not a JSON object"


def mapped(value: dict) -> tuple[str, list[tuple[str, str]], str | None]:
    mark, layout = select(list(paths_of(value)))
    if not layout or "row" in layout:
        none = any(value.get(x["turns"]) == [] for x in LAYOUTS.values() if "turns" in x)
        return mark, [], "a single turn" if layout else "no turns" if none else "no known layout"
    if "turns" in layout:
        items = [x if isinstance(x, dict) else {layout["text"]: x} for x in value[layout["turns"]]]
        turns = [(ROLES.get(r := plain(x.get(layout["role"])), r), plain(x.get(layout["text"]))) for x in items]
    else:
        turns = [(role, t) for role, p in layout["fixed"] if (t := plain(value.get(p))) or p != "input"]
    return mark, turns, None


def canonical_turns(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """conv_id, fingerprint, turn, role, text, reason of records that hold JSON in any of the layouts; a record without turns is
    one row with a reason."""
    schema = pa.schema([("conv_id", pa.int64()), ("fingerprint", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("reason", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark, turns, reason = canonical(j)
                rows += [(i, mark, k, r, t, None) for k, (r, t) in enumerate(turns)] or [(i, mark, None, None, None, reason)]
            yield batch(schema, *(zip(*rows) if rows else [()] * 6))

    return only(records, **{id_column: "long", json_column: "string"}).mapInArrow(run, "conv_id long, fingerprint string, turn long, role string, text string, reason string")


def escaped(column, extra: str = "") -> F.Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), rf"[\\#<{extra}]", r"\\$0")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def format_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a row per turn -> conv_id, turn, piece, and the loss mask of the piece as [loss_start,
    loss_end) in characters, empty but for the assistant's text. A conversation's output is its pieces in order."""
    paths = set(paths_of_schema(turns.schema))
    # A table's other columns may look like another layout: of a table, the one with a row per turn counts first.
    _, layout = select([p for p in marks(LAYOUTS["rows"]) if p in paths] if paths.issuperset(marks(LAYOUTS["rows"])) else list(paths))
    if not layout or "row" not in layout:
        raise ValueError(f"no layout with a row per turn: {turns.columns}")
    at = only(turns, **{layout["id"]: "long", layout["order"]: "long", layout["role"]: "string", layout["text"]: "string"}).toDF("conv_id", "turn", "role", "text")
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ":"), F.lit(MIDDLE))
    loss = F.col("role").eqNullSafe("assistant")
    return (
        at.withColumns({"head": head, "body": escaped(F.col("text"))})
        .withColumn("loss_start", F.length("head").cast("long"))
        .withColumn("loss_end", F.col("loss_start") + F.when(loss, F.length("body")).otherwise(0))
        .select("conv_id", "turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "loss_start", "loss_end", F.coalesce("role", F.lit("")).alias("o_role"), F.coalesce("text", F.lit("")).alias("o_text"))
    )


PIECE = re.compile(rf"{re.escape(OPEN)}((?:[^\\:]|\\.)*){re.escape(MIDDLE)}(.*){re.escape(CLOSE)}\Z", re.DOTALL)


def read_back(piece: str) -> tuple[str, str]:
    m = PIECE.match(piece)
    if not m:
        raise ValueError("not a formatted turn")
    return unescaped(m[1]), unescaped(m[2])


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(pieces: DataFrame) -> DataFrame:
    """Read every conversation back from its formatted pieces, streaming them in order."""

    def run(batches):
        last, state = None, None

        def done():
            return (last[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            rows = []
            for conv, piece, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                if last is None or last[0] != conv:
                    if last is not None:
                        rows.append(done())
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(piece)
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescaped(piece[start:end])
                state[3].update(loss.encode())
                state[0] += 1
                state[2] += len(loss)
                state[4] += len(piece)
            if rows:
                yield batch(DIGEST, *zip(*rows))
        if last is not None:
            yield batch(DIGEST, *zip(*[done()]))

    keyed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "o_role", "o_text")
    return keyed.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = only(table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(format_rows(said.unionByName(hard)))


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + 2 + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + 8)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
