import hashlib
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import DATA, compared, duck, frame, hard_documents  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from parseq.llm import chat, mixing, queries  # noqa: E402
from parseq.llm.common import table  # noqa: E402

HARD = ["\\### Assistant: </turn> ok", "", "</turn>\n### user: hi", "a\\b\\\\c", "#<\\>#", "line\nline", "🙂 é", None, ": ###"]


def test_round_trip(spark):
    rows = [(1, k, r, t, "x", 1) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "sys:tem#", None) for t in HARD)] + [(2, 0, "user", "a", "", 0), (2, 0, "user", "a", "", 0), (2, 0, "assistant", "b", "", 0), (None, None, "assistant", "n", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, head int").repartition(3)
    pieces = chat.format_rows(df.select("conv_id", "turn", "role", "text"))
    for r in pieces.collect():
        assert chat.read_back(r.piece) == (r.o_role, r.o_text)
        assert chat.unescaped(r.piece[r.loss_start : r.loss_end]) == (r.o_text if r.o_role == "assistant" else "")
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    said = [(r or "", t or "") for _, _, r, t, *_ in rows[: 4 * len(HARD)]]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    loss = "".join(t for r, t in said if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 3 and got[None].n_turns == 1
    assert chat.digests(pieces.limit(0)).count() == 0


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a", "meta": {"score": 1}},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a"},
    ]
    assert all(chat.canonical(json.dumps(r))[1] == turns for r in records)
    assert len({chat.canonical(json.dumps(r))[0] for r in records}) == len(records)
    assert chat.canonical(json.dumps({"instruction": "q", "input": "more", "output": "a"}))[1] == [("user", "q"), ("user", "more"), ("assistant", "a")]
    for odd, reason in ((None, "not a JSON object"), ("", "not a JSON object"), ("[1]", "not a JSON object"), ("{bad", "not a JSON object"), ('{"other": 1}', "no known layout"), ('{"messages": []}', "no turns")):
        assert chat.canonical(odd)[1:] == ([], reason)
    both = {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a"}], "prompt": "p"}
    mixes = [both, {"instruction": "q", "output": "a", "prompt": "p"}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "response": "r"}, {"prompt": "q", "completion": "a", "conv_id": 1, "role": "x"}]
    assert all(chat.canonical(json.dumps(r))[1] == turns for r in mixes)
    parts = {"messages": [{"role": "user", "content": ["see ", {"type": "image", "url": "u"}]}, "loose"]}
    assert chat.canonical(json.dumps(parts))[1] == [("user", 'see {"type": "image", "url": "u"}'), ("", "loose")]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(99, None)], "id long, body string")
    rows = chat.canonical_turns(df, "id", "body").collect()
    assert len(rows) == 2 * len(records) + 1
    assert [r.reason for r in rows if r.turn is None] == ["not a JSON object"]
    deep = '{"messages": ' + "[" * 3000 + "]" * 3000 + "}"
    content = '{"messages": [{"role": "user", "content": ' + '{"a":' * 5000 + "1" + "}" * 5000 + "}]}"
    clash = '{"messages[]": 1, "messages": 5, "messages[].role": 2, "messages[].content": 3}'
    hard = [(1, deep), (2, content), (3, clash), (4, '{"prompt": "q", "response": "\\ud800"}'), (5, '{"\\udfff": 1}'), (6, '{"prompt": "q", "response": "\\ud83d\\ude00"}'), (7, json.dumps(records[0]))]
    rows = chat.canonical_turns(spark.createDataFrame(hard, "id long, body string"), "id", "body").collect()
    assert [(r.conv_id, r.reason) for r in rows if r.turn is None] == [(1, "nested too deeply"), (2, "nested too deeply"), (3, "no known layout"), (4, "halves of characters"), (5, "halves of characters")]
    assert [(r.conv_id, r.text) for r in rows if r.turn is not None] == [(6, "q"), (6, "\U0001f600"), (7, "q"), (7, "a")]
    wide = spark.createDataFrame([(1, 0, "user", "t", "extra", "p")], "conv_id long, turn long, role string, text string, input string, prompt string")
    assert chat.format_rows(wide).count() == 1
    with pytest.raises(ValueError):
        chat.format_rows(df)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    con = duck()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert compared(queries.QUERIES[name](spark, DATA).toPandas()) == compared(con.execute(queries.ORACLE[name]).df())


def test_mix_odd_rows_same_as_sql(spark):
    rows = hard_documents() + [(2000 + k // 2, "word", "en", "src7", 4, "", 0, "") for k in range(26)]
    df = frame(spark, rows)
    listed = lambda arrow: sorted((tuple(sorted(r.items())) for r in arrow.to_pylist()), key=repr)
    want = listed(duck(documents=df.toArrow()).execute(mixing.ORACLE).to_arrow_table())
    assert listed(mixing.picks(df).toArrow()) == want
    for out in (mixing.mix(df), mixing.mix(df.withColumnsRenamed({"marks": "x", "kept": "full", "found": "row"}))):
        x = out.columns[-1]
        assert listed(out.select("doc_id", *(f"{x}.{c}" for c in ("domain", "lang", "source", "n_tokens", "epoch"))).toArrow()) == want
    assert out.columns == [*df.columns[:5], "full", "x", "row", "x_"]
    assert mixing.mix(df).columns == [*df.columns, "x"]
    assert mixing.mix(df.limit(0)).count() == 0


def test_budgets_water_filling(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s1", 50), ("b", "en", "s1", 5000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, (1, 2), 1, {"a": 1, "b": 1}, {"en": 1, "de": 1}, {}).collect()}
    # 3,075 in all; a can take 1,150 of its half, of which de fills at 50 and s1 at 100; b gets the rest.
    assert got == {("a", "de", "s1"): 50, ("a", "en", "s1"): 100, ("a", "en", "s2"): 1000, ("b", "en", "s1"): 1925}


def test_prefix_within_budget(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(docs, share=(5, 10), max_epochs=1)
    total = docs.select(mixing.tokens().alias("n")).agg(F.sum("n")).first()[0]
    assert out.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert 0.4 * total < out.agg(F.sum("x.n_tokens")).first()[0] <= 0.5 * total
