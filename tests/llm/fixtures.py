"""Small tables with the cases that operators must bear, and helpers."""

import random

import duckdb

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, marks int, found string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(("ta", "ro", "mi", "el", "on", "ü")) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def hard_documents(seed=5):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, repeated rows; extra columns clash with
    names that the operators use."""
    rng = random.Random(seed)
    shared = " ".join(sentence(rng, 12) for _ in range(6))
    texts = [None, "", "   \n\t ", "one two", "a b c", "x" * 150, "ab" * 300, "\x00" * 250 + "end", "Of " * 200]
    for _ in range(25):
        body = "\n".join(" ".join(sentence(rng, rng.randint(3, 14)) for _ in range(4)) for _ in range(rng.randint(1, 6)))
        texts.append(body)
        if rng.random() < 0.4:
            texts.append(body.replace("ta", "TA", 1))
        if rng.random() < 0.3:
            texts.append(body)
        if rng.random() < 0.4:
            words = body.split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        if rng.random() < 0.3:
            texts.append(body[: len(body) // 2] + shared + body[len(body) // 2 :])
    texts.append("".join(rng.choice("abcdefgh \n") for _ in range(30_000)) + shared + shared)
    ids = rng.sample(range(-5, 500), len(texts))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", None]), None if t is None else len(t), "k", 3, "f") for i, t in zip(ids, texts)]
    return rows + rows[9:12] + [(None, texts[9], "en", "src0", 1, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con


def compared(df):
    """Rows by value; whole numbers are equal as integers and as floats, which pandas makes of those with nulls."""
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(repr(plain(v)) for v in r) for r in df.where(df.notna(), None).itertuples(index=False))
