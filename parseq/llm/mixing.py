"""Operator 9 [native]: mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A token budget flows down the tree: among siblings, who can't use up his weighted
share is filled and what is left goes to the other siblings by weight (water filling); only what a whole subtree can't
use reaches the siblings of its ancestor. A leaf takes whole epochs and then a prefix of one more epoch in an order that
the seed and the epoch's number fix.

Everything is DataFrame operations. Tokens are counted once, into a narrow table of ids, leaves and counts. The tree's
windows see one row for each node. A leaf's prefix ends at a hash: sums over 4,096 slices of the hash order say in which slice,
sums over 4,096 slices of that one in which part of it, and only the documents there need an ordered window, so of a
leaf of a billion documents some hundred. What then goes to the documents is one row for each leaf, by broadcast if there
are at most ``SMALL`` leaves, and texts stay where they are.

Defined results: null texts have no tokens and are never chosen; null languages and sources are a group of their own
('?'); nodes without a weight get weight 1, weights are integers above 0; repeated rows count each and are chosen
together, and so do all rows without an id; integer shares are rounded down, so up to one token per node is left over; an
empty table gives an empty result. :func:`mix` carries all columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

DOMAIN = "CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'books' ELSE 'forum' END"
DOMAINS = {"web": 50, "books": 30, "forum": 20}
LANGS = {"en": 60, "de": 15, "fr": 15, "es": 10}
SEED, HEX, SMALL = 17, 3, 100_000


def tokens() -> Column:
    return F.expr(r"cast(size(filter(split(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')) as long)")


def weight(column: str, weights: dict[str, int]) -> Column:
    w = F.lit(1)
    for k, v in weights.items():
        w = F.when(F.col(column) == k, F.lit(int(v))).otherwise(w)
    return w.cast("long")


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).cast("binary"))


def fill(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Water filling among the children of each parent: adds ``share``. Exact integers, so order and engine don't matter."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = w.orderBy((F.col("cap") / F.col("w")), F.col(name))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    steps = nodes.withColumns({"left": F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.sum("w").over(after), "k": F.row_number().over(by)})
    steps = steps.withColumn("short", F.col("cap") * F.col("weights") <= F.col("left") * F.col("w"))
    first = F.min(F.when(~F.col("short"), F.col("k"))).over(w)
    steps = steps.withColumn("first", first)
    at = lambda c: F.max(F.when(F.col("k") == F.col("first"), F.col(c))).over(w)
    steps = steps.withColumns({"r": at("left"), "rw": at("weights")})
    share = F.when(F.col("first").isNull() | (F.col("k") < F.col("first")), F.col("cap")).otherwise(F.expr("r * w div rw"))
    return steps.withColumn("share", share).drop("left", "weights", "k", "short", "first", "r", "rw")


def budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int, domains: dict, langs: dict, sources: dict) -> DataFrame:
    """domain, lang, source, tokens -> the same with ``budget``; the total is share[0] / share[1] of all tokens."""
    leaves = leaves.withColumns({"leaf_cap": F.col("tokens") * max_epochs})
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("leaf_cap").alias("cap"), F.sum("tokens").alias("tokens"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    top = by_domain.withColumns({"total": F.expr(f"sum(tokens) over (partition by 0) * {int(share[0])}L div {int(share[1])}L"), "w": weight("domain", domains)})
    top = fill(top, [], "domain", "total").select("domain", F.col("share").alias("d_budget"))
    mid = by_lang.join(top, "domain").withColumn("w", weight("lang", langs))
    mid = fill(mid, ["domain"], "lang", "d_budget").select("domain", "lang", F.col("share").alias("l_budget"))
    low = leaves.join(mid, ["domain", "lang"]).withColumns({"cap": F.col("leaf_cap"), "w": weight("source", sources)})
    return fill(low, ["domain", "lang"], "source", "l_budget").select("domain", "lang", "source", "tokens", F.col("share").alias("budget"))


LEAF = ["domain", "lang", "source"]


def leaf(domain: str) -> list[Column]:
    return [F.coalesce(F.expr(domain), F.lit("?")).alias("domain"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source")]


def bounded(df: DataFrame) -> DataFrame:
    """A table of leaves, to be sent to all tasks if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _ends(rows: DataFrame, piece: Column) -> DataFrame:
    """rows (leaf, h, n, rest, before) -> leaf, end, rest, before: the piece of the hash order in which a leaf's prefix ends, and
    the tokens before it."""
    sums = rows.groupBy(*LEAF, piece.alias("end")).agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("start"))
    upto = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sums.withColumn("before", F.col("start") + upto - F.col("n")).filter("before <= rest and before + n > rest").select(*LEAF, "end", "rest", "before")


def cutoffs(counts: DataFrame, share: tuple[int, int], max_epochs: int, domains: dict, langs: dict, sources: dict, seed: int, scratch: Scratch) -> DataFrame:
    """counts (doc_id, leaf, n_tokens) -> leaf, full, last: whole epochs, and the hash up to which one more epoch goes."""
    plan = scratch.cut(budgets(counts.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), share, max_epochs, domains, langs, sources).select(*LEAF, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest")))
    rows = counts.join(bounded(plan), LEAF).select(*LEAF, order_key(F.col("full"), seed).alias("h"), F.col("n_tokens").alias("n"), "rest", F.lit(0).cast("decimal(38,0)").alias("before"))
    for level in range(2):
        ends = bounded(scratch.cut(_ends(rows, F.substring("h", 1, HEX * (level + 1)))))
        rows = rows.drop("before", "rest", "end").join(ends, LEAF).filter(F.col("h").startswith(F.col("end")))
    peers = rows.groupBy(*LEAF, "h").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"), F.max("end").alias("end"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Hashes before the last piece are smaller than its own first digits.
    last = peers.withColumn("upto", upto).groupBy(*LEAF).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h")).otherwise(F.col("end"))).alias("last"))
    return scratch.cut(plan.join(last, LEAF).select(*LEAF, "full", "last"))


def _planned(docs: DataFrame, share, max_epochs, domain, domains, langs, sources, seed) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession)
    counts = scratch.cut(docs.select("doc_id", *leaf(domain), tokens().alias("n_tokens")).filter("n_tokens > 0"))
    found = cutoffs(counts, share, max_epochs, domains or DOMAINS, langs or LANGS, sources or {}, seed, scratch)
    scratch.drop_all_but(counts, found)
    return counts, bounded(found)


def _epochs(seed: int) -> Column:
    """One value for each epoch that takes the row."""
    times = F.col("full") + F.when(order_key(F.col("full"), seed) <= F.col("last"), 1).otherwise(0)
    return F.explode(F.expr("sequence(0L, times - 1)")).alias("epoch"), times.cast("long").alias("times")


def picks(docs: DataFrame, share: tuple[int, int] = (6, 10), max_epochs: int = 2, domain: str = DOMAIN, domains: dict | None = None, langs: dict | None = None, sources: dict | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch of each chosen row, once for each epoch that takes it."""
    counts, found = _planned(docs, share, max_epochs, domain, domains, langs, sources, seed)
    epoch, times = _epochs(seed)
    return counts.join(found, LEAF).select("doc_id", *LEAF, "n_tokens", times).filter("times > 0").select("doc_id", *LEAF, "n_tokens", epoch)


def mix(docs: DataFrame, share: tuple[int, int] = (6, 10), max_epochs: int = 2, domain: str = DOMAIN, domains: dict | None = None, langs: dict | None = None, sources: dict | None = None, seed: int = SEED) -> DataFrame:
    """The chosen rows with all columns of ``docs``, and for each ``x`` = (domain, lang, source, n_tokens, epoch), which gets
    underscores at its end as long as ``docs`` has such a name. A row comes once for each epoch that takes it."""
    _, found = _planned(docs, share, max_epochs, domain, domains, langs, sources, seed)
    name = "x"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    whole = docs.filter(worded).select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id"), *leaf(domain), tokens().alias("n_tokens"))
    epoch, times = _epochs(seed)
    out = whole.join(found, LEAF).select("row", *LEAF, "n_tokens", times).filter("times > 0").select("row", *LEAF, "n_tokens", epoch)
    return out.select("row.*", F.struct(*LEAF, "n_tokens", "epoch").alias(name))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks(documents(spark, sf_dir))


def _fill_sql(name: str, source: str, parent: str, budget: str) -> str:
    """Water filling without an order: a child is full if its parent's budget reaches the level that fills it, where every
    sibling has taken its own cap or its weight's part of that level."""
    return f"""
{name}_full AS (SELECT a.*, (SELECT sum(least(b.cap * a.w, b.w * a.cap)) FROM {source} b WHERE b.{parent} = a.{parent}) <= {budget} * a.w AS filled FROM {source} a),
{name} AS (SELECT *, CASE WHEN filled THEN cap ELSE ({budget} - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {parent}), 0)) * w // sum(w) FILTER (NOT filled) OVER (PARTITION BY {parent}) END AS share FROM {name}_full)"""


def _case(column: str, weights: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce({DOMAIN}, '?') AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
t AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, domain || '/' || lang AS parent, sum(n_tokens) AS tokens, sum(n_tokens) * 2 AS cap FROM t GROUP BY ALL),
bd AS (SELECT domain, 1 AS root, sum(cap) AS cap, sum(sum(tokens)) OVER () * 6 // 10 AS total, {_case('domain', DOMAINS)} AS w FROM leaf GROUP BY domain),
{_fill_sql('fd', 'bd', 'root', 'total')},
bl AS (SELECT leaf.domain, lang, sum(leaf.cap) AS cap, any_value(fd.share) AS b_share, {_case('lang', LANGS)} AS w FROM leaf JOIN fd USING (domain) GROUP BY leaf.domain, lang),
{_fill_sql('fl', 'bl', 'domain', 'b_share')},
bs AS (SELECT leaf.domain, leaf.lang, leaf.source, parent, leaf.tokens, leaf.cap, fl.share AS b_share, 1 AS w FROM leaf JOIN fl ON leaf.domain = fl.domain AND leaf.lang = fl.lang),
{_fill_sql('fs', 'bs', 'parent', 'b_share')},
plan AS (SELECT domain, lang, source, share // tokens AS fll, share % tokens AS rest FROM fs),
run AS (SELECT t.*, fll, rest, sum(n_tokens) OVER (PARTITION BY t.domain, t.lang, t.source ORDER BY md5('{SEED}/' || fll::BIGINT || '/' || coalesce(doc_id::VARCHAR, '?'))) AS upto
  FROM t JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, e::BIGINT AS epoch FROM (
  SELECT *, unnest(range(0, (fll + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT)) AS e FROM run)
"""
