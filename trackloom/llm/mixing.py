"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations. DataFrame functions only.

A source's share of tokens, to the power of an exponent between 0 and 1 and normalised, is its weight: 1 keeps the shares, 0 makes
sources equal. The exponent is the largest at which the weights' entropy reaches ``evenness`` of its maximum, or, if that repeats some
source more than ``repeats`` times, the smallest that doesn't. Both are found by bisection, four halvings to a pass: a pass evaluates the
fifteen midpoints that the next four halvings could visit, over the table of sources.

A weight times the budget (``budget`` times all tokens) is a source's quota of tokens, which is realised as passes over the source: each
is a permutation of its blocks, and within a block of its documents. Blocks hold about ``block_tokens`` tokens and ``block_docs``
documents each, dealt by a hash, so that a source of any size is spread over as many blocks as it needs; whole passes give every document
a copy, and the last pass stops where the quota is used up. Only the block in which it stops is ordered document by document. The place
is kept as two hashes, the block's and the document's, one row for a source: documents are chosen by comparing their own hashes with
their source's row, which is broadcast to them if there are at most ``FEW`` sources, and joined otherwise.

Tokens are runs without ASCII white space. A null source is the source of the empty name. Null and empty texts have no tokens and use no
quota; they are taken or not by the place of their hash, and a source without any tokens keeps one copy of each document. Documents with
the same id have the same place in the order and stand or fall together, and so do documents without an id that have the same text. A
single source gets all the weight. An empty table gives no rows; further columns stay, except those of the names of the columns added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed, quoted

HALVINGS, PER_PASS = 32, 4
#: Sources whose rows (some hundred bytes each) are broadcast.
FEW = 100_000
ADDED = ("mix_tokens", "mix_weight", "mix_copies")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(document: Column, passes: Column) -> Column:
    return F.md5(F.concat_ws(":", document.cast("string"), passes.cast("string")).cast("binary"))


def number(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def measures(sources: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """(entropy over its maximum, most repeats of a source) at each exponent, in one pass over the sources with tokens."""
    some = sources.where("tokens > 0").select((F.col("tokens") / F.col("all_tokens")).alias("p"))
    each = some.withColumn("x", F.explode(F.array(*(F.lit(float(x)) for x in exponents))))
    q = F.pow("p", "x")
    # with Z the sum of q: entropy = ln Z - (sum of q ln q) / Z; repeats = budget / Z * max(q / p)
    sums = each.groupBy("x").agg(F.sum(q).alias("z"), F.sum(q * F.log(q)).alias("s"), F.max(q / F.col("p")).alias("r"), F.count("*").alias("n"))
    rows = sums.select("x", F.when(F.col("n") > 1, (F.log("z") - F.col("s") / F.col("z")) / F.log("n")).otherwise(1.0).alias("h"), (budget * F.col("r") / F.col("z")).alias("r")).collect()
    return {r.x: (r.h, r.r) for r in rows}


def bisected(sources: DataFrame, evenness: float, repeats: float, budget: float) -> float:
    """The exponent; one row for each exponent tried comes to the driver."""
    ends = measures(sources, [0.0, 1.0], budget)
    if not ends:
        return 1.0
    tests = {"even": lambda m: m[0] >= evenness, "often": lambda m: m[1] > repeats}  # both hold at small exponents only
    found = {}
    spans = {}
    for name, holds in tests.items():
        if holds(ends[1.0]):
            found[name] = 1.0
        elif not holds(ends[0.0]):
            found[name] = 0.0
        else:
            spans[name] = (0.0, 1.0)
    for _ in range(HALVINGS // PER_PASS if spans else 0):
        steps = 1 << PER_PASS
        grid = {name: [a + (b - a) * i / steps for i in range(1, steps)] for name, (a, b) in spans.items()}
        at = measures(sources, sorted({x for g in grid.values() for x in g}), budget)
        for name, (a, b) in spans.items():
            low, high = 0, steps
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if tests[name](at[grid[name][middle - 1]]) else (low, middle)
            spans[name] = (a + (b - a) * low / steps, a + (b - a) * high / steps)
    even = found.get("even", spans.get("even", (0.0,))[0])
    often = found.get("often", spans.get("often", (0.0, 0.0))[-1])
    return max(even, often)


def identity(doc_id: Column, text: Column) -> Column:
    """What places a document: its id, or for want of one its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def mixed(docs: DataFrame, evenness: float = 0.95, repeats: float = 2.0, budget: float = 1.0, block_tokens: int = 1 << 20, block_docs: int = 4096, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with the number of tokens, the source's weight and the number of times each document is taken, under the names ``added``."""
    source, text = F.coalesce(quoted("source"), F.lit("")), quoted("text")
    narrow = checkpointed(docs.select(source.alias("source"), n_tokens(text).alias("tokens"), identity(quoted("doc_id"), text).alias("doc")))
    totals = checkpointed(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    about = totals.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sources")).first()
    few = about.sources <= FEW
    sources = totals.withColumn("all_tokens", F.lit(about.tokens or 0).cast("long"))
    exponent = bisected(sources, evenness, repeats, budget)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all_tokens"), F.lit(exponent))).otherwise(0.0)
    scale = sources.agg(F.coalesce(F.sum(power), F.lit(0.0)).alias("scale")).first().scale
    planned = (
        sources.withColumn("weight", power / scale if scale else F.lit(0.0))
        .withColumn("quota", F.floor(budget * F.col("all_tokens") * F.col("weight") + 0.5).cast("long"))
        .select(
            "source", "weight", F.expr("CASE WHEN tokens > 0 THEN quota div tokens ELSE 1 END").cast("long").alias("passes"),
            F.expr("CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END").cast("long").alias("rest"),
            F.greatest(F.ceil(F.greatest(F.col("tokens"), F.lit(1)) / block_tokens), F.ceil(F.col("docs") / block_docs)).cast("long").alias("n_blocks"),
        )
    )
    planned = checkpointed(planned)
    told = lambda rows, by_source: rows.join(F.broadcast(by_source) if few else by_source, "source")
    block_of = lambda doc: F.pmod(number(F.md5(F.concat(F.lit("block:"), doc).cast("binary"))), F.col("n_blocks"))
    dealt = told(narrow.where("tokens > 0"), planned.select("source", "passes", "rest", "n_blocks")).withColumn("block", block_of(F.col("doc")))
    blocks = dealt.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("block_key", order_key(F.col("block"), F.col("passes")))
    shuffled = Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("end", F.sum("tokens").over(shuffled)).withColumn("start", F.col("end") - F.col("tokens"))
    stops = checkpointed(blocks.where("start < rest").groupBy("source").agg(F.max(F.struct("block_key", "block", "start", "end", "rest")).alias("last")).select("source", "last.*"))
    cut = told(dealt.select("source", "block", "tokens", "doc", "passes"), stops.where("end > rest").select("source", F.col("block").alias("cut"), "start", "rest")).where("block = cut")
    by_key = cut.groupBy("source", "start", "rest", order_key(F.col("doc"), F.col("passes")).alias("doc_key")).agg(F.sum("tokens").alias("tokens"))
    inside = Window.partitionBy("source").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, 0)
    places = by_key.withColumn("upto", F.col("start") + F.sum("tokens").over(inside)).groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("doc_key"))).alias("last_doc"))
    plan = checkpointed(
        planned.join(stops.select("source", "block_key", F.col("block").alias("last_block"), (F.col("end") > F.col("rest")).alias("is_cut")), "source", "left").join(places, "source", "left")
        .select("source", F.struct("weight", "passes", "n_blocks", "block_key", "last_block", "is_cut", "last_doc").alias("plan"))
    )
    kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    rows = docs.select(source.alias("source"), n_tokens(text).alias("tokens"), identity(quoted("doc_id"), text).alias("doc"), F.struct(*map(quoted, kept)).alias("row"))
    found = told(rows, plan).select("row", "tokens", "doc", "plan.*").withColumn("block", block_of(F.col("doc")))
    own, last = F.struct(order_key(F.col("block"), F.col("passes")).alias("k"), F.col("block").alias("b")), F.struct(F.col("block_key").alias("k"), F.col("last_block").alias("b"))
    whole = (own < last) | ((own == last) & ~F.col("is_cut"))
    taken = F.coalesce(whole | ((own == last) & (order_key(F.col("doc"), F.col("passes")) <= F.col("last_doc"))), F.lit(False)) & F.col("block_key").isNotNull()
    return found.select(
        *(F.col("row").getField(c).alias(c) for c in kept),
        *(x.alias(a) for x, a in zip((F.col("tokens"), F.round("weight", 9), F.col("passes") + taken.cast("long")), added, strict=True)),
    )


def oracle(evenness: float = 0.95, repeats: float = 2.0, budget: float = 1.0, block_tokens: int = 1 << 20, block_docs: int = 4096) -> str:
    """The same in DuckDB's SQL."""
    z, h = "list_sum([pow(p, {x}) for p in ps])", "list_sum([pow(p, {x}) * ln(pow(p, {x})) for p in ps])"
    even = f"(CASE WHEN len(ps) > 1 THEN (ln({z}) - {h} / {z}) / ln(len(ps)) ELSE 1 END >= {evenness})"
    often = f"({budget} * list_max([pow(p, {{x}}) / p for p in ps]) / {z} > {repeats})"

    def key(document: str, passes: str) -> str:
        return f"md5({document} || ':' || {passes})"

    def step(test: str, low: str, high: str) -> str:
        holds = test.format(x=f"(({low} + {high}) / 2)")
        return f"CASE WHEN {holds} THEN ({low} + {high}) / 2 ELSE {low} END, CASE WHEN {holds} THEN {high} ELSE ({low} + {high}) / 2 END"

    return f"""
WITH RECURSIVE named AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS doc, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM named GROUP BY source),
everything AS (SELECT CAST(sum(tokens) AS BIGINT) AS all_tokens FROM totals),
given AS (SELECT list(CAST(tokens AS DOUBLE) / all_tokens) AS ps FROM totals, everything WHERE tokens > 0),
search AS (
  SELECT 0 AS i, ps, CASE WHEN {even.format(x='1.0')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, CASE WHEN {even.format(x='0.0')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b,
         CASE WHEN {often.format(x='1.0')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c, CASE WHEN {often.format(x='0.0')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM given
  UNION ALL
  SELECT i + 1, ps, {step(even, 'a', 'b')}, {step(often, 'c', 'd')} FROM search WHERE i < {HALVINGS}),
found AS (SELECT greatest(a, d) AS exponent FROM search WHERE i = {HALVINGS}),
powers AS (SELECT source, tokens, docs, all_tokens, CASE WHEN tokens > 0 THEN pow(CAST(tokens AS DOUBLE) / all_tokens, exponent) ELSE 0 END AS power FROM totals, everything, found),
weights AS (SELECT *, CASE WHEN sum(power) OVER () > 0 THEN power / sum(power) OVER () ELSE 0 END AS weight FROM powers),
quotas AS (SELECT *, CAST(floor({budget} * all_tokens * weight + 0.5) AS BIGINT) AS quota FROM weights),
planned AS (
  SELECT source, weight, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest,
         CAST(greatest(ceil(greatest(tokens, 1) / {block_tokens}.0), ceil(docs / {block_docs}.0)) AS BIGINT) AS n_blocks FROM quotas),
dealt AS (
  SELECT doc_id, doc, named.source, n_tokens, weight, passes, rest, CAST('0x' || substr(md5('block:' || doc), 1, 8) AS BIGINT) % n_blocks AS block
  FROM named JOIN planned ON named.source = planned.source),
blocks AS (SELECT source, block, passes, rest, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM dealt WHERE n_tokens > 0 GROUP BY ALL),
placed AS (SELECT *, {key('block', 'passes')} AS block_key, sum(tokens) OVER (PARTITION BY source ORDER BY {key('block', 'passes')}, block ROWS UNBOUNDED PRECEDING) AS stop FROM blocks),
reached AS (SELECT source, max(ROW(block_key, block, stop - tokens, stop)) AS r FROM placed WHERE stop - tokens < rest GROUP BY source),
ends AS (SELECT source, struct_extract(r, 1) AS block_key, struct_extract(r, 2) AS block, struct_extract(r, 3) AS start, struct_extract(r, 4) AS stop FROM reached),
ordered AS (
  SELECT dealt.*, {key('dealt.block', 'dealt.passes')} AS own_key, ends.block_key, ends.block AS last_block, stop,
         start + CASE WHEN dealt.block = ends.block THEN sum(n_tokens) OVER (PARTITION BY dealt.source, dealt.block ORDER BY {key('doc', 'dealt.passes')}) END AS upto
  FROM dealt LEFT JOIN ends ON dealt.source = ends.source),
lasts AS (SELECT source, max(CASE WHEN n_tokens > 0 AND block = last_block AND upto <= rest THEN {key('doc', 'passes')} END) AS last_doc FROM ordered GROUP BY source)
SELECT doc_id, ordered.source, n_tokens, round(weight, 9) AS weight,
       CAST(passes + CASE WHEN block_key IS NULL THEN 0 WHEN own_key < block_key OR (own_key = block_key AND block < last_block) THEN 1
         WHEN block = last_block AND (stop <= rest OR coalesce({key('doc', 'passes')} <= last_doc, false)) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ordered JOIN lasts ON ordered.source = lasts.source
"""
