"""Mixing sources to target weights with a temperature. DataFrame code only.

Source i holds a share p_i of all tokens (words) and gets the weight p_i ** a, normalised. The exponent ``a`` is
bisected to meet a target: an entropy of the weights, or a limit on how often a source is repeated. A weight is then realised
as a token budget: whole passes over the source, and a last pass cut where the budget ends. Every pass runs
over the blocks of the source in an order of its own, and through each block by document.

The cut is found without sorting a source: tokens are added up by block, blocks by the leading digits of their place,
and only the slice, then the block, in which the budget ends are looked at closely. It is kept as two keys per
source, so that documents are chosen by comparing keys while they are read, and are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostvane.operators.joins import join_checked
from hostvane.session import materialize

BLOCK_DOCS = 256
SLICE_DIGITS = 2  # leading hex digits of a block's place: 256 slices of a pass
POINTS = 15  # exponents tried in one pass over the sources: four bisections at once
PASSES = 9
HIGHEST = 16.0  # exponents are looked for up to here, and up to LAST if that is not enough
LAST = 1024.0
DIGITS = 6  # decimals of the exponent
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``sources``: (source, docs, tokens, weight, quota, full, cut_block, cut_doc); the rest describes the whole."""

    exponent: float
    budget: int
    seed: str
    sources: DataFrame


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def _source(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _doc_key(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _block(doc_key: Column, docs: Column) -> Column:
    return F.conv(F.substring(doc_key, 1, 8), 16, 10).cast("long") % F.ceil(docs / BLOCK_DOCS)


def _place(seed: str, source: Column, epoch: Column, block: Column) -> Column:
    """A block's place in one pass over its source."""
    return F.md5(F.concat_ws("|", F.lit(seed), source, epoch.cast("string"), block.cast("string")))


def _evaluated(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(entropy, most, least repetition at a budget of all tokens) of the weights for each exponent."""
    p = F.col("p")
    parts = []
    for a in exponents:
        parts += [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))]
        parts += [F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1)))]
    row = shares.agg(*[x.alias(f"c{i}") for i, x in enumerate(parts)]).first()
    out = []
    for k, a in enumerate(exponents):
        z, s, most, least = row[4 * k : 4 * k + 4]
        out.append((math.log(z) - a * s / z, most / z, least / z))
    return out


def _bisected(shares: DataFrame, above, low: float, high: float) -> float:
    """The exponent where ``above(entropy, most, least)`` turns from true to false; ``low`` or ``high`` if it never does."""
    for _ in range(PASSES):
        step = (high - low) / (POINTS + 1)
        tried = [low + step * (k + 1) for k in range(POINTS)]
        true = sum(1 for x in _evaluated(shares, tried) if above(*x))  # monotone: a run of true, then false
        low, high = low + step * true, low + step * (true + 1)
    return round((low + high) / 2, DIGITS)


def plan(
    docs: DataFrame,
    evenness: float | None = None,
    entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | str | None = None,
    seed: str = "mix",
) -> Mix:
    """Choose the exponent and the cuts for ``docs`` (doc_id, text, source).

    One target: ``entropy`` in nats; ``evenness``, the part of the way from the corpus' own entropy (0) to equal weights
    (1); or ``max_repeats``, the most even weights that repeat no source more often. ``budget`` is in tokens, or "all"
    for as many as the corpus has; without it the budget is the least at which every document appears at least once.

    An entropy that no exponent up to LAST reaches is refused. Null and empty sources are one source. Sources without tokens stay as they are. Rows repeating a doc_id share their
    fate, so a cut may pass the budget by such rows. An empty table gives an empty plan.
    """
    if sum(x is not None for x in (evenness, entropy, max_repeats)) != 1:
        raise ValueError("give one of evenness, entropy and max_repeats")
    slim = materialize(
        docs.select(
            _doc_key(seed, F.col("doc_id")).alias("doc_key"),
            _source(F.col("source")).alias("source"),
            n_tokens(F.col("text")).cast("long").alias("n"),
        ),
        "mix-documents",
    )
    sources = slim.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    sources = materialize(sources, "mix-sources")
    total, busy = sources.where("tokens > 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    budget = total if budget == "all" else budget
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p"))

    def repeats(most: float, least: float) -> float:
        return most / least if budget is None else most * budget / total

    a = 1.0
    if busy and max_repeats is not None:
        a = _bisected(shares, lambda h, most, least: repeats(most, least) > max_repeats, 0.0, 1.0)
    elif busy:
        wanted = entropy
        if evenness is not None:
            own = _evaluated(shares, [1.0])[0][0]
            wanted = own + evenness * (math.log(busy) - own)
        high = HIGHEST
        while high < LAST and _evaluated(shares, [high])[0][0] > wanted:
            high *= 2
        reach = [_evaluated(shares, [x])[0][0] for x in (high, 0.0)]
        if entropy is not None and not reach[0] - 1e-9 <= wanted <= reach[1] + 1e-9:
            raise ValueError(f"entropy must be between {reach[0]} and {reach[1]} for these sources, got {wanted}")
        a = _bisected(shares, lambda h, most, least: h > wanted, 0.0, high)
    z, size = 1.0, 0
    if busy:
        z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
        least = _evaluated(shares, [a])[0][2]
        size = budget if budget is not None else math.ceil(total / least - 1e-6)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(z))
    quota = F.floor(weight * F.lit(float(size)) + F.lit(1e-6))
    full = F.expr("quota div tokens")
    if budget is None:  # rounding must not cost the source that sets the budget its last token
        quota = F.greatest(quota, F.col("tokens"))
    weighed = sources.withColumn("weight", F.coalesce(weight, F.lit(0.0))).withColumn("quota", F.coalesce(quota, F.lit(0)))
    weighed = weighed.withColumn("full", F.when(F.col("tokens") > 0, full).otherwise(F.lit(1)).cast("long"))
    weighed = materialize(weighed.withColumn("rest", F.greatest(F.col("quota") - F.col("full") * F.col("tokens"), F.lit(0))), "mix-weights")
    cut = _cuts(slim, weighed, seed)
    done = join_checked(weighed.drop("rest"), cut, ["source"], "left")
    return Mix(a, size, seed, materialize(done, "mix-plan"))


def _crossing(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """Of rows (source, rest, size, ...), the one in which the running sum passes ``rest``, and what is left there."""
    so_far = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("end", F.sum("size").over(so_far))
    return summed.where("end > rest AND end - size <= rest").withColumn("rest", F.col("rest") - (F.col("end") - F.col("size")))


def _cuts(slim: DataFrame, weighed: DataFrame, seed: str) -> DataFrame:
    """(source, cut_block, cut_doc): in the last pass, blocks before ``cut_block`` and its documents up to ``cut_doc``."""
    cut = weighed.where("rest > 0").select("source", "docs", "full", "rest")
    joined = join_checked(slim, cut, ["source"], stored=False).withColumn("block", _block(F.col("doc_key"), F.col("docs")))
    placed = joined.withColumn("place", _place(seed, F.col("source"), F.col("full"), F.col("block")))
    blocks = materialize(
        placed.groupBy("source", "rest", "place").agg(F.sum("n").alias("size")).withColumn(
            "slice", F.substring("place", 1, SLICE_DIGITS)
        ),
        "mix-blocks",
    )
    slices = blocks.groupBy("source", "rest", "slice").agg(F.sum("size").alias("size"))
    slices = _crossing(slices, ["source"], "slice").select("source", "slice", "rest")
    inside = join_checked(blocks.drop("rest"), slices, ["source", "slice"])
    found = _crossing(inside, ["source"], "place").select("source", "place", "rest")
    # A block holds a bounded number of documents, and one block of a source is looked at.
    last = join_checked(placed.select("source", "place", "doc_key", F.col("n").alias("size")), found, ["source", "place"])
    run = Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = last.withColumn("end", F.sum("size").over(run)).groupBy("source", "place").agg(
        F.max(F.when(F.col("end") <= F.col("rest"), F.col("doc_key"))).alias("cut_doc")
    )
    return fits.select("source", F.col("place").alias("cut_block"), F.coalesce("cut_doc", F.lit("")).alias("cut_doc"))


def realise(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` as often as the plan says: all its columns in ``row``, and source, epoch, block, place, doc_key.

    Read one source in the order (epoch, place, doc_key) for its permuted passes.
    """
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _source(F.col("source")).alias("source"),
        _doc_key(mix.seed, F.col("doc_id")).alias("doc_key"),
    )
    joined = join_checked(held, mix.sources, ["source"], stored=True).withColumn("block", _block(F.col("doc_key"), F.col("docs")))
    last = _place(mix.seed, F.col("source"), F.col("full"), F.col("block"))
    extra = (last < F.col("cut_block")) | ((last == F.col("cut_block")) & (F.col("doc_key") <= F.col("cut_doc")))
    copies = F.col("full") + F.when(extra, 1).otherwise(0)
    repeated = joined.withColumn("copies", copies).where("copies > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
    place = _place(mix.seed, F.col("source"), F.col("epoch"), F.col("block"))
    return repeated.select("row", "source", "epoch", "block", place.alias("place"), "doc_key")


def mixed(docs: DataFrame, **target) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, place: one row per document and pass that the budget reaches."""
    slim = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    out = realise(slim, plan(docs, **target))
    return out.select("row.doc_id", "source", "row.n_tokens", "epoch", "block", "place")


def oracle_sql(evenness: float, seed: str = "mix") -> str:
    """DuckDB SQL for ``mixed`` with that evenness and a budget of all tokens."""
    return f"""
WITH RECURSIVE slim AS (
  SELECT doc_id, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS doc_key, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n
  FROM documents
), sources AS (SELECT source, count(*) AS docs, sum(n) AS tokens FROM slim GROUP BY source),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM sources) AS p FROM sources WHERE tokens > 0),
wanted AS (SELECT h + {evenness} * (ln(k) - h) AS goal FROM (SELECT -sum(p * ln(p)) AS h, count(*) AS k FROM shares)),
search(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, {HIGHEST}::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN h > goal THEN mid ELSE low END, CASE WHEN h > goal THEN high ELSE mid END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid,
               (SELECT ln(sum(p ** ((low + high) / 2))) - (low + high) / 2 * sum(p ** ((low + high) / 2) * ln(p))
                       / sum(p ** ((low + high) / 2)) FROM shares) AS h
        FROM search), wanted
  WHERE step < 40
), chosen AS (SELECT round((low + high) / 2, {DIGITS}) AS a FROM search ORDER BY step DESC LIMIT 1),
quotas AS (
  SELECT source, docs, tokens, CASE WHEN tokens > 0 THEN CAST(floor((tokens / t) ** a / z * t + 1e-6) AS BIGINT) ELSE 0 END AS quota
  FROM sources, chosen, (SELECT sum(tokens) AS t FROM sources), (SELECT sum(p ** (SELECT a FROM chosen)) AS z FROM shares)
), passes AS (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole FROM quotas
), placed AS (
  SELECT doc_id, source, n, doc_key, whole, CASE WHEN tokens > 0 THEN quota - whole * tokens ELSE 0 END AS rest,
         CAST('0x' || substr(doc_key, 1, 8) AS BIGINT) % CAST(ceil(docs / {BLOCK_DOCS}) AS BIGINT) AS block
  FROM slim JOIN passes USING (source)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '{seed}', source, whole, block)), doc_key) AS upto
  FROM placed
), counted AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM summed),
copied AS (SELECT *, unnest(range(CAST(copies AS BIGINT))) AS epoch FROM counted)
SELECT doc_id, source, n AS n_tokens, epoch, block, md5(concat_ws('|', '{seed}', source, epoch, block)) AS place FROM copied
"""
