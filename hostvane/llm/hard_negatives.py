"""Hard negatives: rows of another label that score just below an anchor's positives, by segment summary filtering.

A vector's components are whole numbers; a score is an inner product. Every vector is stored with summaries: the
mean and the deviation of each of a few segments of its components, and of finer ones. Over a segment of m components, the
product of two vectors lies between m times the product of their means plus or minus m times the product of their deviations.
Sums of these bounds tell whether a row can still be among an anchor's first ones; rows that can are bounded again by the
finer segments, and only what is left is scored exactly.

Anchors are taken in blocks of a bounded number, and every block is compared with all rows where these lie: each task keeps
the first few rows per anchor and label rule, and only those are shuffled. One pass finds the positives, a second
one, which knows the positives' scores, the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.llm.workers import shared
from hostvane.operators.joins import join_checked
from hostvane.operators.toprows import RANK, top_rows
from hostvane.session import materialize

SEGMENTS = (4, 16)  # of a vector, coarse and fine
POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
BLOCK_ANCHORS = 8192
PAIRS = 1 << 21  # bounded or scored at once
EXACT = 2.0**53  # sums below are exact in doubles
NONE = np.iinfo(np.int64).min

SCHEMA = "row long, vec_id long, label long, anchor boolean, v array<long>, means array<double>, deviations array<double>"


def cuts_of(size: int) -> list[np.ndarray]:
    """First components of the segments at each level."""
    return [np.unique(np.arange(min(n, size)) * size // min(n, size)) for n in SEGMENTS]


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the segments of all levels, side by side."""
    wide, means, deviations = v.astype(np.float64), [], []
    for cuts in cuts_of(v.shape[1]):
        size = np.diff(np.append(cuts, v.shape[1]))
        mean = np.add.reduceat(wide, cuts, axis=1) / size
        rest = wide - np.repeat(mean, size, axis=1)
        means.append(mean)
        deviations.append(np.sqrt(np.add.reduceat(rest * rest, cuts, axis=1) / size))
    return np.hstack(means), np.hstack(deviations)


def stored(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` (vec_id, label, anchor, vector of whole numbers) with their summaries, written once.

    Shorter vectors are filled up with zeros to the longest one's size.
    """
    size = max(vectors.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    slim = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "vector")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            n = batch.num_rows
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            v = np.zeros((n, size), np.int64)
            v[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            means, deviations = summaries(v)
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), x.reshape(-1)) for x in (v, means, deviations)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], ["row", "vec_id", "label", "anchor", "v", "means", "deviations"])

    return materialize(slim.mapInArrow(emit, SCHEMA), "summaries")


@dataclass
class Rows:
    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Rows:
        def matrix(name: str) -> np.ndarray:
            column = table.column(name)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

        plain = [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("row", "vec_id", "label")]
        return cls(*plain, *map(matrix, ("v", "means", "deviations")))

    def take(self, which) -> Rows:
        return Rows(*(x[which] for x in (self.row, self.vec_id, self.label, self.v, self.means, self.deviations)))


def levels(size: int) -> list[tuple[slice, np.ndarray]]:
    """(columns of the summaries, components of each segment) of each level."""
    out, at = [], 0
    for cuts in cuts_of(size):
        out.append((slice(at, at + len(cuts)), np.diff(np.append(cuts, size)).astype(np.float64)))
        at += len(cuts)
    return out


def bounds(a: Rows, x: Rows, level: tuple[slice, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest score) of each pair (anchors x rows) from one level of summaries, rounding allowed for."""
    part, size = level
    centre = (a.means[:, part] * size) @ x.means[:, part].T
    radius = (a.deviations[:, part] * size) @ x.deviations[:, part].T
    sizes = [np.sqrt(((r.means[:, part] ** 2 + r.deviations[:, part] ** 2) * size).sum(axis=1)) for r in (a, x)]
    radius += np.outer(sizes[0], sizes[1]) * 1e-12 + 1e-6
    return centre - radius, centre + radius


def scores(a: Rows, x: Rows, which_a: np.ndarray, which_x: np.ndarray) -> np.ndarray:
    """Exact scores of pairs; beyond 64 bits they are refused."""
    most = float(np.abs(a.v).max(initial=0)) * float(np.abs(x.v).max(initial=0)) * max(a.v.shape[1], 1)
    if most >= 2.0**62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    kind = np.float64 if most < EXACT else np.int64
    left, right, out = a.v.astype(kind), x.v.astype(kind), np.empty(len(which_a), np.int64)
    step = max(1, PAIRS // max(a.v.shape[1], 1))
    for k in range(0, len(out), step):
        out[k : k + step] = np.einsum("ij,ij->i", left[which_a[k : k + step]], right[which_x[k : k + step]])
    return out


class Best:
    """The first ``k`` rows of each question, by score and vec_id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.question, self.score, self.vec_id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.bar = np.full(questions, NONE)  # score of the k-th row

    def add(self, question: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(question):
            return
        parts = [np.concatenate(p) for p in zip((self.question, self.score, self.vec_id, self.row), (question, score, vec_id, row))]
        order = np.lexsort((parts[3], parts[2], -parts[1], parts[0]))
        parts = [p[order] for p in parts]
        first = np.flatnonzero(np.append(True, parts[0][1:] != parts[0][:-1]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.question, self.score, self.vec_id, self.row = (p[place < self.k] for p in parts)
        last = place == self.k - 1
        self.bar[parts[0][last]] = parts[1][last]


def _refined(a: Rows, x: Rows, alive: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that are alive under the bounds of every level; rows without one are not looked at again."""
    ways = levels(a.v.shape[1])
    able = alive(*bounds(a, x, ways[0]))
    for way in ways[1:]:
        some = np.flatnonzero(able.any(axis=0))
        if not len(some):
            break
        finer = alive(*bounds(a, x.take(some), way), some) if len(some) < able.shape[1] else alive(*bounds(a, x, way))
        able[:, some] &= finer
    return np.nonzero(able)


def find_positives(a: Rows, best: Best, x: Rows) -> None:
    """Rows of the anchor's label other than the anchor itself."""
    for label in np.intersect1d(a.label, x.label):
        mine, own = np.flatnonzero(a.label == label), np.flatnonzero(x.label == label)
        step = max(1, PAIRS // len(mine))
        for k in range(0, len(own), step):
            these = own[k : k + step]
            sub, rows = a.take(mine), x.take(these)
            bar = best.bar[mine].astype(np.float64)[:, None]
            one, two = _refined(sub, rows, lambda low, high, some=None, bar=bar: high >= bar)
            other = sub.row[one] != rows.row[two]
            one, two = one[other], two[other]
            score = scores(sub, rows, one, two)
            enough = score >= best.bar[mine[one]]
            best.add(mine[one][enough], score[enough], rows.vec_id[two][enough], rows.row[two][enough])


def find_negatives(a: Rows, low: np.ndarray, high: np.ndarray, best: Best, x: Rows) -> None:
    """Rows of other labels with scores from ``low`` to ``high`` (anchors x positives); question a * positives + p."""
    wanted = low.shape[1]
    step = max(1, PAIRS // max(len(a.row), 1))
    for k in range(0, len(x.row), step):
        rows = x.take(slice(k, k + step))
        floor = np.maximum(low, best.bar.reshape(low.shape))

        def alive(least: np.ndarray, greatest: np.ndarray, some=None) -> np.ndarray:
            label = rows.label if some is None else rows.label[some]
            able = np.zeros(least.shape, dtype=bool)
            for p in range(wanted):
                able |= (greatest >= floor[:, p : p + 1]) & (least <= high[:, p : p + 1])
            return able & (a.label[:, None] != label)

        one, two = _refined(a, rows, alive)
        score = scores(a, rows, one, two)
        for p in range(wanted):
            fits = (score >= floor[one, p]) & (score <= high[one, p])
            best.add(one[fits] * wanted + p, score[fits], rows.vec_id[two][fits], rows.row[two][fits])


def _search(given: Callable[[], tuple], k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, low, high = given()
        best = Best(len(a.row) * (1 if low is None else low.shape[1]), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            if low is None:
                find_positives(a, best, Rows.of(batch))
            else:
                find_negatives(a, low, high, best, Rows.of(batch))
        arrays = [pa.array(x, pa.int64()) for x in (best.question, best.score, best.vec_id, best.row)]
        yield pa.RecordBatch.from_arrays(arrays, ["question", "score", "vec_id", "row"])

    return emit


def _first(spark: SparkSession, rows: DataFrame, given: tuple, k: int, label: str) -> DataFrame:
    """(question, score, vec_id, row, _rank): the first ``k`` rows of each question over all tasks."""
    found = rows.mapInArrow(_search(shared(spark, given), k), "question long, score long, vec_id long, row long")
    return materialize(top_rows(found, ["question"], [F.desc("score"), F.asc("vec_id"), F.asc("row")], k), label)


def mine(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: (vec_id, label, anchor, vector of whole numbers); rows with a null among vec_id, label and vector
    take no part. A positive is one of the first rows of the anchor's label, by score and then smaller vec_id; its negatives are the first
    rows of other labels with scores between ``low_percent`` and ``high_percent`` of the positive's. Rows that repeat a vec_id are rows
    of their own. Anchors without positives, and positives without negatives, give no rows.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"))
    anchors = rows.where("anchor")
    n = -(-anchors.count() // block_anchors)
    out = None
    for block in range(n):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == block) if n > 1 else anchors
        table = own.drop("anchor").orderBy("row").toArrow()  # about block_anchors rows
        if not table.num_rows:
            continue
        a = Rows.of(table)
        close = _first(spark, rows, (a, None, None), positives, "positives")
        known = close.select("question", F.col(RANK).alias("place"), "score", "vec_id").toArrow()  # a few per anchor
        at = (known.column("question").to_numpy(), known.column("place").to_numpy() - 1)
        low = np.full((len(a.row), positives), 1 << 62)  # a place without a positive takes nothing
        high = -low
        score = known.column("score").to_numpy()
        hundreds, rest = score // 100, score % 100  # products may pass 64 bits
        low[at] = hundreds * low_percent - (-rest * low_percent) // 100
        high[at] = hundreds * high_percent + rest * high_percent // 100
        hard = _first(spark, rows, (a, low, high), negatives, "negatives")
        names = [F.col("question").alias("a"), (F.col(RANK) - 1).alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")]
        told = close.select(*names).withColumn("question", F.col("a") * F.lit(positives) + F.col("p"))
        ids = spark.createDataFrame([(k, int(i)) for k, i in enumerate(a.vec_id)], "a long, anchor_id long")
        told = told.join(F.broadcast(ids), "a")
        one = join_checked(hard, told.drop("a", "p"), ["question"]).select(
            "anchor_id", "positive_id", F.col(RANK).cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        out = one if out is None else out.unionByName(one)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], kind) if out is None else out


def whole(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def finite(vector: Column) -> Column:
    """Whether a vector has only finite components and no null one."""
    ends = [F.lit(float(x)) for x in ("inf", "-inf")]
    return vector.isNotNull() & ~F.exists(
        vector, lambda x: F.coalesce(F.isnan(x.cast("double")) | x.cast("double").isin(*ends) | x.isNull(), F.lit(True))
    )


def relabelled(vec_id: Column, label: Column) -> Column:
    """The labels of the registered query: every seventh row takes the next one."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).cast("long")


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` (vec_id, embedding, label) as the registered query sees them: every hundredth row is an anchor."""
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    vec_id = F.col("vec_id").cast("long")
    return usable.select(
        vec_id.alias("vec_id"),
        relabelled(vec_id, F.col("label")).alias("label"),
        (vec_id % 100 == 0).alias("anchor"),
        whole(F.col("embedding")).alias("vector"),
    )


ORACLE_SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), components AS (
  SELECT row, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM parts
), usable AS (
  SELECT p.row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM parts p
  WHERE NOT EXISTS (SELECT 1 FROM components c WHERE c.row = p.row AND (c.x IS NULL OR NOT isfinite(CAST(c.x AS DOUBLE))))
), v AS (
  SELECT c.row, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM components c SEMI JOIN usable u ON u.row = c.row
), products AS (
  SELECT a.row AS a, b.row AS b, sum(a.x * b.x) AS score
  FROM v a JOIN v b ON a.i = b.i AND a.row <> b.row
  WHERE a.row IN (SELECT row FROM usable WHERE vec_id % 100 = 0) GROUP BY ALL
), pairs AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, a.label AS anchor_label, b.row AS b, b.vec_id AS vec_id, b.label AS label,
         CAST(coalesce(p.score, 0) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.row <> b.row
  LEFT JOIN products p ON p.a = a.row AND p.b = b.row
), positives AS (
  SELECT * FROM pairs WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= {POSITIVES}
), hard AS (
  SELECT p.anchor_id, p.vec_id AS positive_id,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) AS rank,
         n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.a = p.a AND n.label <> n.anchor_label
   AND {LOW_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH_PERCENT} * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM hard WHERE rank <= {NEGATIVES}
"""
