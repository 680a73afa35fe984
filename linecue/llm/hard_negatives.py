"""Hard negatives by a search over buckets of like norm: for each anchor and positive the best rows of another label inside a window of scores.

Vectors are whole numbers (floor(SCALE * x), held to +-LIMIT), their score is
the inner product, so no result depends on the order of sums. Rows are sorted by norm and
cut into ranges, the longest vectors first; a range's greatest norm bounds
every score in it (Cauchy-Schwarz). Anchors are dealt into blocks by how many
ranges they need, and only pairs of a block and a range that some anchor of it
needs meet: an anchor is sent to the ranges whose bound reaches the lowest of
its windows' lower limits. Such a pair is one task's work, of bounded size on
both sides. Inside it, buckets of STEP rows come in order of norm, and an
anchor whose bound is below its lower limits and below the scores it has
already found takes no part in the product. The first ones of all ranges are
merged by anchor: at most that many a range and window, however common a score
is.

The positives are found in the same way, in one window without limits and
among rows of the anchor's label.

Cases: rows take no part if their id, label or vector is null or a component
is null, NaN or infinite; rows equal in id, label and vector count once; rows
of one id with different vectors are rows of their own, and none is another
row's positive or negative under its own id; shorter vectors are continued by
zeros; ties go by id; an empty table gives an empty table; further columns are
not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.common import checkpointed, table

SCALE, LIMIT = 256, 1 << 24
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a negative's score lies.
LEAST, MOST = 50, 95
#: Rows of one range and how many ranges there are at most; anchors of one block; rows of one product.
RANGE_ROWS, MOST_RANGES, BLOCK_ROWS, STEP = 4096, 4096, 8192, 512
_ANY = 1 << 62
FOUND = "anchor_id long, anchor long, positive_id long, positive_score long, other_id long, score long"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vec, size): each row that takes part once; vec: whole numbers, size: its squared norm."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(SCALE * x.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long"))
    out = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    out = out.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vec")).distinct()
    return out.withColumn("size", F.aggregate("vec", F.lit(0).cast("long"), lambda acc, x: acc + x * x))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _first(found: np.ndarray, most: int) -> np.ndarray:
    """The first `most` of each window; found: rows of window, score, candidate's place, id."""
    found = found[np.lexsort((found[:, 3], -found[:, 1], found[:, 0]))]
    starts = np.flatnonzero(np.append(True, np.diff(found[:, 0]) != 0))[: len(found)]
    return found[np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found)))) < most]


def search(asked: pd.DataFrame, rows: pd.DataFrame, most: int, same: bool, step: int = STEP) -> tuple[np.ndarray, int]:
    """(found as in _first, products made) for anchors (id, label, vec, size, lows, highs) among rows (id, label, vec, size)."""
    rows = rows.sort_values(["size", "id"], ascending=[False, True]).reset_index(drop=True)
    width = max(max(map(len, asked.vec), default=0), max(map(len, rows.vec), default=0))
    q, c = _matrix(asked.vec, width), _matrix(rows.vec, width)
    if int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * width < 1 << 53:
        q, c = q.astype(np.float64), c.astype(np.float64)  # products are as exact there, and faster
    windows = max(map(len, asked.lows), default=0)
    low, high = np.full((len(asked), windows), _ANY), np.full((len(asked), windows), -_ANY)
    for i, (a, b) in enumerate(zip(asked.lows, asked.highs, strict=True)):
        low[i, : len(a)], high[i, : len(b)] = a, b
    q_norm, c_norm = np.sqrt(asked["size"].to_numpy(float)), np.sqrt(rows["size"].to_numpy(float))
    q_id, c_id, q_label, c_label = asked.id.to_numpy(), rows.id.to_numpy(), asked.label.to_numpy(), rows.label.to_numpy()
    best, made = np.empty((0, 4), np.int64), 0
    for at in range(0, len(rows), step):
        # low is raised to the last of the scores found so far once there are enough of them.
        bound = q_norm * c_norm[at] * (1 + 1e-9)
        active = np.flatnonzero((low <= bound[:, None]).any(axis=1))
        if not len(active):
            break  # no later row is longer
        part = slice(at, at + step)
        scores = np.asarray(q[active] @ c[part].T, np.int64)
        made += scores.size
        mate = (q_label[active][:, None] == c_label[part]) == same
        mate &= q_id[active][:, None] != c_id[part]
        hits = [best]
        for w in range(windows):
            i, j = np.nonzero(mate & (scores >= low[active, w][:, None]) & (scores <= high[active, w][:, None]))
            hits.append(np.stack([active[i] * windows + w, scores[i, j], at + j, c_id[at + j]], axis=1))
        best = _first(np.concatenate(hits), most)
        window, first, count = np.unique(best[:, 0], return_index=True, return_counts=True)
        full = count == most
        low.reshape(-1)[window[full]] = np.maximum(low.reshape(-1)[window[full]], best[first[full] + most - 1, 1])
    return best, made


def _met(anchors: DataFrame, rows: DataFrame, norms: list[float], most: int, same: bool) -> DataFrame:
    """FOUND for each range: anchors (id, anchor, label, vec, size, lows, highs, positives) against rows (range, id, label, vec, size)."""
    falling = F.split(F.lit(",".join(map(repr, norms))), ",").cast("array<double>") if norms else F.array().cast("array<double>")
    reach = F.size(F.filter(falling, lambda x: x * F.sqrt("size") * (1 + 1e-9) >= F.array_min("lows")))
    asked = anchors.where(F.size("lows") > 0).withColumn("reach", reach).where("reach > 0")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = checkpointed(asked.repartitionByRange(blocks, F.col("reach").desc(), "id").withColumn("block", F.spark_partition_id()))
    pairs = asked.groupBy("block").agg(F.max("reach").alias("reach")).select("block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("range"))
    left = asked.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("reach") - 1))).drop("reach")
    right = rows.join(pairs, "range").select(*(F.col(c).alias(c) for c in ("block", "range", "id", "label", "vec", "size")))  # columns of its own, as both sides come from one table

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        some, others = some.reset_index(drop=True), others.reset_index(drop=True)
        found, _ = search(some, others, most, same)
        windows = max(map(len, some.lows), default=1)
        i, w = found[:, 0] // windows, found[:, 0] % windows
        out = pd.DataFrame({"anchor_id": some.id.to_numpy()[i], "anchor": some.anchor.to_numpy()[i]})
        chosen = [some.positives[a][b] if some.positives[a] is not None and len(some.positives[a]) else None for a, b in zip(i, w, strict=True)]
        out["positive_id"] = pd.array([p["id"] if p else None for p in chosen], "Int64")
        out["positive_score"] = pd.array([p["score"] if p else None for p in chosen], "Int64")
        return out.assign(other_id=found[:, 3], score=found[:, 1])

    return left.groupBy("block", "range").cogroup(right.groupBy("block", "range")).applyInPandas(run, FOUND)


def _leading(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, first: the first `most` of all ranges' finds, an array of structs of -score and id."""
    return found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("other_id").alias("id")))), 1, most).alias("first"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: as usable gives them; anchors: which of them are anchors; least, most:
    hundredths of the positive's score. A positive without negatives has no row.
    """
    rows = checkpointed(rows)
    ranges = min(MOST_RANGES, max(1, -(-rows.count() // range_rows)))
    rows = checkpointed(rows.repartitionByRange(ranges, F.col("size").desc(), "id").withColumn("range", F.spark_partition_id()))
    longest = dict(rows.groupBy("range").agg(F.sqrt(F.max("size").cast("double"))).collect())  # MOST_RANGES rows at most
    # A range that got no row has the next one's norm, so that norms fall.
    norms, last = [], 0.0
    for r in range(max(longest, default=-1), -1, -1):
        last = longest.get(r, last)
        norms.insert(0, last)
    kind = "array<struct<minus: bigint, id: bigint, score: bigint>>"
    asked = rows.where(anchors).drop("range").withColumns({"anchor": F.xxhash64("label", "vec"), "lows": F.array(F.lit(-_ANY)), "highs": F.array(F.lit(_ANY)), "positives": F.lit(None).cast(kind)})
    own = _leading(_met(asked, rows, norms, positives, True), ["anchor_id", "anchor"], positives)
    own = own.select(F.col("anchor_id").alias("id"), "anchor", F.transform("first", lambda p: F.struct(p["minus"].alias("minus"), p["id"].alias("id"), (-p["minus"]).alias("score"))).alias("positives"))
    floor = lambda x: F.floor((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    windows = {"lows": F.transform("positives", lambda p: -floor(-least * p["score"])), "highs": F.transform("positives", lambda p: floor(most * p["score"]))}
    asked = asked.drop("positives", "lows", "highs").join(own, ["id", "anchor"]).withColumns(windows)
    found = _leading(_met(asked, rows, norms, negatives, False), ["anchor_id", "anchor", "positive_id", "positive_score"], negatives)
    out = found.select("anchor_id", "positive_id", "positive_score", F.posexplode("first").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.minus")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50; a seventh of the labels is moved by one first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(usable(rows), F.col("id") % 50 == 0)


ORACLE = f"""WITH
  rows AS (
    SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: greatest(least(floor({SCALE} * x::DOUBLE), {LIMIT}), -{LIMIT})) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scores AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
    FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 50 = 0),
  positives AS (SELECT anchor_id, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
  found AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank
    FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN {LEAST} * p.score AND {MOST} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {NEGATIVES}"""
