"""Queries on leaks that only the images show, and their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import leakage
from ..operators.order import cut
from . import views

N = leakage.COARSE
#: Places that each turn of an image takes its pixels from.
TURNS = leakage.turn_places()


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, key (a name), scene, h (SHA-256 of the text), m (a number that the id gives) of each document."""
    t = views.table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 10 == 8, "val").when(F.col("doc_id") % 10 == 9, "test").otherwise("train")
    key = F.format_string("Shot_%06d.rf.%02d.jpg", F.floor(F.col("doc_id") / 3), F.col("doc_id") % 3)
    return t.select(split.alias("split"), key.alias("key"), text.scene_key(F.col("source"), key).alias("scene"), F.unhex(F.sha2("text", 256)).alias("h"), (F.col("doc_id") % 24).cast("int").alias("m"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, key (a name), scene, pixels of an image of each document: half of each byte of the text's SHA-256, over and over, with a grain of 0 to 2
    and a turn that the id gives. Copies of a text are near copies, turned, in one split or in several."""
    grow = leakage.FINE // N

    def draw(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, leakage.TILE_ROWS):
                batch = whole.slice(at, leakage.TILE_ROWS)
                m = batch.column("m").to_numpy()
                base = np.tile(np.frombuffer(b"".join(batch.column("h").to_pylist()), dtype=np.uint8).reshape(-1, 32) // 2, (1, N * N // 32)) + (m[:, None] + np.arange(N * N)) % 3
                small = np.take_along_axis(base, TURNS[m % 8], axis=1).astype(np.uint8).reshape(-1, N, N)
                pixels = [x.tobytes() for x in small.repeat(grow, 1).repeat(grow, 2)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("split", "key", "scene")), pa.array(pixels, pa.binary())], names=["split", "key", "scene", "pixels"])

    return shots(spark, sf_dir).mapInArrow(draw, "split string, key string, scene string, pixels binary")


#: All pairs of classes; the images are as sharp at full size, so what fits at the coarse one fits there.
_PAIRS = f"""
shot AS (SELECT CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, format('Shot_{{:06d}}.rf.{{:02d}}.jpg', doc_id // 3, doc_id % 3) AS key, lower(source) || format('::shot_{{:06d}}', doc_id // 3) AS scene, sha256(text) AS h, (doc_id % 24)::INT AS m FROM documents),
rep AS (SELECT split, h, m, min(key) AS key, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS side FROM shot GROUP BY split, h, m),
turn AS (SELECT * FROM (VALUES {", ".join(f"({k}, {places.tolist()})" for k, places in enumerate(TURNS))}) AS t(k, places)),
base AS (SELECT split, key, side, m, list_transform(range(0, {N * N}), lambda p: (('0x' || substr(h, (2 * (p % 32) + 1)::INT, 2))::INT // 2 + (m + p) % 3)::DOUBLE) AS x FROM rep),
image AS (SELECT split, key, side, list_transform(t.places, lambda i: x[i + 1]) AS x FROM base JOIN turn t ON t.k = base.m % 8),
mean AS (SELECT *, list_transform(x, lambda v: v - list_avg(x)) AS c FROM image),
vec AS (SELECT split, key, side, list_transform(c, lambda v: v / sqrt(list_inner_product(c, c))) AS v FROM mean),
turned AS (SELECT split, key, side, t.k, list_transform(t.places, lambda i: v[i + 1]) AS v FROM vec, turn t WHERE side > 1),
fit AS (SELECT a.split AS a_split, a.key AS a_key, b.split AS b_split, b.key AS b_key, b.k AS turn, list_inner_product(a.v, b.v) AS coarse FROM vec a JOIN turned b ON a.side < b.side),
found AS (SELECT * FROM fit WHERE coarse >= 0.995 QUALIFY row_number() OVER (PARTITION BY a_split, a_key, b_split, b_key ORDER BY coarse DESC, turn) = 1)"""


def perceptual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leakage.perceptual_pairs(photos(spark, sf_dir))
    return out.select("a_split", "a_key", "b_split", "b_key", "turn", F.round("coarse", 6).alias("coarse"), F.round("confirm", 6).alias("confirm"))


PERCEPTUAL_PAIRS = f"WITH {_PAIRS} SELECT a_split, a_key, b_split, b_key, turn, round(coarse, 6) AS coarse, round(coarse, 6) AS confirm FROM found"


def perceptual_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with its group, and whether it goes."""
    images = photos(spark, sf_dir)
    seen = cut(leakage.sketched(images))
    pairs = cut(leakage.perceptual_pairs(images, seen=seen))
    done = leakage.prioritized(shots(spark, sf_dir).select("split", "key", "scene"), pairs, leakage.members_of(seen))
    return done.select("split", "key", "scene", "removed", F.coalesce("group", F.lit("")).alias("group"))


#: A component is what shares a text across splits, as other texts do not fit.
PERCEPTUAL_PRIORITY = f"""WITH {_PAIRS}, linked AS (SELECT a_split AS split, a_key AS key FROM found UNION SELECT b_split, b_key FROM found),
node AS (SELECT s.split, s.key, s.scene, s.h FROM shot s JOIN rep r ON r.split = s.split AND r.h = s.h AND r.m = s.m JOIN linked l ON l.split = r.split AND l.key = r.key),
comp AS (SELECT h, min(split || chr(1) || key) AS root, min(CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END) AS best FROM node GROUP BY h),
named AS (SELECT h, best, format('d4_group_{{:04d}}', row_number() OVER (ORDER BY root)) AS g FROM comp),
gone AS (SELECT n.split, n.scene, min(g) AS g FROM node n JOIN named USING (h) WHERE CASE n.split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END > best GROUP BY n.split, n.scene)
SELECT s.split, s.key, s.scene, gone.g IS NOT NULL AS removed, coalesce(o.g, gone.g, '') AS "group" FROM shot s
LEFT JOIN (SELECT n.split, n.key, g FROM node n JOIN named USING (h)) o ON o.split = s.split AND o.key = s.key LEFT JOIN gone ON gone.split = s.split AND gone.scene = s.scene"""

_WITH_SQL = {"perceptual_pairs": (perceptual_pairs, PERCEPTUAL_PAIRS), "perceptual_priority": (perceptual_priority, PERCEPTUAL_PRIORITY)}
QUERIES = {k: f for k, (f, _) in _WITH_SQL.items()}
ORACLES = {k: s for k, (_, s) in _WITH_SQL.items()}
