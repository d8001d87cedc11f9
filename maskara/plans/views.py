"""Detection relations derived from the driver's tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Names of the sources that images are dealt to.
SOURCES = ("alpha", "beta", "gamma", "delta")
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, idx, gt, model, conf, source, area, edge and an integer box of every line item; idx numbers an image's rows."""
    t = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image")  # first, so that later steps find its partitioning
    number = F.row_number().over(Window.partitionBy("image").orderBy(*ORDER)) - 1
    t = t.select("image", *ORDER, number.cast("int").alias("idx"))  # by itself: what is made from a row is made after the shuffle and the sort
    n = F.col("l_quantity").cast("int")
    x0, y0 = (F.col("l_partkey") % 12).cast("int"), (F.col("l_suppkey") % 12).cast("int")
    rows = t.select(
        "image",
        "idx",
        (F.col("l_linestatus") == "F").alias("gt"),
        F.col("l_returnflag").alias("model"),
        (((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1000) / 1000.0).alias("conf"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("image") % 4 + 1).cast("int")).alias("source"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 8 + n % 16).alias("x1"), (y0 + 8 + n % 13).alias("y1"),
    )
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) / 1600.0
    edge = F.least("x0", "y0", 40 - F.col("x1"), 40 - F.col("y1")) / 40.0
    return rows.withColumn("area", area).withColumn("edge", edge)


INST = """
inst AS (
  SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) / 1600.0::DOUBLE AS area, least(x0, y0, 40 - x1, 40 - y1) / 40.0::DOUBLE AS edge FROM (
    SELECT *, x0 + 8 + n % 16 AS x1, y0 + 8 + n % 13 AS y1 FROM (
      SELECT l_orderkey AS image, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INT AS idx,
        l_linestatus = 'F' AS gt, l_returnflag AS model, ((l_partkey * 7919 + l_suppkey * 104729) % 1000) / 1000.0::DOUBLE AS conf,
        ['alpha', 'beta', 'gamma', 'delta'][(l_orderkey % 4 + 1)::INT] AS source, (l_partkey % 12)::INT AS x0, (l_suppkey % 12)::INT AS y0, l_quantity::INT AS n
      FROM lineitem))
), pred AS (SELECT * FROM inst WHERE NOT gt), truth AS (SELECT * FROM inst WHERE gt),
pair AS (
  SELECT *, inter::DOUBLE / (pa + ga - inter) AS iou FROM (
    SELECT p.image, p.idx AS p_idx, g.idx AS g_idx, p.conf, p.source,
      greatest(least(p.x1, g.x1) - greatest(p.x0, g.x0) + 1, 0) * greatest(least(p.y1, g.y1) - greatest(p.y0, g.y0) + 1, 0) AS inter,
      (p.x1 - p.x0 + 1) * (p.y1 - p.y0 + 1) AS pa, (g.x1 - g.x0 + 1) * (g.y1 - g.y0 + 1) AS ga
    FROM pred p JOIN truth g ON p.image = g.image AND p.x0 <= g.x1 AND g.x0 <= p.x1 AND p.y0 <= g.y1 AND g.y0 <= p.y1)
), near AS (
  SELECT *, inter::DOUBLE / (aa + ba - inter) AS iou FROM (
    SELECT a.image, a.idx AS a_idx, b.idx AS b_idx, a.model AS a_model, b.model AS b_model, a.conf AS a_conf, b.conf AS b_conf,
      greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1, 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1, 0) AS inter,
      (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) AS aa, (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) AS ba
    FROM pred a JOIN pred b ON a.image = b.image AND a.idx < b.idx AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir).filter("NOT gt")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir).filter("gt")


def image_rows(spark: SparkSession, sf_dir: str, least: float = 0.0, form=None) -> DataFrame:
    """Predictions (of the least confidence that any setting asks for) and truths of each image, as module ``matching`` or another form wants them."""
    from ..operators import masks, matching

    rows = instances(spark, sf_dir).withColumn("shape", masks.box())
    return (form or matching.of_lists)(matching.gathered(rows, least, "source"), masks.shared_box)


#: Pixels of a grid step and the side of the raster that outlines are drawn on.
STEP = 3
SIDE = 40 * STEP + 1


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instances() as polygons: their boxes with corners cut at 45 degrees, each by its own steps, in 0..1."""
    i = instances(spark, sf_dir).drop("area", "edge")
    cut = [F.pmod(F.col("image") * (k + 3) + F.col("idx") * (2 * k + 1), F.lit(4)).cast("int") for k in range(4)]
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = [(x0 + cut[0], y0), (x1 - cut[1], y0), (x1, y0 + cut[1]), (x1, y1 - cut[2]), (x1 - cut[2], y1), (x0 + cut[3], y1), (x0, y1 - cut[3]), (x0, y0 + cut[0])]
    return i.withColumn("points", F.array(*(F.struct((x / 40).alias("x"), (y / 40).alias("y")) for x, y in ring)))


def masked(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    """outlines() that take part, to be drawn once their image is together."""
    from ..operators import masks

    return masks.with_outlines(outlines(spark, sf_dir).filter(F.col("gt") | (F.col("conf") >= least)), SIDE)


def mask_rows(spark: SparkSession, sf_dir: str, least: float = 0.0, form=None) -> DataFrame:
    """As image_rows(), with overlaps of masks."""
    from ..operators import masks, matching

    return (form or matching.of_lists)(matching.gathered(masked(spark, sf_dir, least), least, "source"), masks.looked_up)


_CUT = [f"((image * {k + 3} + idx * {2 * k + 1}) % 4)::INT" for k in range(4)]
#: Rows of pixels of each outline: one span each, as the corners cut are as wide as high.
MASKS = f"""
cutted AS (SELECT *, {STEP} * {_CUT[0]} AS c0, {STEP} * {_CUT[1]} AS c1, {STEP} * {_CUT[2]} AS c2, {STEP} * {_CUT[3]} AS c3 FROM inst),
span AS (SELECT image, idx, y, {STEP} * x0 + greatest(c0 - (y - {STEP} * y0), c3 - ({STEP} * y1 - y), 0) AS a, {STEP} * x1 - greatest(c1 - (y - {STEP} * y0), c2 - ({STEP} * y1 - y), 0) AS b
  FROM (SELECT *, unnest(range({STEP} * y0, {STEP} * y1 + 1)) AS y FROM cutted)),
mask AS (SELECT i.* EXCLUDE (area, edge, n), s.n, s.n / {SIDE * SIDE}.0::DOUBLE AS area, least(x0 / 40.0::DOUBLE, y0 / 40.0::DOUBLE, 1 - x1 / 40.0::DOUBLE, 1 - y1 / 40.0::DOUBLE) AS edge FROM inst i JOIN (SELECT image, idx, sum(b - a + 1)::BIGINT AS n FROM span GROUP BY image, idx) s ON s.image = i.image AND s.idx = i.idx),
both_ AS (SELECT q.image, q.p_idx, q.g_idx, sum(greatest(least(p.b, g.b) - greatest(p.a, g.a) + 1, 0))::BIGINT AS inter FROM (
    SELECT a.image, a.idx AS p_idx, b.idx AS g_idx FROM inst a JOIN inst b ON b.image = a.image AND (a.idx < b.idx OR b.gt AND NOT a.gt) AND NOT a.gt AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) q
  JOIN span p ON p.image = q.image AND p.idx = q.p_idx JOIN span g ON g.image = q.image AND g.idx = q.g_idx AND g.y = p.y GROUP BY q.image, q.p_idx, q.g_idx),
over_ AS (SELECT o.image, o.p_idx, o.g_idx, o.inter, o.inter::DOUBLE / (p.n + g.n - o.inter) AS iou, g.gt FROM both_ o JOIN mask p ON p.image = o.image AND p.idx = o.p_idx JOIN mask g ON g.image = o.image AND g.idx = o.g_idx WHERE o.inter > 0)"""
#: The same names as INST has, of masks.
MASK_INST = INST[: INST.index(", pred AS (")] + "," + MASKS + """,
pred AS (SELECT * FROM mask WHERE NOT gt), truth AS (SELECT * FROM mask WHERE gt), pair AS (SELECT image, p_idx, g_idx, iou FROM over_ WHERE gt),
near AS (SELECT image, p_idx AS a_idx, g_idx AS b_idx, iou FROM over_ WHERE NOT gt)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, points: 32 points from each embedding, clipped to 0..1."""
    e = table(spark, sf_dir, "embeddings")
    d = F.col("embedding").cast("array<double>")
    at = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 * F.get(d, i) + 1) / 2))
    return e.select(F.col("vec_id").alias("image"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))).alias("points"))


POLY = """
xy AS (
  SELECT vec_id AS image, list_transform(range(0, 32), lambda i: greatest(0.0::DOUBLE, least(1.0::DOUBLE, (2 * embedding[2 * i + 1]::DOUBLE + 1) / 2))) AS x,
    list_transform(range(0, 32), lambda i: greatest(0.0::DOUBLE, least(1.0::DOUBLE, (2 * embedding[2 * i + 2]::DOUBLE + 1) / 2))) AS y FROM embeddings
), pt AS (
  SELECT image, i, x[i + 1] AS px, y[i + 1] AS py, x[(i + 1) % 32 + 1] AS nx, y[(i + 1) % 32 + 1] AS ny FROM xy, range(0, 32) r(i)
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_index, track_id, ts, event_type, value. The index counts events by time, as one stream's frames are numbered."""
    from ..operators.order import numbered

    t = table(spark, sf_dir, "events")
    rows = numbered(t.select("event_id", "ts", "user_id", "event_type", "value"), ["ts", "event_id"], "frame_index")
    return rows.select("frame_index", F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


FRAMES = "frames AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS frame_index, user_id AS track_id, ts, event_type, value FROM events)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, source, name, sha256, scene, split of every document."""
    t = table(spark, sf_dir, "documents")
    split = F.element_at(F.array(*map(F.lit, ["train", "train", "train", "train", "train", "train", "train", "train", "val", "test"])), (F.col("doc_id") % 10 + 1).cast("int"))
    return t.select(F.col("doc_id").alias("image"), "source", F.format_string("img_%08d.jpg", "doc_id").alias("name"), F.sha2("text", 256).alias("sha256"), F.concat("source", F.lit("::"), F.lower(F.substring("text", 1, 12))).alias("scene"), split.alias("split"), F.length("text").alias("n"))


ASSETS = """
asset AS (
  SELECT doc_id AS image, source, 'img_' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS name, sha256(text) AS sha256, source || '::' || lower(substr(text, 1, 12)) AS scene,
    CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, length(text) AS n FROM documents
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score, target of the labelled documents."""
    l = table(spark, sf_dir, "labels")
    return l.select(((F.col("doc_id") * 37 + F.col("quality") * 211) % 997 / 997.0).alias("score"), F.col("quality").alias("target"))


SCORED = "scored AS (SELECT ((doc_id * 37 + quality * 211) % 997) / 997.0::DOUBLE AS score, quality AS target FROM labels)"


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, line, text of label lines made from line items, a few of them malformed: blank, short, odd, of another class,
    not a number, out of range, of too few distinct points, flat or tiny."""
    i = instances(spark, sf_dir)
    part = lambda whole: F.floor(whole).cast("string")
    for c in ("x0", "y0", "x1", "y1"):  # each once, and without a formatter a row
        i = i.withColumn(f"_{c}", F.concat(part(F.col(c) / 40), F.lit("."), F.lpad(part(F.col(c) * 100 / 40 % 100), 2, "0")))
    v = lambda c: F.col(f"_{c}")
    kind = F.pmod(F.col("image") * 31 + F.col("idx") * 17, F.lit(40))
    sp = lambda *a: F.concat_ws(" ", *a)
    ring = sp(v("x0"), v("y0"), v("x1"), v("y0"), v("x1"), v("y1"), v("x0"), v("y1"))
    zero = F.lit("0")
    text = (
        F.when(kind == 0, F.lit("  ")).when(kind == 1, sp(zero, v("x0"), v("y0"))).when(kind == 2, sp(zero, ring, v("x0"))).when(kind == 3, sp(F.lit("a"), ring)).when(kind == 4, sp(F.lit("3"), ring))
        .when(kind == 5, sp(zero, ring, F.lit("x"), F.lit("0.5"))).when(kind == 6, sp(zero, ring, F.lit("1.50"), F.lit("0.5"))).when(kind == 7, sp(zero, *[v("x0"), v("y0")] * 3)).when(kind == 8, sp(zero, v("x0"), v("y0"), v("x1"), v("y0"), F.lit("0.99"), v("y0")))
        .when(kind == 9, sp(zero, F.lit("0.1 0.1 0.1001 0.1 0.1 0.1001"))).otherwise(sp(zero, ring))
    )
    return i.select(F.col("image").alias("stem"), (F.col("idx") + 1).alias("line"), text.alias("text"), "source")


def _sql_value(c: str) -> str:
    return f"((({c}) // 40)::VARCHAR || '.' || lpad(((({c}) * 100 // 40) % 100)::VARCHAR, 2, '0'))"


_V = {c: _sql_value(c) for c in ("x0", "y0", "x1", "y1")}
_RING = " || ' ' || ".join(_V[c] for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))
LINES = f"""
line AS (
  SELECT image AS stem, idx + 1 AS line, source, CASE (image * 31 + idx * 17) % 40
    WHEN 0 THEN '  ' WHEN 1 THEN '0 ' || {_V["x0"]} || ' ' || {_V["y0"]} WHEN 2 THEN '0 ' || {_RING} || ' ' || {_V["x0"]} WHEN 3 THEN 'a ' || {_RING} WHEN 4 THEN '3 ' || {_RING}
    WHEN 5 THEN '0 ' || {_RING} || ' x 0.5' WHEN 6 THEN '0 ' || {_RING} || ' 1.50 0.5' WHEN 7 THEN '0 ' || {" || ' ' || ".join([_V["x0"], _V["y0"]] * 3)}
    WHEN 8 THEN '0 ' || {_V["x0"]} || ' ' || {_V["y0"]} || ' ' || {_V["x1"]} || ' ' || {_V["y0"]} || ' 0.99 ' || {_V["y0"]} WHEN 9 THEN '0 0.1 0.1 0.1001 0.1 0.1 0.1001' ELSE '0 ' || {_RING} END AS text FROM inst
)"""
