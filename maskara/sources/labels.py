"""Label, list and manifest readers.

A label file is read whole and split into numbered lines, so that blank lines, byte-order marks and line numbers
survive. Zero-byte files are skipped by Spark's readers, so inventories are listed through the file system and joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Suffixes of images, in the narrow and in the wide sense.
IMAGES = (".bmp", ".jpeg", ".jpg", ".png", ".webp")
IMAGES_WIDE = (*IMAGES, ".tif", ".tiff")
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Every character sequence that ends a line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
POLYGON = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, name, length of every file under the folder, empty ones included; hidden ones left out."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(fs_path):
        found = fs.listFiles(fs_path, recursive)
        while found.hasNext():
            s = found.next()
            rows.append((s.getPath().toString(), s.getPath().getName(), s.getLen()))
    return spark.createDataFrame(sorted(r for r in rows if not r[1].startswith(".")), "path string, name string, length long")


def images(spark: SparkSession, folder: str, suffixes=IMAGES, include: str | None = None, exclude: str | None = None, recursive: bool = False) -> DataFrame:
    """Images of the folder by their suffix, then by name patterns (* and ?)."""
    like = lambda p: "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in p) + "$"
    out = list_files(spark, folder, recursive).filter(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*suffixes))
    if include:
        out = out.filter(F.rlike("name", F.lit(like(include))))
    if exclude:
        out = out.filter(~F.rlike("name", F.lit(like(exclude))))
    return out


def lines_of(text: Column, strip_mark: bool = False) -> Column:
    """A file's lines; no last empty one after a line end."""
    bare = F.regexp_replace(text, "^﻿", "") if strip_mark else text
    parts = F.split(bare, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def label_lines(spark: SparkSession, folder: str, strip_mark: bool = False) -> DataFrame:
    """stem, line (from 1), text of every line of the folder's .txt files."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("stem"), F.posexplode(lines_of(F.col("value"), strip_mark)).alias("at", "text"))
    return files.select("stem", (F.col("at") + 1).alias("line"), "text")


def with_labels(inventory: DataFrame, lines: DataFrame) -> DataFrame:
    """Every image of the inventory with its lines; one row with null lines if it has none."""
    return inventory.withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", "")).join(lines, "stem", "left")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def _numbers(words: Column) -> Column:
    return F.transform(words, lambda x: x.try_cast("double"))


def _polygon(numbers: Column, clip: bool) -> Column:
    held = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) if clip else v
    pairs = F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2).cast("int") - 1, F.lit(0)))
    return F.when(F.size(numbers) >= 2, F.transform(pairs, lambda i: F.struct(held(F.get(numbers, 2 * i)).alias("x"), held(F.get(numbers, 2 * i + 1)).alias("y")))).otherwise(F.array().cast(POLYGON))


def instances(lines: DataFrame, confident: bool, least_tokens: int = 7, clip: bool = True, keys=("stem",)) -> DataFrame:
    """Polygons by the lenient rule: lines of too few values, of an odd number of coordinates or with one that is no
    number are skipped. idx counts what is accepted, from 0. With ``confident`` the last value is the confidence,
    else it is null. Coordinates are clipped to 0..1."""
    words = tokens(F.col("text"))
    body = F.slice(words, 2, F.greatest(F.size(words) - (2 if confident else 1), F.lit(0)))
    rows = lines.filter(F.col("text").isNotNull()).withColumn("_words", words).filter(F.size("_words") >= least_tokens).withColumn("_xy", _numbers(body))
    rows = rows.withColumn("_class", F.get("_words", F.lit(0)).try_cast("double").cast("int")).withColumn("confidence", F.element_at("_words", -1).try_cast("double") if confident else F.lit(None).cast("double"))
    good = (F.size("_xy") >= 6) & (F.size("_xy") % 2 == 0) & ~F.exists("_xy", lambda x: x.isNull()) & F.col("_class").isNotNull()
    if confident:
        good = good & F.col("confidence").isNotNull()
    kept = rows.filter(good)
    from pyspark.sql import Window

    return kept.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("line")) - 1).alias("idx"), "line", F.col("_class").alias("class_id"), "confidence", _polygon(F.col("_xy"), clip).alias("points"))


def exported_predictions(lines: DataFrame, keys=("stem",)) -> DataFrame:
    """Predictions as the export reads them: at least eight values, the first the class and the last the confidence."""
    return instances(lines, True, least_tokens=8, keys=keys)


def shared_instances(lines: DataFrame, confident: bool, keys=("stem",)) -> DataFrame:
    """Truth gets the confidence 1."""
    out = instances(lines, confident, keys=keys)
    return out if confident else out.withColumn("confidence", F.lit(1.0))


def strict_instances(lines: DataFrame, confident: bool, keys=("stem",)) -> tuple[DataFrame, DataFrame]:
    """(instances, errors): a line of under seven values or an odd number of coordinates stops the read, unless it is a
    prediction, which goes to the errors as invalid_coordinate_count or fewer_than_3_points."""
    n = F.size(tokens(F.col("text"))) - (2 if confident else 1)
    code = F.when(n % 2 != 0, "invalid_coordinate_count").when(n < 6, "fewer_than_3_points")
    marked = lines.withColumn("code", F.when(F.trim("text") != "", code))
    if not confident:
        marked = marked.withColumn("text", F.when(F.col("code").isNull(), F.col("text")).otherwise(F.raise_error(F.concat_ws(": ", F.col("code"), F.col("text")))))
    return instances(marked.filter(F.col("code").isNull()), confident, keys=keys), marked.filter(F.col("code").isNotNull()).select(*keys, "line", "code", "text")


def benchmark_instances(lines: DataFrame, class_id: int = 0, keys=("stem",)) -> DataFrame:
    """One class; other classes are skipped, and lines of it that are malformed, not finite or out of range stop the read."""
    words = tokens(F.regexp_replace("text", "^﻿", ""))
    own = (F.trim("text") != "") & F.coalesce(F.get(words, F.lit(0)).try_cast("int") == class_id, F.lit(False))
    xy = _numbers(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    fine = (F.size(xy) >= 6) & (F.size(xy) % 2 == 0) & F.forall(xy, lambda x: F.coalesce(x.between(0.0, 1.0), F.lit(False)))
    checked = lines.withColumn("text", F.when(own, F.when(fine, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("bad label line: "), F.col("text"))))))
    return instances(checked, False, clip=False, keys=keys)


def training_instances(lines: DataFrame, width: Column, height: Column, tolerance: float = 1e-6, keys=("stem",)) -> DataFrame:
    """Class 0 as an integer; coordinates within the tolerance of 0..1, then clamped; at least three distinct points;
    pixel points rounded to six decimals, of positive area and box. Anything else stops the read."""
    from ..functions.geometry import bounds, polygon_area

    words = tokens(F.col("text"))
    xy = _numbers(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    fine = (F.get(words, F.lit(0)) == "0") & (F.size(xy) >= 6) & (F.size(xy) % 2 == 0) & F.forall(xy, lambda x: F.coalesce(x.between(-tolerance, 1 + tolerance), F.lit(False)))
    # blank lines become null, not filtered: a filter may be moved after the check
    checked = lines.withColumn("text", F.when(F.trim("text") != "", F.when(fine, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("bad label line: "), F.col("text"))))))
    rows = instances(checked, False, keys=keys).withColumn("pixels", F.transform("points", lambda p: F.struct(F.round(p["x"] * width, 6).alias("x"), F.round(p["y"] * height, 6).alias("y"))))
    box = bounds(F.col("pixels"))
    good = (F.size(F.array_distinct("points")) >= 3) & (polygon_area(F.col("pixels")) > 0) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])
    rows = rows.withColumn("area", F.when(good, polygon_area(F.col("pixels"))).otherwise(F.raise_error(F.lit("degenerate polygon"))))
    text = F.array_join(F.transform("pixels", lambda p: F.concat_ws(",", F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"]))), ";")
    return rows.withColumn("box", box).withColumn("vertices", F.size("pixels")).withColumn("polygon_sha256", F.sha2(text, 256))


def audit_boxes(lines: DataFrame) -> DataFrame:
    """class and box (xc, yc, w, h) of detection labels; null fields where a value is no number."""
    words = tokens(F.col("text"))
    names = ("class_id", "xc", "yc", "w", "h")
    return lines.select("stem", "line", F.size(words).alias("n"), *(F.get(words, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A delimited table with a header; every column a string."""
    return spark.read.csv(path, sep=sep, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def document(spark: SparkSession, path: str, schema) -> DataFrame:
    """A whole-file JSON document."""
    return spark.read.json(path, schema=schema, multiLine=True)


COCO = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, area: double, segmentation: array<array<double>>>>"


def coco_images(doc: DataFrame, prefix: str = "images/") -> DataFrame:
    """A row per image in the order of file_name, from 0; absolute names, those with .., without the prefix or repeated stop the read."""
    from pyspark.sql import Window

    rows = doc.select(F.explode("images").alias("i")).select("i.*")
    name = F.col("file_name")
    bad = F.startswith(name, F.lit("/")) | F.array_contains(F.split(name, "/"), "..") | ~F.startswith(name, F.lit(prefix)) | (F.count("*").over(Window.partitionBy("file_name")) > 1)
    return rows.withColumn("file_name", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad image name: "), F.coalesce(name, F.lit("null"))))).otherwise(name)).withColumn("seq", F.row_number().over(Window.orderBy("file_name")) - 1)


LABELME = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label: string, shape_type: string, points: array<array<double>>>>"


def annotated(docs: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, imagePath, imageWidth, imageHeight, shapes -> a row per shape with the image it belongs to: the one that
    imagePath names, else the one of the document's stem. Points become shares of the size."""
    base, own = F.substring_index("imagePath", "/", -1), F.regexp_extract("path", r"([^/]+)\.json$", 1)
    by_name = inventory.select(F.col("name").alias("_by_name"))
    by_stem = inventory.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("_stem"), F.col("name").alias("_by_stem")).groupBy("_stem").agg(F.min("_by_stem").alias("_by_stem"))
    rows = docs.withColumn("_base", base).withColumn("_own", own).join(by_name, F.col("_base") == F.col("_by_name"), "left").join(by_stem, F.col("_own") == F.col("_stem"), "left")
    rows = rows.withColumn("image", F.coalesce("_by_name", "_by_stem")).select("path", "image", "imageWidth", "imageHeight", F.posexplode("shapes").alias("idx", "s"))
    points = F.transform("s.points", lambda p: F.struct((F.get(p, F.lit(0)) / F.col("imageWidth")).alias("x"), (F.get(p, F.lit(1)) / F.col("imageHeight")).alias("y")))
    fine = (F.col("s.shape_type") == "polygon") & (F.size("s.points") >= 3) & (F.col("imageWidth") > 0) & (F.col("imageHeight") > 0)
    return rows.select("path", "image", "idx", F.col("s.label").alias("label"), F.when(F.coalesce(fine, F.lit(False)), points).otherwise(F.raise_error(F.concat(F.lit("bad shape in "), F.col("path")))).alias("points"))


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, sha256 of every file, empty ones included."""
    listed = list_files(spark, folder).select("name", "length")
    full = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return listed.join(full, "name", "left").filter(F.col("sha256").isNotNull() | (F.col("length") == 0)).select("name", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("sha256"))


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    """Frames whose index is a multiple of n."""
    return frames.filter(F.pmod(F.col("frame_index"), F.lit(n)) == 0)


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda x: F.trim(x) != ""))


def runtime_config(mapping: dict) -> dict:
    """A version-1 mapping with its numbers in range."""
    if mapping.get("version") != 1:
        raise ValueError("version must be 1")
    for name, low, high in (("confidence", 0.0, 1.0), ("iou", 0.0, 1.0), ("imgsz", 1, math.inf), ("every_n", 0, math.inf)):
        if name in mapping and not (low <= float(mapping[name]) <= high):
            raise ValueError(f"{name} must be in {low}..{high}")
    return mapping
