"""Label and dataset checks: one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import polygon_area, self_intersects
from .order import cut, each_of

ISSUES = "split string, image string, label string, line int, severity string, code string, message string"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lines with _words, _xy, _n (whole points), _points, _distinct and _area: each is made once and read by many rules."""
    words = F.array_remove(F.split(F.trim("text"), r"\s+"), "")
    out = lines.withColumn("_words", words)
    out = out.withColumn("_xy", F.transform(F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), lambda x: x.try_cast("double")))
    out = out.withColumn("_n", F.floor(F.size("_xy") / 2).cast("int"))
    out = out.withColumn("_points", F.when(F.col("_n") >= 1, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), lambda i: F.struct(F.get("_xy", 2 * i).alias("x"), F.get("_xy", 2 * i + 1).alias("y")))))
    out = out.withColumn("_distinct", F.size(F.array_distinct(F.transform("_points", lambda p: F.struct(F.round(p["x"], 10), F.round(p["y"], 10))))))
    return out.withColumn("_area", polygon_area(F.col("_points")))


def line_codes(class_id: int = 0, tiny: float = 1e-6) -> Column:
    """Array of ``severity:code`` of a parsed label line. The first of the codes that end a line's check hides what would
    follow; another class, a coordinate out of range, too few distinct points and a flat or tiny polygon can come together."""
    words, xy = F.col("_words"), F.col("_xy")
    none, one = F.array().cast("array<string>"), lambda c: F.array(F.lit(c))
    maybe = lambda when, c: F.when(when, one(c)).otherwise(none)
    first = F.get(words, F.lit(0))
    whole = F.rlike(first, F.lit(r"^[+-]?\d+$"))
    other = maybe(first.try_cast("int") != class_id, "error:unexpected_class_id")
    shape = F.when(F.col("_area") <= 0, one("error:zero_area_polygon")).when(F.col("_area") < tiny, one("warning:tiny_polygon")).otherwise(none)
    rest = F.concat(other, maybe((F.array_min(xy) < 0) | (F.array_max(xy) > 1), "error:coordinate_out_of_range"), maybe(F.col("_distinct") < 3, "error:too_few_unique_points"), shape)
    return (
        F.when(F.trim("text") == "", one("warning:blank_line"))
        .when(F.size(words) < 7, one("error:too_few_values"))
        .when(F.size(words) % 2 == 0, one("error:odd_coordinate_count"))
        .when(~whole, one("error:invalid_class_id"))
        .when(F.exists(xy, lambda v: v.isNull()), F.concat(other, one("error:invalid_coordinate")))
        .when(F.exists(xy, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), F.concat(other, one("error:non_finite_coordinate")))
        .otherwise(rest)
    )


def check_lines(lines: DataFrame, class_id: int = 0) -> DataFrame:
    """lines with severity and code, a row per issue."""
    found = each_of(parsed_lines(lines).select(*lines.columns, F.explode_outer(line_codes(class_id)).alias("_c")), "_c")
    return found.withColumn("severity", F.substring_index("_c", ":", 1)).withColumn("code", F.substring_index("_c", ":", -1)).drop("_c")


def check_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """split, stem, severity, code: repeated stems, images without labels and labels without images.

    images: split, stem; labels: split, stem.
    """
    issue = lambda df, code: df.select("split", "stem", F.lit("error").alias("severity"), F.lit(code).alias("code"))
    repeated = images.groupBy("split", "stem").count().filter("count > 1")
    return issue(repeated, "duplicate_image_stem").unionByName(issue(labels.join(images, ["split", "stem"], "left_anti"), "orphan_label")).unionByName(issue(images.join(labels, ["split", "stem"], "left_anti"), "missing_label"))


def undecodable(files: DataFrame) -> DataFrame:
    """Files (path, content as binary) that are not UTF-8."""
    return files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.lit("error").alias("severity"), F.lit("label_decode_failed").alias("code"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.concat_ws(":", "severity", "code").alias("issue")).agg(F.count("*").alias("n"))


def split_totals(images: DataFrame, instances: DataFrame, issues: DataFrame) -> DataFrame:
    """Images, instances, errors and warnings per split, and in all (split ``total``)."""
    rows = (
        images.select("split", F.lit(1).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("w"))
        .unionByName(instances.select("split", F.lit(0).alias("i"), F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("w")))
        .unionByName(issues.select("split", F.lit(0).alias("i"), F.lit(0).alias("n"), (F.col("severity") == "error").cast("int").alias("e"), (F.col("severity") == "warning").cast("int").alias("w")))
    )
    return rows.rollup("split").agg(F.sum("i").alias("images"), F.sum("n").alias("instances"), F.sum("e").alias("errors"), F.sum("w").alias("warnings")).withColumn("split", F.coalesce("split", F.lit("total")))


def line_totals(lines: DataFrame, class_id: int = 0) -> DataFrame:
    """As split_totals() of label lines (split, stem, text), in one pass over them: each line is parsed once, and gives counts of its image, not rows."""
    codes = parsed_lines(lines).select("split", "stem", line_codes(class_id).alias("_c"))
    of = lambda severity: F.sum(F.coalesce(F.size(F.filter("_c", lambda c: F.startswith(c, F.lit(f"{severity}:")))), F.lit(0))).alias(severity)
    images = codes.groupBy("split", "stem").agg(F.count("*").alias("instances"), of("error"), of("warning"))
    out = images.rollup("split").agg(F.count("*").alias("images"), F.sum("instances").alias("instances"), F.sum("error").alias("errors"), F.sum("warning").alias("warnings"))
    return out.withColumn("split", F.coalesce("split", F.lit("total")))


def audit_codes(points: Column, box: Column, parsed: Column) -> Column:
    """The first failure of a detection or polygon label; null if it is sound."""
    outside = F.exists(points, lambda p: (p["x"] < 0) | (p["x"] > 1) | (p["y"] < 0) | (p["y"] > 1))
    return F.when(~parsed, "parse_error").when(outside, "invalid_label").when((box["w"] <= 0) | (box["h"] <= 0), "non_positive_box").when((polygon_area(points) <= 0) | self_intersects(points), "invalid_polygon")


def cross_split(files: DataFrame, key: str) -> DataFrame:
    """Keys (a video, a hash) that files of more than one split share."""
    return files.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("n")).filter(F.size("splits") > 1)


def ready(images: DataFrame, labels: DataFrame, splits=("train", "val", "test")) -> bool:
    """Whether each split has an image and a label."""
    has = lambda df: {r["split"] for r in df.select("split").distinct().collect()}
    return set(splits) <= has(images) & has(labels)


def assert_none(df: DataFrame, message: str) -> None:
    """Stops if the frame has a row."""
    if (first := df.limit(1).collect()) != []:
        raise ValueError(f"{message}: {first[0].asDict()}")


def first_errors(errors: DataFrame, most: int = 20) -> DataFrame:
    return errors.orderBy("image", "line").limit(most)


def hash_mismatches(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the manifest (name, sha256) whose file is gone or has none of its hashes (name, hashes: as it is, with LF, with CRLF)."""
    return manifest.join(current, "name", "left").filter(F.col("hashes").isNull() | ~F.array_contains("hashes", F.col("sha256"))).select("name", "sha256")


def model_contract(task: str, names: dict, wanted_task: str, wanted_names: dict) -> None:
    if task != wanted_task or {int(k): v for k, v in names.items()} != wanted_names:
        raise ValueError(f"a {wanted_task} model of classes {wanted_names} is needed, not {task} of {names}")


def capture_arguments(a: dict) -> dict:
    """Cross-checks of a capture's settings."""
    if a.get("fixed_test"):
        a = a | {"split": "test"}
    elif not a.get("batch"):
        raise ValueError("batch is needed unless fixed_test is set")
    size = [a.get(k) for k in ("width", "height", "fps")]
    if any(v is not None for v in size) and None in size:
        raise ValueError("width, height and fps go together")
    if any(v is not None and v <= 0 for v in [*size, a.get("duration"), a.get("segment")]):
        raise ValueError("sizes, rates and durations must be positive")
    return a


def pick_device(devices: DataFrame, serial: str | None) -> dict:
    """The device of that serial number, or the only one."""
    found = (devices.filter(F.col("serial") == serial) if serial else devices).limit(2).collect()
    if len(found) != 1:
        raise LookupError("device_not_found" if not found else "device_ambiguous")
    return found[0].asDict()


def next_free(spark: SparkSession, taken: DataFrame) -> int:
    """The first index from 1 that none of the taken ones (index) has: of n different ones over 0, it is n + 1 at most."""
    own = cut(taken.select("index").filter("index > 0").distinct())
    return spark.range(1, own.count() + 2).select(F.col("id").alias("index")).join(own, "index", "left_anti").agg(F.min("index")).first()[0]


def inside(root: str, path: str) -> str:
    """The resolved path, which must be under root."""
    from pathlib import Path

    at = Path(path).resolve()
    if not at.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside {root}")
    return str(at)
