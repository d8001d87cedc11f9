"""Writers: tables, labels, JSON documents, reports."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, functions as F


def fixed_table(df: DataFrame, path: str, digits: int = 6, sep: str = "\t") -> None:
    """Delimited text with a header, doubles with so many decimals; an empty table gives files without a line."""
    out = df.select(*(F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in df.dtypes))
    raw_table(out, path, sep, header=not df.isEmpty())


def raw_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, emptyValue="", nullValue="")


def shaped_table(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """With just these columns; those that df lacks are empty."""
    have = set(df.columns)
    raw_table(df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns)), path, sep)


def json_summary(row: DataFrame, path: str, ascii_sorted: bool = False) -> None:
    """A one-row frame as an indented JSON document, on the driver."""
    doc = json.loads(row.select(F.to_json(F.struct("*"))).first()[0])
    Path(path).write_text(json.dumps(doc, indent=2, ensure_ascii=ascii_sorted, sort_keys=ascii_sorted) + "\n", encoding="utf-8")


def events(df: DataFrame, path: str) -> None:
    """A JSON line per event; the folder must not exist."""
    df.write.mode("errorifexists").json(path)


def label_line(points: Column, class_id: Column, confidence: Column | None = None, digits: int = 6) -> Column:
    """class x y ... with fixed decimals, and the confidence last if there is one."""
    f = lambda v: F.format_string(f"%.{digits}f", v)
    coords = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", f(p["x"]), f(p["y"]))), " ")
    return F.concat_ws(" ", class_id.cast("string"), coords, *([f(confidence)] if confidence is not None else []))


def label_files(inventory: DataFrame, rows: DataFrame, folder: str, digits: int = 6) -> DataFrame:
    """stem and content of every image's label file, empty where it has no row, written as a Parquet table of files."""
    text = rows.select("stem", "idx", label_line(F.col("points"), F.col("class_id"), F.col("confidence"), digits).alias("text"))
    whole = text.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("content"))
    out = inventory.select("stem").join(whole, "stem", "left").select("stem", F.coalesce("content", F.lit("")).alias("content"))
    out.write.mode("overwrite").parquet(folder)
    return out


def export_labels(files: DataFrame, folder: str) -> None:
    """The files of label_files() under a mounted folder, by rename."""

    def write(rows):
        for r in rows:
            at = Path(folder, f"{r['stem']}.txt")
            (other := at.with_suffix(f".{uuid.uuid4().hex}")).write_text(r["content"], encoding="utf-8")
            other.replace(at)

    files.foreachPartition(write)


def coco(images: DataFrame, instances: DataFrame, category: str) -> DataFrame:
    """One row of the COCO document: images (file_name, width, height), instances (file_name, line, box, area, polygon); ids from 1 in order."""
    numbered = images.withColumn("id", F.row_number().over(Window.orderBy("file_name")).cast("long"))
    notes = instances.join(numbered.select("file_name", F.col("id").alias("image_id")), "file_name").withColumn("id", F.row_number().over(Window.orderBy("image_id", "line")).cast("long"))
    a = numbered.agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    b = notes.agg(F.array_sort(F.collect_list(F.struct("id", "image_id", F.lit(1).alias("category_id"), F.col("box").alias("bbox"), "area", F.array("polygon").alias("segmentation"), F.lit(0).alias("iscrowd")))).alias("annotations"))
    return a.crossJoin(b).select(F.create_map(F.lit("description"), F.lit("")).alias("info"), F.array(F.struct(F.lit(1).alias("id"), F.lit(category).alias("name"))).alias("categories"), "images", "annotations")


def coco_parts(images: DataFrame, annotations: DataFrame, head: dict, path: str) -> None:
    """A COCO document as text whose part files, one after another, are the document: no task holds more than its range of ids.

    images and annotations: id (1, 2, ... without gaps) and what else their objects hold; head: the document's other fields.
    """
    spark = images.sparkSession

    def objects(rows: DataFrame, section: int) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), "id", F.concat(F.when(F.col("id") == 1, "").otherwise(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))

    text = json.dumps(head, ensure_ascii=False)[:-1]
    marks = [(0, text + (", " if head else "") + '"images": ['), (2, '], "annotations": ['), (4, "]}")]
    frame = spark.createDataFrame([(k, 0, v) for k, v in marks], "section int, id long, value string")
    rows = frame.unionByName(objects(images, 1)).unionByName(objects(annotations, 3))
    rows.repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("value").write.mode("overwrite").text(path)


def coco_counts(doc: DataFrame) -> DataFrame:
    """What a written document holds when it is read again."""
    return doc.select(F.size("images").cast("long").alias("n_images"), F.size("annotations").cast("long").alias("n_annotations"))


def markdown(df: DataFrame, most: int, digits: int = 4) -> str:
    """The first rows of an ordered frame as a Markdown table."""
    rows = df.limit(most).collect()
    text = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(text(v) for v in r) + " |" for r in rows)]) + "\n"


def append_manifest(df: DataFrame, path: str) -> None:
    """Adds files of its own to the table, so that writers never share one."""
    df.write.mode("append").csv(path, header=True)


def publish(spark, made: str, at: str, force: bool = False) -> None:
    """Moves a finished folder into place; what stood there is kept beside it until the move is done."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    src, dst, old = path(made), path(at), path(f"{at}.old-{uuid.uuid4().hex}")
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(dst):
        if not force:
            raise FileExistsError(at)
        fs.rename(dst, old)
    if not fs.rename(src, dst):
        if fs.exists(old):
            fs.rename(old, dst)
        raise OSError(f"cannot move {made} to {at}")
    fs.delete(old, True)
