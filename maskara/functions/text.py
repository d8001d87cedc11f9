"""Names, paths, hashes and text forms as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def source_hint(name: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The label of the first prefix that the name starts with."""
    out = F.lit(otherwise) if not rules else F.when(F.startswith(name, F.lit(rules[0][0])), rules[0][1])
    for prefix, label in rules[1:]:
        out = out.when(F.startswith(name, F.lit(prefix)), label)
    return out.otherwise(otherwise) if rules else out


#: The prefixes of names that tell their source, and the source. Full names must match whole prefixes.
SHORT_SOURCES = [("local_test_images", "local_test_images"), ("my_labelme", "my_labelme"), ("roboflow_team128", "roboflow_team128_v5"), ("roboflow_drago", "roboflow_drago_v1")]
FULL_SOURCES = [(x, x) for x in ("local_test_images", "my_labelme", "roboflow_drago_v1", "roboflow_team128_v5")]


def short_source(name: Column) -> Column:
    return source_hint(name, SHORT_SOURCES, "unknown")


def policy_source(name: Column) -> Column:
    return source_hint(name, SHORT_SOURCES, "default")


def full_source(name: Column) -> Column:
    return source_hint(name, FULL_SOURCES, "unknown")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """With its dot, lower case; empty if there is none or it is the whole name."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """Case-folded and in NFC, which no built-in does."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.casefold()))


def scene_key(source: Column, name: Column) -> Column:
    return F.concat(folded(source), F.lit("::"), folded(F.substring_index(stem(name), ".rf.", 1)))


def label_path(image: Column) -> Column:
    """images/ becomes labels/, the suffix .txt."""
    return F.regexp_replace(F.regexp_replace(image, r"(^|/)images/", "$1labels/"), r"\.[^./]+$", ".txt")


def stable_id(path: Column) -> Column:
    """The sanitized stem's first 60 characters (``image`` if nothing is left of it) and ten digits of the path's SHA-1."""
    bare = F.btrim(F.regexp_replace(stem(path), "[^0-9A-Za-z_-]+", "_"), F.lit("_"))
    return F.concat(F.substring(F.when(bare == "", "image").otherwise(bare), 1, 60), F.lit("_"), F.substring(F.sha1(path), 1, 10))


def token(text: Column) -> Column:
    """Safe in a file name: runs of separators and special characters become one _, ends are bare, nothing is ``unknown``."""
    bare = F.regexp_replace(F.regexp_replace(text, r'[\\/\s]+|[:*?"<>|]', "_"), "_+", "_")
    bare = F.regexp_replace(bare, r"^[._]+|[._]+$", "")
    return F.coalesce(F.when(bare != "", bare), F.lit("unknown"))


def visual_prefix(name: Column) -> Column:
    """The number of six digits before the first _; null if there is none."""
    return F.when(F.rlike(name, F.lit(r"^\d{6}_")), F.substring(name, 1, 6).cast("int"))


def number_list(text: Column) -> Column:
    """Distinct numbers of a comma list, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def joined(values: Column, by: str) -> Column:
    return F.array_join(values, by)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def is_json_number(value: Column) -> Column:
    """Finite; events hold no others."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def fingerprint(roles: Column, names: Column, hashes: Column) -> Column:
    """An aggregate: SHA-256 over ``role NUL name NUL hash LF`` of all rows in the order of role and name."""
    line = F.concat(roles, F.lit("\0"), names, F.lit("\0"), hashes, F.lit("\n"))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(roles, names, line.alias("line")))), lambda x: x["line"]), "").cast("binary"), 256)


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))


def per_million(value: Column) -> Column:
    return F.rint(value * 1_000_000).cast("long")


def prompt_name(text: Column) -> Column:
    """Of NAME=TEXT."""
    return F.trim(F.substring_index(text, "=", 1))


def prompt_text(text: Column) -> Column:
    return F.trim(F.substr(text, F.instr(text, "=") + 1))


def truth(value: Column) -> Column:
    """true, True and 1 as a boolean; other texts are false."""
    return F.lower(value.cast("string")).isin("true", "1")


def license_id(source: Column) -> Column:
    return F.when(F.startswith(source, F.lit("roboflow_")), 1).otherwise(2)


#: The eight turns and flips, in order.
D4 = (
    "rot0",
    "flip_lr_rot0",
    "rot90",
    "flip_lr_rot90",
    "rot180",
    "flip_lr_rot180",
    "rot270",
    "flip_lr_rot270",
)


def d4_name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, D4)), index + 1)


def relative_path(path: Column, root: Column) -> Column:
    """Under root, or the bare name if it is not."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(basename(path))


def capture_name(date: Column, model: Column, serial: Column, scenes: Column, light: Column, index: Column) -> Column:
    scene = F.coalesce(F.get(F.filter(scenes, lambda x: x != ""), F.lit(0)), light)
    return F.format_string("%s_%s_%s_%s_%03d", date, token(model), token(serial), token(scene), index)


def newline_hashes(content: Column, name: Column) -> Column:
    """The SHA-256 of the bytes and, for text files, of the bytes with LF and with CRLF line ends."""
    text = F.encode(F.regexp_replace(F.decode(content, "ISO-8859-1"), "\r\n?", "\n"), "ISO-8859-1")
    crlf = F.encode(F.regexp_replace(F.decode(text, "ISO-8859-1"), "\n", "\r\n"), "ISO-8859-1")
    raw = F.sha2(content, 256)
    return F.when(suffix(name).isin(".json", ".tsv", ".csv", ".txt"), F.array_distinct(F.array(raw, F.sha2(text, 256), F.sha2(crlf, 256)))).otherwise(F.array(raw))
