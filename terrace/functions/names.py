"""What file names say, and text as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of images, in lower case (fixed values).
IMAGES = ("arw", "cr2", "dng", "heic", "heif", "jpeg", "jpg", "nef", "png", "tif", "tiff")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def checkpoint_number(path: Column, most: int) -> Column:
    """The iteration in a name ``checkpoint_<digits>.ply``, from 1 to ``most``; null for any other name."""
    n = F.nullif(F.regexp_extract(file_name(path), "^checkpoint_([0-9]{1,18})\\.ply$", 1), F.lit("")).cast("long")
    return F.when(n.between(1, most), n)


def timestamp_of(path: Column) -> Column:
    """The number after the last underscore of a name without its extension; null if there is none."""
    stem = F.regexp_replace(file_name(path), "(.)\\.[^.]*$", "$1")
    return F.regexp_extract(stem, "_([^_]*)$", 1).try_cast("double")


def is_image(path: Column) -> Column:
    """Whether a name has the extension of an image, in either case."""
    return F.lower(F.regexp_extract(file_name(path), ".\\.([^.]*)$", 1)).isin(*IMAGES)


def json_string(text: Column) -> Column:
    """A text as a JSON string with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), "(?s)^.{5}(.*).$", 1)
