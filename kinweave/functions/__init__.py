"""Column functions: text, dates, boxes, vectors and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c: Column) -> Column:
    """Sort key that folds the case of ASCII letters alone."""
    return F.translate(c, _UPPER, _LOWER)


def strip(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def person_label(person_id: Column, name: Column, named: Column) -> Column:
    """The name of a named person, else a label from the first eight letters of the id."""
    return F.when(named & name.isNotNull(), name).otherwise(F.concat(F.lit("Person "), F.substring(F.replace(person_id, F.lit("-"), F.lit("")), 1, 8)))


def is_live(mov_path: Column) -> Column:
    return F.coalesce(F.length(mov_path) > 0, F.lit(False))


def suffix(name: Column) -> Column:
    """The last dot and what follows, or an empty text; a leading dot begins no suffix."""
    return F.regexp_extract(name, r"^.+?(\.[^./]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def exif_month(tag: Column) -> Column:
    """YYYY-MM of an EXIF time: characters 0-4 and 5-7 if these are digits, whatever month they name."""
    year, month = F.substring(tag, 1, 4), F.substring(tag, 6, 2)
    return F.when(year.rlike("^[0-9]{4}$") & month.rlike("^[0-9]{2}$"), F.concat_ws("-", year, month))


def capture_month(*tags: Column, modified: Column) -> Column:
    """The month of the first EXIF tag that has one, else of the file's time in UTC."""
    return F.coalesce(*(exif_month(t) for t in tags), F.date_format(modified, "yyyy-MM"))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def iou(a: list[Column], a_size: tuple[Column, Column], b: list[Column], b_size: tuple[Column, Column]) -> Column:
    """Overlap over union of two boxes, each taken relative to its own image; 0 for empty boxes."""

    def relative(box: list[Column], size: tuple[Column, Column]) -> list[Column]:
        w, h = F.greatest(size[0], F.lit(1)), F.greatest(size[1], F.lit(1))
        return [box[0] / w, box[1] / h, box[2] / w, box[3] / h]

    p, q = relative(a, a_size), relative(b, b_size)
    width = F.greatest(F.lit(0.0), F.least(p[2], q[2]) - F.greatest(p[0], q[0]))
    height = F.greatest(F.lit(0.0), F.least(p[3], q[3]) - F.greatest(p[1], q[1]))
    both = width * height
    size = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    return both / F.greatest(size(p) + size(q) - both, F.lit(1e-9))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length one; a vector of hardly any length stays near zero."""
    return F.transform(a, lambda x: (x / F.greatest(norm(a), F.lit(1e-9))).cast("float"))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def stable_id(*parts: Column) -> Column:
    """An id that a retry gives again."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def set_key(ids: Column) -> Column:
    """One text for a set of ids, whatever their order."""
    return F.concat_ws(",", F.array_sort(ids))
