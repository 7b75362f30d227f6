"""Path and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def parts(path: Column) -> Column:
    return F.split(path, r"[\\/]")


def location_code(path: Column, length: int = 3) -> Column:
    """The only component of that length with a capital; `unknown` unless there is exactly one."""
    found = F.filter(parts(path), lambda p: (F.length(p) == length) & (p != F.lower(p)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(UNKNOWN)


def class_name(path: Column, classes: list[str]) -> Column:
    """The first component, in lower case, that is a class."""
    found = F.array_intersect(F.transform(parts(path), F.lower), F.array(*[F.lit(c) for c in classes]))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(UNKNOWN))


def class_after_location(path: Column, length: int = 3) -> Column:
    names = parts(path)
    at = F.array_position(names, location_code(path, length)).cast("int")
    return F.coalesce(F.when(at > 0, F.get(names, at)), F.lit(UNKNOWN))


def camera_id(description: Column) -> Column:
    return F.coalesce(F.array_join(F.slice(F.split(description, "__"), 1, 2), "-"), F.lit(""))


def camera(columns: list[str], description: str = "Description", location: str = "Location") -> Column:
    """The camera of the description, or the location in tables that have no column of descriptions."""
    return camera_id(F.col(description)) if description in columns else F.col(location)


def absolute(path: Column, root: str) -> Column:
    return F.when(path.rlike(r"^([A-Za-z]:)?[\\/]"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path), r"^[\\/]+", "")


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def parent_name(path: Column, up: int = 1) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1 - up)), F.lit(""))


def encode_frame(path: Column, frame: Column) -> Column:
    """A video's path as one file name: parts joined by `-_`, then `_` and the extension, then a four-digit frame number."""
    names = parts(path)
    folder = F.regexp_replace(F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), "-_"), ":", "")
    return F.concat(folder, F.lit("-_"), stem(path), F.lit("_"), F.substr(suffix(path), F.lit(2)), F.format_string("_%04d.jpg", frame))


def decode_frame(name: Column) -> Column:
    """The video's path again; the first part is a drive."""
    plain = F.regexp_replace(stem(name), r"_[^_]*$", "")
    plain = F.regexp_replace(plain, r"_([^_]*)$", ".$1")
    plain = F.regexp_replace(plain, r"^(.*?)-_", r"$1:\\")
    return F.replace(plain, F.lit("-_"), F.lit("\\"))
