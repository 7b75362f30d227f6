"""Tags of a photo's header, read elsewhere, as the two texts the tables carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands in the cache for a file or a tag that can't be read.
NO_HEADER, NO_DATE, NO_DESCRIPTION, NO_FILE = "exif_not_found", "dt_not_found", "description_not_found", "file_not_valid"


def written(tag: Column) -> Column:
    """The tag, or null if it is all white space; an empty text counts as written."""
    return F.when(~tag.rlike(r"^\s+$"), tag)


def date_and_description(changed: Column, original: Column, description: Column, has_header: Column, readable: Column) -> dict[str, Column]:
    """The time of the original before that of the last change; sentinels for files without a header, and unreadable ones."""

    def marked(value: Column, missing: str) -> Column:
        return F.when(~readable, F.lit(NO_FILE)).when(~has_header, F.lit(NO_HEADER)).otherwise(F.coalesce(value, F.lit(missing)))

    return {"date_time": marked(F.coalesce(written(original), written(changed)), NO_DATE), "description": marked(written(description), NO_DESCRIPTION)}
