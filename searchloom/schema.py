"""Table schemas: what is crawled, and the canonical document."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType


def _struct(names: str, **types: DataType) -> StructType:
    """Fields of strings, but for those whose type is given."""
    return StructType([StructField(n, types.get(n, StringType())) for n in names.split()])


CRAWL_ITEM = _struct(
    "url title content author date source scraped_at tags brand os category metadata device_name article_type specs price release_date",
    tags=ArrayType(StringType()),
    metadata=_struct("section image blog_type"),
    specs=MapType(StringType(), StringType()),
)

DOCUMENT = _struct(
    "id url title content author date scraped_at source tags category subcategory brand os device_name article_type",
    tags=ArrayType(StringType()),
)

#: Categories in load order: of equal ids the later category's document wins.
CATEGORIES = ("mobile", "pc", "general")
