"""Tagged text export of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import ROWS_PER_BUCKET, page

# The tags of an exported document, in output order, and the filter on its fields.
TAGS = ("<DOCID>", "<Content>", "<Img>", "<ShareSourceName>")
MIN_CONTENT_BYTES = 10
NO_IMAGE = "NULL"


def exportable(
    df: DataFrame,
    doc_id: str = "id",
    content: str = "content",
    img: str = "img",
    source: str = "shareSourceName",
) -> DataFrame:
    """The four exported columns of documents with enough content and an image.

    Content is measured in bytes, as SQL ``length`` does in the database the export comes from.
    """
    chosen = df.select(
        F.col(doc_id).alias("id"),
        F.col(content).alias("content"),
        F.col(img).alias("img"),
        F.col(source).alias("source"),
    )
    return chosen.filter(
        (F.octet_length("content") > MIN_CONTENT_BYTES) & (F.col("img") != NO_IMAGE)
    )


def tagged_block() -> Column:
    fields = ("id", "content", "img", "source")
    lines = [
        F.concat(F.lit(tag), F.coalesce(F.col(field).cast("string"), F.lit("")))
        for tag, field in zip(TAGS, fields)
    ]
    return F.concat_ws("\n", *lines)


def export_page(
    documents: DataFrame,
    offset: int,
    limit: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    ids: DataFrame | None = None,
) -> DataFrame:
    """One page, by id order, of exportable documents: ``id``, ``block``.

    ``ids`` may give the ids of all documents, so that placing the buckets reads no content.
    """
    paged = page(documents, "id", offset, limit, rows_per_bucket, ids)
    return paged.select("id", tagged_block().alias("block"))


def write_export(page_rows: DataFrame, path: str) -> None:
    """Write the blocks as text files that follow each other in id order."""
    ordered = page_rows.repartitionByRange("id").sortWithinPartitions("id")
    ordered.select("block").write.mode("overwrite").text(path)
