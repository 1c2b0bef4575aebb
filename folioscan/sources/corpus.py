"""The inventory and the blocks of a collection.

``documents`` tables of plain texts stand for a scanned folder tree: path,
type, size and time follow from the row, every line with text is a block. In
Markdown the first such line is the heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE, normalized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(documents: DataFrame) -> DataFrame:
    """id, root, path, filename, extension, size_bytes, modified_at_ms, status; the text stays beside them for the blocks."""
    ext = F.element_at(F.create_map(*[F.lit(x) for pair in (("en", "txt"), ("fr", "md"), ("de", "adoc"), ("es", "sql")) for x in pair]), F.col("lang"))
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit("."), ext)
    root = F.concat(F.lit("/corpus/root"), F.col("doc_id") % 2)
    status = F.when(F.coalesce("text", F.lit("")).rlike(f"^[{WHITE}]*$"), "no_text").otherwise("indexed")
    return documents.select(
        F.col("doc_id").alias("id"), root.alias("root"), F.concat(root, F.lit("/"), F.col("source"), F.lit("/"), name).alias("path"), name.alias("filename"),
        F.concat(F.lit("."), ext).alias("extension"), F.col("n_chars").alias("size_bytes"), (F.lit(1.7e12) + (F.col("doc_id") * 7919 % 1000) * 1000.0).alias("modified_at_ms"), status.alias("status"), "text",
    )


BLANK = f"^[{WHITE}]*$"


def _lines(text: Column) -> Column:
    """The lines of a text; one end of lines is looked for where texts have no other, which takes no pattern."""
    return F.split(F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text), "\n")


def _blocks(inventory: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Each line with text as a row: its place, the heading, the content, and the same of other forms of the text with the same lines.

    What belongs to a document is made once, before its lines become rows: what
    a row of a line refers to is a column then, which no filter computes again
    (the outer form takes no filter in front that would make the lines twice).
    """
    rows = inventory.filter("status = 'indexed'").select(F.col("id").alias("document_id"), (F.col("extension") == ".md").alias("headed"), *[_lines(c).alias(f"content{kind}") for kind, c in texts.items()])
    first = F.when(F.col("headed"), F.array_position(F.transform("content", lambda x: x.rlike(BLANK)), False).cast("int") - 1)
    rows = rows.withColumn("first", first).select("document_id", *[F.get(f"content{kind}", F.col("first")).alias(f"heading{kind}") for kind in texts], F.arrays_zip(*[f"content{kind}" for kind in texts]).alias("lines"))
    rows = rows.select("document_id", *[f"heading{kind}" for kind in texts], F.posexplode_outer("lines").alias("ordinal", "line")).filter(~F.col("line.content").rlike(BLANK))
    shown = [F.col(f"line.content{kind}").alias(f"content{kind}") for kind in texts]
    place = [F.lit("line").alias("location_kind"), F.concat(F.lit("line "), F.col("ordinal") + 1).alias("location_value")]
    return rows.select("document_id", "ordinal", "heading", shown[0], *place, *[c for kind, c in zip(texts, shown) if kind for c in (F.col(f"heading{kind}"), c)])


def line_blocks(inventory: DataFrame) -> DataFrame:
    """document_id, ordinal (the line number from 0, gaps kept), heading, content, location of each line with text."""
    return _blocks(inventory, {"": F.col("text")})


def searchable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory, blocks) with the search columns in normal form.

    The normal form is taken of whole texts: it neither makes nor drops line
    ends, and no line end composes with what is beside it.
    """
    docs = inventory(documents).withColumn("filename_norm", normalized("filename"))
    blocks = _blocks(docs, {"": F.col("text"), "_norm": normalized("text")})
    return docs.drop("text"), blocks
