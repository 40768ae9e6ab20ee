"""XMP sidecars: XML documents beside a file, read into columns and written from them.

Defined results: null, empty and malformed documents give null fields; a document without a field gives null for it; other elements and attributes are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def read(spark: SparkSession, folder: str, pattern: str = "*.xmp") -> DataFrame:
    """(path, text) of the sidecars below a folder, one row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("content").cast("string").alias("text"))


def fields(text: Column, names: dict[str, str]) -> Column:
    """A struct of the named values (name -> attribute or element of ``rdf:Description``), as strings."""
    inner = ", ".join(f"`_{a}`:string, `{a}`:string" for a in dict.fromkeys(names.values()))
    schema = f"struct<`rdf:RDF`:struct<`rdf:Description`:struct<{inner}>>>"
    parsed = F.from_xml(F.when(F.trim(text) != "", text), schema, {"mode": "PERMISSIVE"})
    at = lambda a: parsed["rdf:RDF"]["rdf:Description"]
    return F.struct(*(F.coalesce(at(a)[f"_{a}"], at(a)[a]).alias(n) for n, a in names.items()))


def document(values: dict[str, Column]) -> Column:
    """A sidecar that holds the values, by attribute, of ``rdf:Description``; null values are left out."""
    escaped = {a: F.regexp_replace(F.regexp_replace(F.regexp_replace(v.cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;") for a, v in values.items()}
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f' {a}="'), v, F.lit('"'))) for a, v in escaped.items()]
    return F.concat(F.lit('<x:xmpmeta><rdf:RDF><rdf:Description'), F.concat_ws("", *parts), F.lit("/></rdf:RDF></x:xmpmeta>"))


def beside(rows: DataFrame, sidecars: DataFrame, path: str) -> DataFrame:
    """Rows with the text of their sidecar: the file's name with ``.xmp`` added, or else in place of its extension; null without one."""
    added, replaced = F.concat(F.col(path), F.lit(".xmp")), F.concat_ws("/", F.nullif(paths.folder(F.col(path)), F.lit("")), F.concat(paths.stem(F.col(path)), F.lit(".xmp")))
    one, two = (sidecars.select(F.col("path").alias(f"__{n}"), F.col("text").alias(f"__t{n}")) for n in (1, 2))
    joined = rows.join(one, added == F.col("__1"), "left").join(two, replaced == F.col("__2"), "left")
    return joined.withColumn("sidecar", F.coalesce("__t1", "__t2")).drop("__1", "__2", "__t1", "__t2")
