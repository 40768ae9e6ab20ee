"""Column expressions over slash-separated paths.

Defined results: null in, null out; a path without a slash has the empty folder and is its own leaf, one without a dot in its leaf the empty extension; the empty path has itself as its only prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File formats by extension; five raw and seven rendered.
RAW_FORMATS = ("arw", "cr3", "dng", "nef", "raf")
RENDERED_FORMATS = ("jpg", "jpeg", "png", "heic", "heif", "avif", "tif")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def format_class(path: Column) -> Column:
    """raw, rendered or null by extension."""
    return F.when(extension(path).isin(*RAW_FORMATS), "raw").when(extension(path).isin(*RENDERED_FORMATS), "rendered")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The leaf without its last extension."""
    return F.regexp_replace(leaf(path), r"\.[^.]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def prefixes(path: Column) -> Column:
    """The path and all folders above it, shortest first: the key of an equi join on "is, or is below"."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def below(path: Column, folder_path: str | Column) -> Column:
    """A comparison that Parquet's minima and maxima can prune where the folder is a literal: from ``folder/`` to just before ``folder0``."""
    if isinstance(folder_path, str):
        return (path >= F.lit(folder_path + "/")) & (path < F.lit(folder_path + "0"))
    return (path >= F.concat(folder_path, F.lit("/"))) & (path < F.concat(folder_path, F.lit("0")))


def is_direct_child(path: Column, folder_path: str) -> Column:
    return below(path, folder_path) & (F.instr(F.substr(path, F.lit(len(folder_path) + 2)), "/") == 0)


def moved(path: Column, old: str, new: str) -> Column:
    """The path after its folder ``old`` became ``new``; other paths stay."""
    return F.when(below(path, old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def in_scope(path: Column, excluded: list[str], bin_folder: str | None = None, recursive: bool = True) -> Column:
    """Not hidden (a segment that begins with a dot), not in the bin, not under an excluded prefix, and flat where not recursive."""
    ok = ~path.rlike(r"(^|/)\.")
    for p in [*excluded, *([bin_folder] if bin_folder else [])]:
        ok = ok & ~((path == p) | below(path, p))
    return ok if recursive else ok & (F.instr(path, "/") == 0)


def library_name(root: Column) -> Column:
    """The root's leaf; a leaf that is a year takes its parent along."""
    last, parent = leaf(root), leaf(folder(root))
    return F.when(last.rlike(r"^\d{4}$") & (parent != ""), F.concat_ws(" ", parent, last)).otherwise(last)


def quick_hash(path: Column, mtime: Column, size: Column) -> Column:
    """SHA-1 of extension, modification time and size: a change detector that reads no content."""
    return F.sha1(F.concat_ws("|", extension(path), mtime.cast("string"), size.cast("string")).cast("binary"))
