"""Projections of catalogue rows: what stands behind a row (edits, frames, copies elsewhere) as flags and stamps, and who stands for whom.

Facts that hang on a row in other tables are stacked and aggregated once by row id before they meet the rows, so each fact costs no join of its own.

Defined results: a row without facts has false flags, null stamps and no frames; nulls in a fact's row id belong to no row; repeated facts count once as flags;
repeated rows are projected each; an empty table gives no rows. Column names are those of the arguments' descriptions; other columns of the rows are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import display_size
from . import lookup

_FLAGS = ("is_edited", "frames_edited", "is_held", "is_elsewhere", "holder_active")
_STAMPS = ("own_stamp", "frames_stamp")


def row_facts(edits: DataFrame, sources: DataFrame, backups: DataFrame, blobs: DataFrame, peers: DataFrame, own_peer) -> DataFrame:
    """One row a photo that has any fact: photo_id, the flags is_edited, frames_edited, is_held, is_elsewhere and holder_active, own_stamp, frames_stamp and frame_count.

    ``edits``: photo_id, cursor, stamp; ``sources``: composed_id, photo_id; ``backups``: photo_id, health; ``blobs``: photo_id, peer_id; ``peers``: peer_id, kind, address."""
    dialable = peers.filter("kind = 'active' AND address IS NOT NULL").select("peer_id").distinct()
    frames = sources.join(edits, "photo_id")
    parts = [
        edits.select("photo_id", (F.col("cursor") > 0).alias("is_edited"), F.col("stamp").alias("own_stamp")),
        frames.select(F.col("composed_id").alias("photo_id"), (F.col("cursor") > 0).alias("frames_edited"), F.col("stamp").alias("frames_stamp")),
        sources.select(F.col("composed_id").alias("photo_id"), F.lit(1).alias("frame")),
        backups.filter("health = 'held'").select("photo_id", F.lit(True).alias("is_held")),
        blobs.filter(F.col("peer_id") != own_peer).select("photo_id", F.lit(True).alias("is_elsewhere")),
        blobs.join(dialable, "peer_id", "left_semi").select("photo_id", F.lit(True).alias("holder_active")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.filter("photo_id IS NOT NULL").groupBy("photo_id").agg(*(F.bool_or(c).alias(c) for c in _FLAGS), *(F.max(c).alias(c) for c in _STAMPS), F.count("frame").alias("frame_count"))


def with_facts(photos: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows (id, ...) with their facts, false and 0 where there are none."""
    joined = photos.join(facts.withColumnRenamed("photo_id", "id"), "id", "left")
    return joined.withColumns({**{c: F.coalesce(c, F.lit(False)) for c in _FLAGS}, "frame_count": F.coalesce("frame_count", F.lit(0))})


def composite_kind(kind: Column, kinds: tuple[str, ...]) -> Column:
    return F.when(kind.isin(*kinds), kind)


def bracket_kind(origin: Column, sequence: Column) -> Column:
    return F.when(origin == "bracket", sequence)


def edits_render(composite: Column) -> Column:
    """Whether edits make a row rendered: its frames' where it is composed (``composite`` not null), else its own."""
    return F.when(composite.isNotNull(), F.col("frames_edited")).otherwise(F.col("is_edited"))


def is_offloaded() -> Column:
    return F.col("is_missing") & F.col("is_held")


def is_gone() -> Column:
    """On no device that can be reached, nor on a backup."""
    return F.col("is_missing") & ~F.col("is_held") & ~F.col("is_elsewhere")


def original_elsewhere(library_reachable: Column) -> Column:
    """Null where the original is here, on a backup or nowhere; else whether a device that holds it, or one of its library, can be dialled."""
    return F.when(~F.col("is_missing") | F.col("is_held") | ~F.col("is_elsewhere"), F.lit(None).cast("string")).when(
        F.col("holder_active") | F.coalesce(library_reachable, F.lit(False)), "reachable"
    ).otherwise("unreachable")


def built_from(composite: Column) -> Column:
    """The newest stamp behind a row's copies: its own edits', its frames' and, where it is composed, its placement's; null if there is none."""
    stamps = (F.col("own_stamp"), F.col("frames_stamp"), F.when(composite.isNotNull(), F.col("stamp_placement")))
    return F.nullif(F.greatest(*(F.coalesce(s, F.lit("")) for s in stamps)), F.lit(""))


def summaries(photos: DataFrame, facts: DataFrame, stacks: DataFrame, peers: DataFrame, ordering: str, kinds: tuple[str, ...]) -> DataFrame:
    """A listing's row for each photo (id, library_id, stack_id, kind, sequence_kind, is_missing, is_deleted, date_taken, date_added, stamp_placement, triage).

    ``stacks``: id, origin, size; ``peers``: library_id, kind, address. ``ordering`` (taken_* or added_*) says which date a row is ordered by."""
    reach = peers.filter("kind = 'active' AND address IS NOT NULL").select("library_id", F.lit(True).alias("__reach")).distinct()
    rows = with_facts(photos, facts).join(stacks.select(F.col("id").alias("stack_id"), F.col("origin").alias("__origin"), F.col("size").alias("__size")), "stack_id", "left").join(reach, "library_id", "left")
    composite = composite_kind(F.col("kind"), kinds)
    return rows.select(
        "id", "library_id", "stack_id", composite.alias("composite_kind"), bracket_kind(F.col("__origin"), F.col("sequence_kind")).alias("bracket_kind"), "frame_count",
        F.coalesce("__size", F.lit(1)).alias("stack_size"), F.col("date_taken" if ordering.startswith("taken") else "date_added").alias("ordering_date"),
        F.when(F.col("triage").isin("picked", "rejected"), F.col("triage")).otherwise("untriaged").alias("triage"),
        "is_missing", "is_deleted", "is_edited", "frames_edited", edits_render(composite).alias("edits_render"), is_offloaded().alias("is_offloaded"),
        original_elsewhere(F.col("__reach")).alias("original_elsewhere"), built_from(composite).alias("built_from"),
    )


def hidden_shoots(shoots: DataFrame, exempt=None) -> DataFrame:
    """Ids of the shoots (id, folder_path, is_hidden) that are hidden or below one that is, but for one exempt."""
    below = lookup.at_or_below(shoots, "folder_path", shoots.filter("is_hidden"), "folder_path").select("id")
    return below if exempt is None else below.filter(F.col("id") != exempt)


def hidden(photos: DataFrame, shoots: DataFrame, exempt=None) -> DataFrame:
    """Adds ``hides``: the row's own flag, or its shoot's. Rows without a shoot have their own flag alone."""
    ids = hidden_shoots(shoots, exempt).select(F.col("id").alias("shoot_id"), F.lit(True).alias("__hides")).distinct()
    return photos.join(ids, "shoot_id", "left").withColumn("hides", F.coalesce("is_hidden", F.lit(False)) | F.coalesce("__hides", F.lit(False))).drop("__hides")


def _stands(photos: DataFrame, links: DataFrame) -> DataFrame:
    """Links (raw_id, camera_file_id) with both rows' is_deleted and gone, from ``with_facts`` rows."""
    side = lambda key, name: photos.select(F.col("id").alias(key), F.col("is_deleted").alias(f"{name}_deleted"), is_gone().alias(f"{name}_gone"))
    return links.select("raw_id", "camera_file_id").join(side("raw_id", "raw"), "raw_id").join(side("camera_file_id", "file"), "camera_file_id")


def not_a_camera_file(photos: DataFrame, links: DataFrame) -> DataFrame:
    """Rows that no RAW stands for: one binned alike whose original is to be had wherever the file's is."""
    stood = _stands(photos, links).filter("raw_deleted = file_deleted AND (NOT raw_gone OR file_gone)").select(F.col("camera_file_id").alias("id"))
    return photos.join(stood, "id", "left_anti")


def not_stood_for(photos: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of a listing: no frame of a composite that isn't deleted, and no camera file its RAW stands for."""
    frames = sources.join(photos.filter(~F.col("is_deleted")).select(F.col("id").alias("composed_id")), "composed_id", "left_semi").select(F.col("photo_id").alias("id"))
    return not_a_camera_file(photos, links).join(frames, "id", "left_anti")


def camera_file_of(photos: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """(raw_id, value): ``column`` of the smallest camera file binned like its RAW that isn't gone."""
    able = _stands(photos, links).filter("raw_deleted = file_deleted AND NOT file_gone").select("raw_id", "camera_file_id")
    return able.join(photos.select(F.col("id").alias("camera_file_id"), column), "camera_file_id").groupBy("raw_id").agg(F.min_by(column, "camera_file_id").alias(column))


def details(summary: DataFrame, fields: DataFrame, crops: DataFrame, copies: DataFrame, camera_files: DataFrame, albums: DataFrame, labels: DataFrame, full: str = "full") -> DataFrame:
    """A photo's own page: the rows of ``summaries`` with the fields that only it shows.

    ``fields``: id, width, height, canvas_width, canvas_height (of a composite; null of a file) and any others, which come along. ``crops``: photo_id, left, top, right, bottom, quarter_turns of the documents that can
    be read; a crop is of the canvas where there is one, for a composite's own size has it taken off already, and without a crop the row shows at its size. ``copies``: photo_id, variant, built_at, needs_build; the
    grid's and the ``full`` variant's. ``camera_files``: raw_id, format (``camera_file_of``). ``albums`` and ``labels``: photo_id and album_id or label_id; in order, each once.
    Rows without fields have nulls, without copies none built and none needed, without albums or labels empty lists."""
    built = lambda variant: F.max(F.when(F.col("variant") == variant, F.col("built_at")))
    needs = lambda variant: F.coalesce(F.bool_or(F.when(F.col("variant") == variant, F.col("needs_build"))), F.lit(False))
    made = copies.groupBy(F.col("photo_id").alias("id")).agg(built("grid").alias("tile_built_at"), needs("grid").alias("needs_tile"), built(full).alias("renditions_built_at"), needs(full).alias("needs_renditions"))
    crop = crops.groupBy(F.col("photo_id").alias("id")).agg(F.min(F.struct("left", "top", "right", "bottom", "quarter_turns")).alias("__crop"))
    listed = lambda rows, item: rows.groupBy(F.col("photo_id").alias("id")).agg(F.array_sort(F.collect_set(item)).alias(f"{item}s"))
    rows = summary
    for more in (fields, crop, made, camera_files.select(F.col("raw_id").alias("id"), F.col("format").alias("camera_file_format")), listed(albums, "album_id"), listed(labels, "label_id")):
        rows = rows.join(more, "id", "left")
    width, height = F.coalesce("canvas_width", "width"), F.coalesce("canvas_height", "height")
    shown = display_size(width, height, *(F.col(f"__crop.{c}") for c in ("left", "top", "right", "bottom", "quarter_turns")))
    none = F.lit(False)
    sizes = {name: F.when(F.col("__crop").isNull(), F.col(plain)).otherwise(s).cast("long") for name, plain, s in zip(("display_width", "display_height"), ("width", "height"), shown)}
    kinds = {f"{item}s": F.coalesce(f"{item}s", F.array().cast(f"array<{dict(table.dtypes)[item]}>")) for table, item in ((albums, "album_id"), (labels, "label_id"))}
    return rows.withColumns({**sizes, **kinds, "needs_tile": F.coalesce("needs_tile", none), "needs_renditions": F.coalesce("needs_renditions", none)}).drop("__crop")
