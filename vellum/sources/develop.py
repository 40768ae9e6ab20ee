"""Develop settings in XMP sidecars, taken over as edit fields: what can be carried, what is left out, and why a document is refused.

A document is refused as a whole where its settings are applied to the pixels already (``applied``), where it states none (``nothing stated``) and where its tone
was set with controls from before process version 6.6 (``older controls``), which have no counterpart. An older document whose tone is untouched gives what has no era.
A white balance goes by temperature and tint together, a crop only if it is switched on, in fractions, and has an area.

Defined results: null, empty and malformed documents are refused as ``unreadable``; values that are no number are as if absent; numbers outside a setting's range are drawn to its end and whole settings
are rounded half up; of repeated elements none counts; ``left_out`` names the settings that stand anywhere in the document and have no field, in order of name; equal documents give equal results; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, by field: the setting, its least and largest value, and whether it is whole. They are 0 where nothing was done.
ANY_ERA = {"texture": ("Texture", -100, 100, True), "vibrance": ("Vibrance", -100, 100, True), "saturation": ("Saturation", -100, 100, True)}
NEW_ERA = {
    "exposure": ("Exposure2012", -5, 5, False), "contrast": ("Contrast2012", -100, 100, True), "highlights": ("Highlights2012", -100, 100, True),
    "shadows": ("Shadows2012", -100, 100, True), "whites": ("Whites2012", -100, 100, True), "blacks": ("Blacks2012", -100, 100, True),
    "clarity": ("Clarity2012", -100, 100, True), "dehaze": ("Dehaze", -100, 100, False),
}
OLD_ERA = (("Exposure", -4, 4, False), ("Brightness", 0, 150, True), ("Contrast", -50, 100, True), ("Shadows", 0, 100, True), ("HighlightRecovery", 0, 100, True), ("FillLight", 0, 100, True), ("Clarity", -100, 100, True))
CROP = {"crop_left": ("CropLeft", 0, 1, 0.0), "crop_top": ("CropTop", 0, 1, 0.0), "crop_right": ("CropRight", 0, 1, 1.0), "crop_bottom": ("CropBottom", 0, 1, 1.0), "crop_angle": ("CropAngle", -45, 45, 0.0)}
WARMTH, TINT = ("Temperature", 2000, 50_000, True), ("Tint", -150, 150, True)
RELATIVE = (("IncrementalTemperature", -100, 100, True), ("IncrementalTint", -100, 100, True))
TILT = (("PerspectiveVertical", -100, 100, True), ("PerspectiveHorizontal", -100, 100, True), ("PerspectiveRotate", -10, 10, False))
SPLIT = tuple((f"Parametric{name}", -100, 100, True) for name in ("Shadows", "Darks", "Lights", "Highlights"))
CURVES = tuple(f"ToneCurvePV2012{channel}" for channel in ("", "Red", "Green", "Blue"))
OLD_CURVES = tuple(f"ToneCurve{channel}" for channel in ("", "Red", "Green", "Blue"))
PLAIN = ("ProcessVersion", "HasSettings", "AlreadyApplied", "HasCrop", "WhiteBalance")
#: The first process version with the newer controls.
NEWER_FROM = (6.0, 6.0)

_UNITS = ("CropUnits", 0, 3, True)
_NUMBERS = [*ANY_ERA.values(), *NEW_ERA.values(), *OLD_ERA, *((*s[:3], False) for s in CROP.values()), WARMTH, TINT, *RELATIVE, *TILT, *SPLIT, _UNITS]
_STATED = [*PLAIN, *(s[0] for s in _NUMBERS)]
#: What the fields or the notes account for, or no edit states.
_ACCOUNTED = [*_STATED, *CURVES, *OLD_CURVES, "Version", "ToneCurveName", "ToneCurveName2012", "RawFileName"]


def _parsed(text: Column) -> Column:
    plain = ", ".join(f"`_crs:{n}`:string, `crs:{n}`:string" for n in _STATED)
    curves = ", ".join(f"`crs:{n}`:struct<`rdf:Seq`:struct<`rdf:li`:array<string>>>" for n in (*CURVES, *OLD_CURVES))
    return F.from_xml(F.when(F.trim(text) != "", text), f"struct<`rdf:RDF`:struct<`rdf:Description`:struct<{plain}, {curves}>>>", {"mode": "PERMISSIVE"})


class _Document:
    """The settings of a parsed document as columns."""

    def __init__(self, parsed: Column):
        self.at = parsed["rdf:RDF"]["rdf:Description"]

    def stated(self, name: str) -> Column:
        return F.trim(F.coalesce(self.at[f"_crs:{name}"], self.at[f"crs:{name}"]))

    def flag(self, name: str) -> Column:
        return F.coalesce(F.lower(self.stated(name)).isin("true", "1"), F.lit(False))

    def value(self, setting: tuple) -> Column:
        name, least, most, whole = setting
        v = F.nullif(self.stated(name).try_cast("double"), F.lit(float("nan")))
        v = F.floor(v + 0.5).cast("double") if whole else v
        return F.when(F.abs(v) < float("inf"), F.greatest(F.least(v, F.lit(float(most))), F.lit(float(least)))).alias(name)

    def number(self, setting: tuple) -> Column:
        return F.col(f"__numbers.{setting[0]}")

    def moved(self, setting: tuple) -> Column:
        return F.coalesce(self.number(setting) != 0, F.lit(False))

    def bent(self, name: str) -> Column:
        """Whether a curve that is stated is other than the straight line from corner to corner."""
        points = F.transform(self.at[f"crs:{name}"]["rdf:Seq"]["rdf:li"], lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).try_cast("double")))
        points = F.filter(points, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))
        points = F.transform(points, lambda p: F.transform(p, lambda v: F.greatest(F.least(F.floor(v + 0.5), F.lit(255)), F.lit(0))))
        off = F.exists(points, lambda p: p[0] != p[1]) | (F.try_element_at(points, F.lit(1))[0] != 0) | (F.try_element_at(points, F.lit(-1))[0] != 255)
        return F.coalesce((F.size(points) > 0) & off, F.lit(False))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _listed(**conditions: Column) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n.replace("_", " "))) for n, c in conditions.items())), lambda x: x.isNotNull())


def with_edits(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``edits`` (a struct of fields, null where refused), ``refused``, ``notes`` and ``left_out`` of the document in the column ``text``."""
    rows = rows.withColumn("__doc", _parsed(F.col(text)))  # a column of its own, so that a document is parsed once
    doc = _Document(F.col("__doc"))
    rows = rows.withColumn("__numbers", F.struct(*(doc.value(s) for s in _NUMBERS)))  # and each number read once
    version = doc.stated("ProcessVersion")
    parts = F.when(version.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(version, r"\."), lambda p: p.cast("double")))
    older = ~F.coalesce(parts >= F.array(*map(F.lit, NEWER_FROM)), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fields = {n: zero(doc.number(s)) for n, s in ANY_ERA.items()} | {n: F.when(older, 0.0).otherwise(zero(doc.number(s))) for n, s in NEW_ERA.items()}

    edge = {n: F.coalesce(doc.number(s), F.lit(s[3])) for n, s in CROP.items()}
    cropped = doc.flag("HasCrop") & (edge["crop_left"] < edge["crop_right"]) & (edge["crop_top"] < edge["crop_bottom"])
    absolute = F.coalesce(doc.number(_UNITS).isin(1.0, 2.0), F.lit(False))
    fields |= {n: F.when(cropped & ~absolute, e).otherwise(F.lit(CROP[n][3])) for n, e in edge.items()}

    warmth, tint = doc.number(WARMTH), doc.number(TINT)
    both = warmth.isNotNull() & tint.isNotNull()
    mode = F.coalesce(F.nullif(doc.stated("WhiteBalance"), F.lit("")), F.lit("As Shot"))
    touched = _any([*(v != (CROP[n][3] if n in CROP else 0.0) for n, v in fields.items()), both, mode != "As Shot"])
    fields |= {"white_balance": mode, "temperature": F.when(both, warmth), "tint": F.when(both, tint)}

    old_tone = older & _any([*(doc.moved(s) for s in OLD_ERA), *(doc.bent(c) for c in OLD_CURVES)])
    flagged = doc.flag("HasSettings")
    refused = (
        F.when(doc.at.isNull(), "unreadable").when(doc.flag("AlreadyApplied"), "applied").when(~touched & ~flagged, "nothing stated").when(old_tone, "older controls")
    )
    notes = _listed(
        half_white_balance=warmth.isNotNull() != tint.isNotNull(), relative_white_balance=_any(doc.moved(s) for s in RELATIVE), crop_in_pixels=cropped & absolute,
        older_but_untouched=older, settings_not_flagged=~flagged,
    )
    unmatched = F.array_except(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"""[\s<]crs:([A-Za-z0-9]+)(?=\s*=\s*["']|[\s/>])"""), F.lit(1))), F.array(*map(F.lit, _ACCOUNTED)))
    curves = ~older & _any(doc.bent(c) for c in CURVES)
    named = _listed(perspective=_any(doc.moved(s) for s in TILT), parametric_curve=_any(doc.moved(s) for s in SPLIT), point_curves=curves)
    out = rows.withColumn("__e", F.struct(refused.alias("refused"), notes.alias("notes"), F.array_sort(F.concat(named, unmatched)).alias("left_out"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("edits")))
    taken = F.when(F.col("__e.refused").isNull(), F.col("__e.edits"))
    return out.withColumns({"edits": taken, "refused": F.col("__e.refused"), "notes": F.when(taken.isNotNull(), F.col("__e.notes")), "left_out": F.when(F.col("__e.refused").eqNullSafe("unreadable"), None).otherwise(F.col("__e.left_out"))}).drop("__e", "__doc", "__numbers")
