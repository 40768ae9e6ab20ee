"""Sidecars as others write them, lens curves, label lists and renamed folders, worked out by hand or by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import lens
from vellum.operators import labels, relocation
from vellum.sources import develop

HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" '
TAIL = "</rdf:Description></rdf:RDF></x:xmpmeta>"
NEW = 'crs:ProcessVersion="11.0" crs:HasSettings="True" '


def curve(name, *points):
    return f"<crs:{name}><rdf:Seq>" + "".join(f"<rdf:li>{x}, {y}</rdf:li>" for x, y in points) + f"</rdf:Seq></crs:{name}>"


def test_edits_of_sidecars(spark):
    texts = {
        "empty": "", "none": None, "broken": "<x:xmpmeta", "text": "no xml",
        "rating": HEAD + 'xmp:Rating="3">' + TAIL,
        "clamped": HEAD + NEW + 'crs:Exposure2012="+9.5" crs:Contrast2012="12.5" crs:Whites2012="-12.5" crs:Blacks2012="much">' + TAIL,
        "element": HEAD + NEW + "><crs:Exposure2012>-0.75</crs:Exposure2012>" + TAIL,
        "applied": HEAD + NEW + 'crs:AlreadyApplied="true" crs:Exposure2012="1">' + TAIL,
        "old crop": HEAD + 'crs:ProcessVersion="5.7" crs:HasCrop="True" crs:CropLeft="0.25" crs:Exposure2012="2">' + curve("ToneCurve", (0, 0), (255, 255)) + TAIL,
        "old tone": HEAD + 'crs:ProcessVersion="5.7" crs:HasCrop="True" crs:CropLeft="0.25" crs:FillLight="4">' + TAIL,
        "old curve": HEAD + 'crs:ProcessVersion="6.5" crs:HasSettings="1">' + curve("ToneCurve", (0, 0), (90, 128), (255, 255)) + TAIL,
        "first new": HEAD + 'crs:ProcessVersion="6.6" crs:HasSettings="1" crs:Dehaze="7.5">' + TAIL,
        "uncropped": HEAD + NEW + 'crs:HasCrop="False" crs:CropLeft="0.25" crs:CropAngle="3">' + TAIL,
        "no area": HEAD + NEW + 'crs:HasCrop="True" crs:CropLeft="0.5" crs:CropRight="0.5">' + TAIL,
        "pixels": HEAD + NEW + 'crs:HasCrop="True" crs:CropLeft="0.5" crs:CropUnits="1">' + TAIL,
        "left out": HEAD + NEW + 'crs:PerspectiveVertical="4" crs:GrainAmount="30" crs:IncrementalTint="2">' + curve("ToneCurvePV2012Red", (0, 0), (128, 140), (255, 255)) + TAIL,
        "warm": HEAD + NEW + 'crs:WhiteBalance="Custom" crs:Temperature="5500" crs:Tint="-4">' + TAIL,
        "half": HEAD + NEW + 'crs:Temperature="5500">' + TAIL,
    }
    rows = spark.createDataFrame(list(texts.items()), "refused_name string, xmp string")
    got = {r["refused_name"]: r for r in develop.with_edits(rows, "xmp").collect()}
    assert {k: r["refused"] for k, r in got.items() if r["refused"]} == {
        "empty": "unreadable", "none": "unreadable", "broken": "unreadable", "text": "unreadable", "rating": "nothing stated", "applied": "applied", "old tone": "older controls", "old curve": "older controls",
    }
    assert all((r["edits"] is None) == (r["notes"] is None) == (r["refused"] is not None) for r in got.values())
    edits = {k: r["edits"] for k, r in got.items()}
    assert (edits["clamped"]["exposure"], edits["clamped"]["contrast"], edits["clamped"]["whites"], edits["clamped"]["blacks"]) == (5.0, 13.0, -12.0, 0.0)
    assert edits["element"]["exposure"] == -0.75 and edits["first new"]["dehaze"] == 7.5
    assert (edits["old crop"]["crop_left"], edits["old crop"]["exposure"], got["old crop"]["notes"]) == (0.25, 0.0, ["older but untouched", "settings not flagged"])
    for name in ("uncropped", "no area", "pixels"):
        assert [edits[name][f] for f in ("crop_left", "crop_right", "crop_angle")] == [0.0, 1.0, 0.0]
    assert got["pixels"]["notes"] == ["crop in pixels"]
    assert got["left out"]["left_out"] == ["GrainAmount", "perspective", "point curves"] and got["left out"]["notes"] == ["relative white balance"]
    assert (edits["warm"]["white_balance"], edits["warm"]["temperature"], edits["warm"]["tint"]) == ("Custom", 5500.0, -4.0)
    assert edits["half"]["temperature"] is None and got["half"]["notes"] == ["half white balance"]
    assert develop.with_edits(rows.limit(0), "xmp").count() == 0


def test_lens_curves(spark):
    def spline(knots, r):
        if not knots:
            return 0.0
        at = min(max(r * (len(knots) - 1), 0.0), len(knots) - 1)
        i = int(at)
        return (knots[i] + (knots[min(i + 1, len(knots) - 1)] - knots[i]) * (at - i)) / 16384

    def crop(knots, w, h):
        n, half = (max(len(knots), 2) - 1) * 32, ((w / 2) ** 2 + (h / 2) ** 2) ** 0.5
        edge, reach, out = min(w, h) / 2 / half, 0.0, 1.0
        for r in sorted([*(i / n for i in range(n + 1)), edge]):
            reach = max(reach, r * (1 + spline(knots, r)))
            if r >= edge and reach > 0:
                out = min(out, r / reach)
        return out * (1 - 1e-5) if out < 1 else out

    rng = random.Random(2)
    cases = [([], 0.4), ([0.0], 0.7), ([0.0, 1638.4], 0.5), (None, 0.5), ([0.0, 100.0], None)] + [([rng.uniform(-3000, 3000) for _ in range(rng.randint(2, 9))], rng.uniform(-0.2, 1.3)) for _ in range(40)]
    rows = spark.createDataFrame([(i, k, r, float(rng.randint(100, 900)), 500.0) for i, (k, r) in enumerate(cases)], "i int, knots array<double>, r double, w double, h double")
    got = rows.withColumns({"d": lens.displacement(F.col("knots"), F.col("r")), "c": lens.filling_crop(F.col("knots"), F.col("w"), F.col("h"))}).orderBy("i").collect()
    for row in got:
        known = row["knots"] is not None
        assert row["d"] == (pytest.approx(spline(row["knots"], row["r"]), abs=1e-12) if known and row["r"] is not None else 0.0 if row["knots"] == [] else None)
        assert row["c"] == (pytest.approx(crop(row["knots"], row["w"], row["h"]), abs=1e-12) if known else None)
    made = spark.range(1).select(lens.knots_of(F.lit(0.1), F.lit(-0.05), 5).alias("k"), lens.knots_of(F.lit(None).cast("double"), F.lit(1.0), 5).alias("none")).first()
    assert made["none"] is None and made["k"] == [round((0.1 * u * u - 0.05 * u**4) * 16384) for u in (0, 0.25, 0.5, 0.75, 1)]


def test_saved_labels(spark):
    held = spark.createDataFrame([("l", i, f"n{i}", None, p, "a", "b") for p, i in enumerate(["p", "q", "r", "s"])] + [("other", "z", "n", "red", 4, "a", "b"), ("l", None, "x", None, 9, "a", "b")], "library string, id string, name string, colour string, position long, stamp string, stamp_position string")
    ordered = spark.createDataFrame([("l", "s", "ns", None, 0), ("l", "new", "fresh", "red", 1), ("l", "q", "other", None, 2), ("l", "q", "twice", None, 5), ("l", None, "none", None, 3)], "library string, id string, name string, colour string, place int")
    removed = spark.createDataFrame([("l", "r"), ("l", "r"), ("l", "unknown")], "library string, id string")
    got = {r["id"]: (r["name"], r["position"], r["stamp"], r["stamp_position"], r["action"]) for r in labels.saved(held, ordered, removed, F.lit("now")).collect()}
    assert got == {
        "s": ("ns", 0, "a", "now", "move"), "new": ("fresh", 1, "now", "now", "insert"), "q": ("other", 2, "now", "now", "rename and move"), "p": ("np", 3, "a", "now", "move"), "r": ("nr", 2, "a", "b", "delete"),
    }
    again = labels.saved(held, removed.limit(0).selectExpr("library", "id", "id AS name", "id AS colour", "1 AS place"), removed.limit(0), F.lit("now"))
    assert again.count() == 0
    listed_though_removed = labels.saved(held, ordered.filter("id = 's'"), removed.limit(0).union(spark.createDataFrame([("l", "s")], removed.schema)), F.lit("now"))
    assert sorted(r["action"] for r in listed_though_removed.filter("id = 's'").collect()) == ["delete", "insert"]


def plain_relocated(shoots, dirs):
    held, seen, claimed, out = {s[1] for s in shoots}, {d[0]: d for d in reversed(dirs)}, set(), []
    for id_, path, dev, ino, birth in shoots:
        if dev is None or ino is None or path in seen:
            continue
        fits = [d[0] for d in seen.values() if d[1:3] == (dev, ino) and d[0] not in held and d[0] not in claimed and (not birth or not d[3] or birth == d[3])]
        if len(fits) == 1:
            claimed.add(fits[0])
            out.append((id_, path, fits[0]))
    return out


def test_relocations_against_a_plain_loop(spark):
    rng = random.Random(4)
    some = lambda *v: rng.choice(v)
    for n in (0, 12, 60, 200):
        shoots = [(i, f"p{rng.randint(0, 2 * n)}-{i}", some(1, 1, 2, None), some(*range(1, max(2, n // 3)), None), some(None, 0, 1, 2, 3)) for i in range(n)]
        dirs = [(some(f"d{i}", f"d{i}", f"d{i}", shoots[i][1]), some(1, 1, 2, None), some(*range(1, max(2, n // 3)), None), some(None, 0, 1, 2, 3)) for i in range(n)]
        schema = "path string, dev long, ino long, birth long"
        got = relocation.relocated(spark.createDataFrame(shoots, f"id long, {schema}"), spark.createDataFrame(dirs + dirs[:3], schema))
        assert sorted(tuple(r) for r in got.collect()) == sorted(plain_relocated(shoots, dirs))
    hot = [(i, f"old{i}", 1, 7, i % 5) for i in range(3000)]
    twins = [(f"new{i}", 1, 7, i % 3 + 10) for i in range(3000)] + [("one", 1, 7, 4), ("known", 1, 7, 3)]
    got = relocation.relocated(spark.createDataFrame(hot, "id long, path string, dev long, ino long, birth long"), spark.createDataFrame(twins, "path string, dev long, ino long, birth long"))
    assert sorted(tuple(r) for r in got.collect()) == [(3, "old3", "known"), (4, "old4", "one")]
