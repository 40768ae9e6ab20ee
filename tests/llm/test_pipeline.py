import hashlib
import math
import random
import zlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import language, quality, stages

from .helpers import edge_docs, empty_docs
from .test_dedup import brute
from .test_mixing import fill
from .test_packing import whole_ids
from .test_quality import base, perplexity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rng = random.Random(4)
    parts = {"en": ("the of and to in", ["ing", "tion", "er", "ly", "ent", "sh", "wh", "ou"]), "de": ("der die und das mit", ["sch", "keit", "ung", "lich", "ver", "pf", "be", "ein"])}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        common, syllables = parts[lang]
        text = " ".join(rng.choice(common.split()) if rng.random() < 0.5 else "".join(rng.choices(syllables, k=3)) for _ in range(120))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(1000 + i, rows[i][1] + " end", rows[i][2], "s0", 1) for i in range(10)]
    rows += [(2000, "too short", "en", "s1", 9), (2001, None, "en", "s1", 0), (2002, "word " * 400, "en", "s1", 2000)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_in_turn(spark):
    docs = corpus(spark)
    kept = stages.quality_rules(spark, docs, "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {2000, 2001, 2002} and len(ids) >= 165
    spoken = stages.language_id(spark, kept, "")
    assert {r["doc_id"] for r in spoken.collect()} == ids
    unique = stages.near_dedup(spark, spoken, "")
    left = {r["doc_id"] for r in unique.collect()}
    assert left == {i for i in ids if i < 1000 or i - 1000 not in ids} and unique.count() == len(left)
    mixed = stages.source_mixing(spark, unique, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= left
    packed = stages.best_fit_packing(spark, mixed, "")
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packed.filter("piece = 0").count() == mixed.count()


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert out.count() > 0 and full <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_near_dedup", "source_mixing", "best_fit_packing"]


def test_edges(spark):
    empty, odd = empty_docs(spark), edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        out = stage(spark, odd, "")
        assert out.count() >= 0
        if stage is not stages.best_fit_packing:
            assert out.columns == odd.columns
    once = stages.near_dedup(spark, odd, "")
    assert once.filter("doc_id = 10").count() == 1 and {r["doc_id"] for r in once.collect()} >= {1, 2, 3, 4, 6, 8, 9, 10, 11, None}


def test_rows_without_an_id_or_with_a_shared_one_are_judged_by_their_texts(spark):
    docs = corpus(spark).filter("doc_id < 60")
    for one in (None, 7):
        same = docs.withColumn("doc_id", F.lit(one).cast("long"))
        junk = spark.createDataFrame([(one, "too short", "en", "s1", 9), (one, "1 2 3 " * 30, "en", "s1", 9)], COLUMNS)
        assert stages.quality_rules(spark, same.union(junk), "").count() == 60
        copies = same.union(same.limit(5)).union(same.limit(5).withColumn("text", F.concat("text", F.lit(" end"))))
        unique = stages.near_dedup(spark, copies, "")
        assert unique.count() == 60 and unique.select("text").distinct().count() == 60
        numbers = spark.createDataFrame([(one, "1 2 3 " * 30, "en", "s1", 9)], COLUMNS)
        learning = docs.withColumn("doc_id", F.col("doc_id") + 100)
        assert stages.language_id(spark, learning.union(same.union(numbers)), "").filter(F.col("doc_id").eqNullSafe(F.lit(one))).count() == 60


def one_of_each(rows, by):
    """Rows are dicts with k0 to k3 and columns; what ``quality.one_each`` says, group by group."""
    columns = list(rows[0])
    for k in ("k0", "k1", "k2", "k3"):
        rest = [c for c in dict.fromkeys(("k0", "k1", "k2", "k3", *columns)) if c != k and c not in by]
        best = {}
        for r in rows:
            key = (*(r[b] for b in by), r[k])
            if key not in best or tuple(r[c] for c in rest) < tuple(best[key][c] for c in rest):
                best[key] = r
        rows = list(best.values())
    return rows


def plain_quality(rows):
    h = {t: quality._hashed(t.encode().split(), quality._hashes()) for _, t, *_ in rows if t}
    keys = {t: dict(zip(quality.KEYS, quality._keys(v))) for t, v in h.items()}
    counted = one_of_each([{"text_key": xxhash.xxh3_64_intdigest(t.encode()) - 2**63, "n_bytes": len(t.encode()), **keys[t], "text": t} for t in h], [])
    texts = [r["text"] for r in counted]
    judged = texts + [t for t in h if t not in texts]
    nll = dict(zip(judged, perplexity(texts, 1 / 2048, [r[1] for r in rows if r[1]], judged)))
    passed = {t: base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0] for t in h}
    sample = one_of_each([{"lang": r[2], **keys[r[1]], "nll": nll[r[1]]} for r in rows if r[1] and passed[r[1]]], ["lang"])

    def band(values):
        bins = sorted(math.floor(v * 100) for v in values)
        at = lambda q: (next(b for i, b in enumerate(bins, 1) if sum(x <= b for x in bins) >= len(bins) * q) + 0.5) / 100
        q1, q2, q3 = at(0.25), at(0.5), at(0.75)
        return q2 - 7 * (q2 - q1 + 0.005), q2 + 7 * (q3 - q2 + 0.005)

    kept = []
    for r in rows:
        if r[1] and passed[r[1]]:
            mine = [s["nll"] for s in sample if s["lang"] == r[2]]
            low, high = band(mine if len(mine) >= 20 else [s["nll"] for s in sample])
            if low <= nll[r[1]] <= high:
                kept.append(r)
    return kept


def plain_language(rows, learned):
    kept = []
    for r in rows:
        raw = r[1].lower().encode()
        lead = raw[:256]
        starts = [i for i in range(len(lead)) if lead[i : i + 1].strip() and (i == 0 or not lead[i - 1 : i].strip())]
        starts = starts[:: math.ceil(len(starts) / 16)]
        sizes = []
        for _, content in sorted(learned.dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(dict_data=d, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
            n = lambda b: len(tool.compress(b))
            sizes.append(sum(n(lead[i:]) for i in starts) * len(lead) / sum(len(lead) - i for i in starts) + sum(n(raw[i : i + 1024]) for i in range(256, len(raw), 1024)))
        one, two = sorted(sizes)[:2]
        if 1 - one / two >= learned.margin:
            kept.append(r)
    return kept


def plain_mix(rows):
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    targets = fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}, 1.5, 2.0)
    out = []
    for s in size:
        mine = [(int(hashlib.md5(f"0:{r[0]}:{r[1]}".encode()).hexdigest()[:4], 16), r) for r in rows if r[3] == s]
        whole = int(targets[s] // size[s])
        more, upto, cut = targets[s] - whole * size[s], 0, -1
        for at in sorted({d for d, _ in mine}):
            before, upto = upto, upto + sum(len(r[1].split()) for d, r in mine if d == at)
            if upto <= more or abs(upto - more) < abs(before - more):
                cut = at
        out += [r for d, r in mine for _ in range(whole + (d <= cut))]
    return out


def test_run_against_a_brute_force_version(spark, tmp_path):
    docs = corpus(spark).union(corpus(spark).filter("doc_id BETWEEN 30 AND 60").withColumn("doc_id", F.col("doc_id") + 5000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    good = plain_quality(rows)
    frame = spark.createDataFrame(good, COLUMNS)
    good = plain_language(good, language.learn(frame.filter(~language.held_out(F.col("doc_id")))))
    linked = {d: c for d, _, c in brute([(r[0], r[1]) for r in good], 5, 80)}
    good = plain_mix([r for r in good if linked[r[0]] == r[0]])
    want = []
    for r in good:
        tokens = np.array([*whole_ids(r[1]), 0], "<u4")
        want += [(r[0], i, at, len(tokens[at : at + 2048]), zlib.crc32(tokens[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(tokens), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want) and len(want) > 100
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= 1.05 * math.ceil(sum(w[3] for w in want) / 2048) + 1
