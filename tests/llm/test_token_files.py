import numpy as np
import pytest

from vellum.llm import token_files

from .helpers import edge_docs, empty_docs
from .test_packing import whole_ids


def brute(flat, separator):
    out, start = [], 0
    for i, x in enumerate(flat):
        if x == separator:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(flat):
        out.append((start, len(flat) - start, False))
    return out


def test_scan_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    files, want = [], {}
    for n, share in ((0, 0), (1, 1), (1, 0), (1000, 0.1), (5000, 0.001), (777, 0.6), (64, 0)):
        flat = rng.integers(1, 60_000, n).astype("<u2")
        flat[rng.random(n) < share] = 7
        name = f"{tmp_path}/{len(files)}.tokens"
        flat.tofile(name)
        files.append((f"file:{name}", 2 * n))
        want[f"file:{name}"] = brute(flat, 7)
    df = spark.createDataFrame(files, "file string, bytes long")
    for block in (16, 64, 1 << 20):
        got = {}
        for r in token_files.scan(df, 7, "<u2", block).orderBy("file", "ordinal").collect():
            assert r["ordinal"] == len(got.setdefault(r["file"], []))
            got[r["file"]].append((r["start"], r["n_tokens"], r["terminated"]))
        assert got == {f: w for f, w in want.items() if w}


def test_odd_sizes_are_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        token_files.scan(spark.createDataFrame([(f"file:{tmp_path}/x", 3)], "file string, bytes long")).collect()


def test_counts_of_texts(spark):
    df = edge_docs(spark)
    rows = token_files.count_tokens(df).collect()
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=repr)
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    plain = [(i, len(whole_ids(t))) for i, t in texts if "<|" not in (t or "")]
    assert [g for g in got if g[0] != 11] == sorted(plain, key=repr) and len(got) == len(texts)
    assert all(r["terminated"] for r in rows)
    assert token_files.count_tokens(empty_docs(spark)).count() == 0
