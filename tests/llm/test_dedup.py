import random

from vellum.llm import dedup

from .helpers import edge_docs, empty_docs


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(docs, n, percent):
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=repr)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[: max(1, len(words) - rng.randint(0, 9))]
        else:
            words = rng.choices(vocab, k=rng.choice([1, 2, 5, 6, 9, 40, 150]))
        docs.append((i * 7 % n, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return docs


def test_against_all_pairs(spark):
    for seed, n in ((1, 2), (2, 5)):
        docs = corpus(seed)
        got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=n).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(docs, n, 80)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_group_of_near_copies_around_one_text(spark):
    rng = random.Random(9)
    base = [f"x{i}" for i in range(60)]
    docs = [(500, " ".join(base))]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(60)] = f"y{rng.randrange(1000)}"
        docs.append((i, " ".join(words)))
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, rounds=1, block_shingles=480).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(docs, 2, 80)


def test_edge_table(spark):
    df = edge_docs(spark)
    for n in (2, 5):
        got = dedup.near_duplicates(df, shingle=n).collect()
        want = brute([(r["doc_id"], r["text"]) for r in df.collect()], n, 80)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_a_large_group_whose_members_are_no_links_of_each_other(spark):
    """2,000 texts share three quarters of their words with each other but no two are links, so every pair that shares a key has to be held."""
    rng = random.Random(4)
    base = [f"x{i}" for i in range(40)]
    docs = [(i, " ".join(base + [f"y{rng.randrange(10**9)}" for _ in range(9)])) for i in range(2000)]
    docs += [(5000 + i, docs[i][1] + " z") for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(df, shingle=2, block_shingles=20_000).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in docs}


def test_rows_without_an_id_and_rows_of_one_id(spark):
    """A third of the rows have no id and another third one id; each keeps the component of its own text."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, t + " more") for t in texts] + [(7, t + " most") for t in texts]
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(docs, 2, 80)
