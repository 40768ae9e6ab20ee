"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A signature has ``chunks`` times ``width`` MinHash values cut to 16 bits. Two signatures of a Hamming distance (positions that
differ) under ``chunks * (errors + 1)`` must, by pigeonhole, have a chunk with at most ``errors`` (here 1) positions that
differ. Each chunk is indexed once for each place the error may have, by the values at the other places, so all pairs under that
distance meet under a key. With 12 chunks of 6, all pairs up to distance 23 of 72 meet; of pairs with a similarity of just
0.8, whose mean distance is 14.4, one in 350,000 meets under no key (those over distance 23 mostly do meet).

Copies (equal sets) are one node. Pairs are never rows: in each of two rounds a node is held against the one node,
of another component, that is the hub of most of its keys, and what is confirmed joins components. Keys that then still part components
are put into bundles, each key into one (that of the least hub near it), and a node belongs to the bundles of all of its keys, so any two nodes
that share such a key meet in a bundle. There the rows outside the bundle's largest component are held against all of its rows,
block by block, on full sets and without any estimate; a task gives back no more links than join the components it has seen.
So no link between components is lost, and links inside one, which change nothing, are not looked for. The blocks' comparisons grow with
a group of near copies that are no links of each other times the group, as the question asks; the rows that leave a task don't.
A row is sent to a block once for each ``block_shingles`` shingles that it has to be held against.

Defined results: null text and text without words have an empty set, n_shingles 0, and are linked with nothing; a text
with fewer words than the shingle's has its whole sequence as one shingle; repeated rows are each a row of the result; rows
without a doc_id take part, and the smallest id that is not null names the component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .arrow import cut, cut_dense, hash_words, map_batches, word_hashes

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, n: int, table) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of the whole text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words, table)
    width = min(n, len(h))
    out = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : len(h) - width + 1 + j]
    out ^= out >> np.uint64(32)
    return np.unique(out * _MIX)


def text_key():
    return F.xxhash64("text")


def first():
    """The order of rows for the first one's doc_id and text_key: the smallest id that is not null, then the least digest."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")


def _coefficients(k: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, odd: np.ndarray) -> bytes:
    """Low 16 bits of the least value of each of the multiplicative hash functions' upper halves."""
    least = np.full(len(odd), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, ((odd[:, None] * part[None, :]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return (least & np.uint32(0xFFFF)).astype("<u2").tobytes()


def signatures(docs: DataFrame, shingle: int, k: int, seed: int = 1) -> DataFrame:
    """doc_id, text_key (digest of the text), n_shingles, set_key (128-bit digest of the set) and sig of each row."""

    def make():
        table, odd = word_hashes(), _coefficients(k, seed)

        def step(cols):
            out = {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "n_shingles": [], "set_key": [], "sig": []}
            for text in cols["text"]:
                s = shingle_set(text, shingle, table)
                out["n_shingles"].append(len(s))
                out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["sig"].append(signature(s, odd) if len(s) else None)
            return out

        return step

    return map_batches(docs.select("doc_id", "text", text_key().alias("text_key")), make, "doc_id long, text_key long, n_shingles long, set_key binary, sig binary")


def chunk_keys(nodes: DataFrame, chunks: int, width: int) -> DataFrame:
    """(key, node): for each chunk and each place of one allowed error, a hash of the values at the other places."""
    keys = []
    for c in range(chunks):
        for j in range(width):
            at = 2 * (c * width)
            rest = F.concat(F.substring("sig", at + 1, 2 * j), F.substring("sig", at + 2 * j + 3, 2 * (width - 1 - j)))
            keys.append(F.xxhash64(rest, F.lit(c * width + j)))
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("items").alias("left")), "a")
        .select("a", "b", "left", "right")
    )

    def make():
        def step(cols):
            out = {"a": [], "b": []}
            for a, b, x, y in zip(cols["a"], cols["b"], cols["left"], cols["right"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    return map_batches(both, make, "a long, b long")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """Leaves out pairs with a hub that are hardly links: by their sets' sizes, and by a signature distance more than six deviations over the mean of
    the least similarity. This only spares the rounds work: what it leaves out keeps its keys open and is held in the blocks."""
    miss = 1 - percent / 100
    most = k * miss + 6 * (k * miss * (1 - miss)) ** 0.5
    side = nodes.select("node", "n_shingles", "sig")
    joined = (
        pairs.join(side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
        .join(side.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )

    def make():
        def step(cols):
            keep = [np.count_nonzero(np.frombuffer(x, "<u2") != np.frombuffer(y, "<u2")) <= most for x, y in zip(cols["sa"], cols["sb"])]
            return {c: [v for v, yes in zip(cols[c], keep) if yes] for c in ("a", "b")}

        return step

    return map_batches(joined.select("a", "b", "sa", "sb"), make, "a long, b long")


def _id_key(doc_id: str):
    return F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), F.lit("id"))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and items (the sorted set's bytes) of the wanted nodes (node, first_id, text_key, set_key), from the whole texts of their first rows.
    Of rows that share id and text one is read; the join has put them side by side already."""

    def make():
        table = word_hashes()

        def step(cols):
            out = {"node": [], "items": []}
            for node, key, text in zip(cols["node"], cols["set_key"], cols["text"]):
                s = shingle_set(text, shingle, table).tobytes()
                if xxhash.xxh3_128_digest(s) == key:
                    out["node"].append(node)
                    out["items"].append(s)
            return out

        return step

    texts = docs.select(text_key().alias("text_key"), _id_key("doc_id").alias("id_key"), "text")
    firsts = wanted.select("text_key", _id_key("first_id").alias("id_key"), "node", "set_key")
    return map_batches(texts.join(firsts, ["text_key", "id_key"]).dropDuplicates(["text_key", "id_key"]).select("node", "set_key", "text"), make, "node long, items binary")


def _bundles(still: DataFrame) -> DataFrame:
    """(bundle, node, comp) from open keys (key, node, comp, hub): a key's bundle is the least hub of the keys of its nodes."""
    least = still.groupBy("node").agg(F.min("hub").alias("least"))
    owner = still.select("key", "node").join(least, "node").groupBy("key").agg(F.min("least").alias("bundle"))
    return cut_dense(still.select("key", "node", "comp").join(owner, "key").select("bundle", "node", "comp").distinct())


def _block_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between different components of each bundle. A bundle's rows outside its largest component are held against all of its rows, in
    blocks of about ``block_shingles`` shingles on each side; a task counts the common shingles of a block pair from a sorted index, joins components
    as it finds links, and gives only those that joined two."""
    sized = members.join(nodes.select("node", "n_shingles"), "node")
    by_comp = sized.groupBy("bundle", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = by_comp.groupBy("bundle").agg(F.sum("w").alias("w"), F.count("*").alias("comps"), F.max_by(F.struct("comp", F.col("w").alias("w")), F.struct("w", "comp")).alias("main"))
    blocks = lambda w: F.ceil(w / block_shingles)
    sizes = sizes.filter("comps > 1").select("bundle", F.col("main.comp").alias("main"), blocks(F.col("w")).alias("blocks"), blocks(F.col("w") - F.col("main.w")).alias("outer"))
    rows = members.join(sizes, "bundle").join(sets, "node")
    here = lambda name, n: F.pmod(F.xxhash64("node", F.lit(name)), F.col(n))
    every = rows.select("bundle", here("i", "blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("j"), F.lit(False).alias("asks"), "node", "comp", "items")
    asked = rows.filter("comp <> main").select("bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), here("j", "outer").alias("j"), F.lit(True).alias("asks"), "node", "comp", "items")

    def match(pdf):
        import pandas as pd

        out = {"a": [], "b": []}
        asks = pdf["asks"].to_numpy()
        _, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        node, held = pdf["node"].to_numpy(), np.flatnonzero(~asks)
        if asks.any() and len(held):
            items = [np.frombuffer(x, "<u8") for x in pdf["items"].to_numpy()[held]]
            n = np.array([len(x) for x in items])
            tokens, owner = np.concatenate(items), np.repeat(np.arange(len(n)), n)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for row, x in zip(np.flatnonzero(asks), pdf["items"].to_numpy()[asks]):
                if (comp[held] == comp[row]).all():
                    continue
                x = np.frombuffer(x, "<u8")
                lo, hi = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                many = hi - lo
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.bincount(owner[at], minlength=len(n))
                hits = held[100 * both >= percent * (len(x) + n - both)]
                for hit in hits[np.unique(comp[hits], return_index=True)[1]]:
                    if comp[hit] != comp[row]:
                        out["a"].append(min(node[row], node[hit]))
                        out["b"].append(max(node[row], node[hit]))
                        comp[comp == comp[hit]] = comp[row]
        return pd.DataFrame(out, dtype="int64")

    return every.unionByName(asked).groupBy("bundle", "i", "j").applyInPandas(match, "a long, b long")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id) of each row."""
    out = components(docs, **options)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, chunks: int = 12, width: int = 6, rounds: int = 2, block_shingles: int = 1 << 17) -> DataFrame:
    """doc_id, text_key, n_shingles, comp (the component itself, as ids may be null or shared; null without words) and component_id of each row."""
    k = chunks * width
    rows = cut(signatures(docs, shingle, k))
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min(first()).alias("first"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"))
    classes = classes.select("set_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "sig", "n_shingles")
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = chunk_keys(nodes, chunks, width)
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("hi")).filter("hub < hi").select("key", "hub")
    meets = cut(keys.join(shared, "key"))
    # the sets of those that meet any, by their whole texts
    wanted = cut_dense(meets.select("node").distinct().join(nodes.select("node", "first_id", "text_key", "set_key"), "node"))
    sets = cut(_sets(docs, wanted, shingle))
    labels, held = wanted.select("node", F.col("node").alias("comp")), None
    for done in range(rounds):
        if done:
            meets = _open_keys(meets, labels)
            pairs = meets.filter("comp <> hub_comp")
        else:  # each node is its own component
            pairs = meets.filter("node <> hub")
        pairs = pairs.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
        if held is not None:
            pairs = pairs.join(held, ["a", "b"], "left_anti")
        pairs = cut_dense(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"))
        held = pairs if held is None else held.union(pairs)
        labels = _merged(labels, cut_dense(_confirmed(_near(pairs, nodes, percent, k), sets, percent)))
    members = _bundles(_open_keys(meets, labels))
    labels = _merged(labels, cut_dense(_block_links(members, nodes, sets, percent, block_shingles)))
    names = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = names.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = names.join(least, "comp").select("set_key", "comp", "component_id")
    out = rows.join(named, "set_key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_key", "n_shingles", "comp", "component_id")


def _open_keys(meets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp, hub, hub_comp): the rows of the keys that more than one component has, with their hub (least node). What one
    component has it will keep, so later rounds need no other keys."""
    member = meets.select("key", "node").join(labels, "node")
    spread = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "comp"), "node").alias("hub")).filter("lo < hi")
    return cut_dense(member.join(spread.select("key", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), "key"))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after the links found; links between components are edges of the graph of components."""
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    edges = found.join(a, "a").join(b, "b").select("comp_a", "comp_b").distinct()
    linked = connected_components(edges, "comp_a", "comp_b").withColumnRenamed("node", "comp")
    return cut_dense(labels.join(linked, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")))
