"""Near-duplicate texts: pairs and groups whose sets of word runs are similar enough.

1. One Arrow pass gives each text its number of shingles, a fingerprint of the whole set, band keys of a MinHash signature, and its odd sketch:
   the MinHash samples folded into a parity bitmap.
2. Texts with equal fingerprints are one class from here on, represented by their smallest id, so exact copies make no pairs among
   themselves while candidates are looked for.
3. Representatives that share a band key are candidates; the population count of the XOR of their odd sketches estimates their similarity,
   and only those near the threshold or above go on. The margin is ``SIGMAS`` standard deviations of the estimate.
4. The texts of what is left are compared exactly. Only texts that a Bloom filter of the candidates' ids lets through are shuffled.

Only band keys that two representatives or more share are joined. Groups need no pairs inside what is connected already: first each
representative is compared with the least of each of its band keys (a star, so a key of n texts gives n - 1 candidates), and only
representatives of one key that are still in different components are then compared with each other.

Nothing is capped: a band key that very many texts share is joined like any other (adaptive execution splits it), and no pair is dropped
unless its sketches differ. Of pairs at a similarity of exactly 0.6 the bands find 99.995 %, and more above.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.bloom import bloom_filter, might_contain
from tracewright.session import cut, spread

WORDS = 3
THRESHOLD = 0.6
BANDS, ROWS = 72, 4
SKETCH_BITS = 1024
SIGMAS = 4.0

_WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over the whole range (the finaliser of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """The longest runs of letters and numbers, in lower case."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def shingles_of(text: str | None, known: dict[str, int], width: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of ``width`` words, sorted; empty for null and for fewer words."""
    words = words_of(text) if text else []
    if len(words) < width:
        return np.empty(0, np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        mixed = _mix(mixed + h[i : len(words) - width + 1 + i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & _MASK))
    return np.unique(mixed)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 0.0


def popcount_limit(threshold: float, samples: int, bits: int, sigmas: float = SIGMAS) -> int:
    """The most differing bits that sketches of texts at ``threshold`` have, up to ``sigmas`` deviations.

    Of n samples n(1 - s) differ, each toggling two bits; m bits then differ in m/2 (1 - exp(-4 n (1 - s) / m)) places.
    """
    differing = samples * (1 - threshold)
    kept = math.exp(-4 * differing / bits)
    of_samples = 2 * math.sqrt(samples * threshold * (1 - threshold)) * kept
    of_bits = math.sqrt(bits / 4 * (1 - kept * kept))
    return math.ceil(bits / 2 * (1 - kept) + sigmas * math.hypot(of_samples, of_bits))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches as 64-bit words) of non-empty sets."""
    samples = bands * rows
    rng = np.random.default_rng(20_240_601)
    factor, add = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, samples, np.uint64)
    least = np.full((len(sets), samples), np.uint64(_MASK))
    at = 0
    while at < len(sets):  # a cache-sized part of the batch at a time
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 60_000):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])[:-1]]).astype(np.int64)
        for k in range(samples):
            least[at:end, k] = np.minimum.reduceat(flat * factor[k] + add[k], starts)
        at = end
    folded = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        folded = _mix(folded + least[:, r::rows])
    keys = _mix(folded + np.arange(1, bands + 1, dtype=np.uint64))
    place = (_mix(least + np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((place + np.arange(len(sets))[:, None] * bits).ravel(), minlength=len(sets) * bits) & 1
    sketch = np.packbits(flips.astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.uint64)
    return keys, sketch


def _features(frame: DataFrame, row: str, text: str, width: int) -> DataFrame:
    """(id, f1, f2, bands, sketch) of each text of at least ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, sets = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles_of(t, known, width)
                if len(s):
                    ids.append(i)
                    sets.append(s)
            if len(known) > 1_000_000:
                known.clear()
            if not ids:
                continue
            keys, sketch = signatures(sets)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
            first = np.array([np.add.reduce(s) for s in sets], np.uint64).view(np.int64)
            second = np.array([np.bitwise_xor.reduce(_mix(s)) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(first), pa.array(second), lists(keys), lists(sketch)], names=["id", "f1", "f2", "bands", "sketch"])

    kind = frame.schema[row].dataType.simpleString()
    read = frame.select(F.col(row).alias("r"), F.col(text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    return spread(read).mapInArrow(run, f"id {kind}, f1 bigint, f2 bigint, bands array<bigint>, sketch array<bigint>")


def _differing(a: Column, b: Column, words: int = SKETCH_BITS // 64) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def _compare(pairs: DataFrame, frame: DataFrame, row: str, text: str, threshold: float, width: int) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose texts reach ``threshold``."""
    asked = bloom_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", items=2 * pairs.count())
    texts = frame.select(F.col(row).alias("id"), F.col(text).alias("t")).filter(might_contain(asked, F.col("id")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            s = [similarity(shingles_of(x, known, width), shingles_of(y, known, width)) for x, y in zip(batch["ta"], batch["tb"], strict=True)]
            if len(known) > 1_000_000:
                known.clear()
            out = batch[["a", "b"]].assign(similarity=s)
            yield out[out["similarity"] >= threshold]

    kind = frame.schema[row].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def _classes(frame: DataFrame, row: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """((id, rep) of each text with enough words, (id, bands, sketch) of the representatives)."""
    base = cut(_features(frame, row, text, width))
    classes = base.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    members = cut(base.select("id", "f1", "f2").join(classes, ["f1", "f2"]).select("id", "rep"))
    # what the filter of copies rejects is a representative for sure; only the rest is looked up
    copies = members.filter("id <> rep").select("id")
    known = bloom_filter(copies, "id", items=copies.count())
    sure, unsure = base.filter(~might_contain(known, F.col("id"))), base.filter(might_contain(known, F.col("id")))
    return members, sure.select("id", "bands", "sketch").unionByName(unsure.join(copies, "id", "left_anti").select("id", "bands", "sketch"))


def shared_bands(reps: DataFrame) -> DataFrame:
    """(band, id, least): the representatives of each band key that at least two have, and the least of them."""
    banded = reps.select("id", F.explode("bands").alias("band"))
    several = cut(banded.groupBy("band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "least"))
    asked = bloom_filter(several, "band", items=several.count())
    return banded.filter(might_contain(asked, F.col("band"))).join(several, "band")


def _verified(pairs: DataFrame, reps: DataFrame, frame: DataFrame, row: str, text: str, threshold: float, width: int) -> DataFrame:
    """(a, b, similarity) of the candidates whose odd sketches and then texts are similar enough."""
    sketches = reps.select("id", "sketch")
    near = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    near = cut(near.filter(_differing(F.col("sa"), F.col("sb")) <= popcount_limit(threshold, BANDS * ROWS, SKETCH_BITS)).select("a", "b"))
    return cut(_compare(near, frame, row, text, threshold, width))


def classes_and_links(frame: DataFrame, row: str, text: str, threshold: float = THRESHOLD, width: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """((id, rep) of each text with enough words, (a, b, similarity) between representatives, a < b)."""
    members, reps = _classes(frame, row, text, width)
    shared = shared_bands(reps)
    pairs = shared.select(F.col("id").alias("a"), "band").join(shared.select(F.col("id").alias("b"), "band"), "band").filter("a < b").select("a", "b").distinct()
    return members, _verified(pairs, reps, frame, row, text, threshold, width)


def stars(shared: DataFrame) -> DataFrame:
    """(a, b): each representative with the least of each of its band keys; as many rows as there are shared keys at most."""
    return shared.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()


def across(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives of one band key that are in different components by ``roots`` (id, root); others are components of their own."""
    marked = shared.select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    marked = cut(marked)
    open_ = marked.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    left = cut(marked.join(open_, "band"))
    a, b = left.select("band", F.col("id").alias("a"), F.col("root").alias("ra")), left.select("band", F.col("id").alias("b"), F.col("root").alias("rb"))
    return a.join(b, "band").filter("a < b and ra <> rb").select("a", "b").distinct()


def similar_pairs(frame: DataFrame, row: str, text: str, threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: each pair of rows whose texts have a similarity of at least ``threshold``, copies spelt out.

    Null, empty and short texts are in no pair; a row id is expected to be unique. An empty table has no pair.
    """
    members, links = classes_and_links(frame, row, text, threshold, width)
    left, right = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    between = links.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    shared = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    within = members.join(shared, "rep")
    within = within.select("rep", F.col("id").alias("doc_a")).join(within.select("rep", F.col("id").alias("doc_b")), "rep").filter("doc_a < doc_b").select("doc_a", "doc_b")
    return between.unionByName(within)


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's connected component, over (a, b).

    Alternating large and small stars: every round hangs nodes onto the smallest neighbour, first the larger ones, then the smaller ones; the
    number of rounds grows with the logarithm of the component size. Each round is cut, so lost executors cost one round.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.filter("u <> v").distinct())
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) after further ``links`` (a, b): the components that ``roots`` knows are single nodes here, so little is left to connect."""
    own = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"r{side}"))
    edges = cut(links.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct())
    if edges.isEmpty():
        return roots
    new = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.col("id").alias("root"))
    top = components(edges).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return roots.unionByName(new).join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def similar_groups(frame: DataFrame, row: str, text: str, threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """(row, group_id, copies): one row for each text that has a near duplicate or copy.

    group_id is the smallest id of the connected component; copies counts the rows of equal shingles (itself too). Null, empty and short texts are
    in no group; an empty table has none.
    """
    members, reps = _classes(frame, row, text, width)
    shared = cut(shared_bands(reps))
    first = _verified(stars(shared), reps, frame, row, text, threshold, width)
    roots = components(first)
    rest = _verified(across(shared, roots), reps, frame, row, text, threshold, width)
    root = merged_roots(roots, rest)
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    per = copies.join(root.withColumnRenamed("id", "rep"), "rep", "left").filter("copies > 1 or root is not null")
    per = per.select("rep", F.coalesce("root", "rep").alias("group_id"), "copies")
    return members.join(per, "rep").select(F.col("id").alias(row), "group_id", "copies")
