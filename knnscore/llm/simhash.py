"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's fingerprint has the majority bits of its shingles' hashes. Fingerprints that differ in few
bits are found by keys: segments of the fingerprint are decoded to nearby Golay codewords, whose indices
are the keys (see golay.py), and by the pigeonhole principle two close fingerprints have segments with so
few differing bits that they share one. Documents of equal fingerprints count as one; those that share a
key are candidates, and each candidate pair is verified on the whole fingerprints.

A key's bucket is never expanded into all its pairs. First every member is compared with three of the
bucket: the first, the last and the one that meets most others over all buckets. That settles buckets
of up to three. Larger ones that still hold several components are compared with a few random members,
in rounds that go on while they settle much; at last, only members of different components are compared, and only links are emitted. A
bucket of copies is one component by then and drops out. No link that joins two components is lost, so
components are those of all links.

Null text counts as empty. A text with no words has fingerprint zero; one with fewer words than a
shingle is a single shingle. Rows that repeat an identifier are documents of their own. A null identifier
is never a component's identifier unless all are null. Empty input gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import components, documents, fresh, in_place, table

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For byte value v, its 8 bits; bits of a hash are counted from the lowest.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of `size` words joined by single spaces, repeats included."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    at = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    counts = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([majority(shingle_hashes(split_words(t.as_py()), words)) for t in b.column(1)], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


#: (first bit, bits) of the segments of 64 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bits of a segment's lower half; the upper one has the rest.
HALF = 11


def four_bit_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): fingerprints within 4 bits share a key. A key stands for about 29 bits, a fingerprint has 96 on average.

    Let the segments differ in a, b, c bits, at most 4 in all. If one of them is 0, another is 2 or less: keys
    of the first segment's value and a codeword for up to 2 bits of the other. If none is 0, two of them are
    1 and the third is 2 or less: a segment with one differing bit has an equal half, so keys of a half of
    each of two segments and a codeword of the third.
    """
    fp = np.asarray(fp).astype(np.uint64)
    value = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    halves = [(v & ((1 << HALF) - 1), v >> HALF) for v in value]
    near = [golay.keys(v) for v in value]
    found = [np.nonzero(codes >= 0) for codes in near]
    rows, keys, tag = [], [], 0

    def put(exact: np.ndarray, j: int) -> None:
        nonlocal tag
        r, k = found[j]
        rows.append(r)
        keys.append((tag << 40) | (exact[r] << 12) | near[j][r, k])
        tag += 1

    for j in range(3):
        one, other = (i for i in range(3) if i != j)
        put(value[one], j)
        put(value[other], j)
        for x in halves[one]:
            for y in halves[other]:
                put(x << HALF | y, j)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame, source: str, keys_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """(key, node) for every node; column `source` is a long (width 0) or binary of `width` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                node = part.column(0).to_numpy(zero_copy_only=False)
                if width:
                    made = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(-1, width)
                else:
                    made = part.column(1).to_numpy(zero_copy_only=False)
                r, k = keys_of(made)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(node[r])], names=["key", "node"])

    # a node becomes a hundred rows: deal the nodes out evenly first
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("node", F.col(source).alias("value")).repartition(parts, "node").mapInArrow(run, "key long, node long")


#: Random members of each bucket that still holds several components which are compared with all of it in a round, the most
#: rounds, and the share of the buckets' rows that a round must settle for another one to follow. They save comparisons of the
#: last step, which is complete by itself.
CENTRES, CENTRE_ROUNDS, CENTRE_GAIN = 2, 8, 0.1


def links(members: DataFrame, others: DataFrame, apart: Column, ends: Callable[[DataFrame], DataFrame], close: Column) -> DataFrame:
    """(a, b) components of members (key, node, comp) and others (the same as b_<name>) that a link joins within a bucket.

    A pair that meets in several buckets is compared once; `ends` adds the values that `close` reads.
    """
    a = members.select(*(F.col(c).alias(f"a_{c}") for c in members.columns))
    met = a.join(in_place(others), (F.col("a_key") == F.col("b_key")) & apart)
    pair = met.select(
        F.least("a_node", "b_node").alias("a_node"), F.greatest("a_node", "b_node").alias("b_node"),
        F.least("a_comp", "b_comp").alias("a"), F.greatest("a_comp", "b_comp").alias("b"),
    ).distinct()
    return ends(pair).where(close).select("a", "b").distinct()


def merged(pairs: DataFrame) -> DataFrame | None:
    """(old, new) component for every component in pairs (a, b); None without a pair."""
    pairs = table(pairs, "joined")
    if pairs.isEmpty():
        return None
    return table(components(pairs), "over").select(F.col("node").alias("old"), F.col("component").alias("new"))


def renamed(named: DataFrame, over: DataFrame) -> DataFrame:
    """named (node, component) after the change of over (old, new); a node without a link so far is a component of its own."""
    moved = named.join(in_place(over), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    single = over.join(in_place(named), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return moved.union(single)


def link(keys: DataFrame, distance: Callable[[str, str], Column], limit: int, payload_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of nodes with a link to another: `distance` of their values is at most `limit`.

    keys: (key, node), each pair once. payload_of(nodes) gives (node, value columns) of the nodes that share a
    key with another, which `distance(a, b)` reads as a_<name> and b_<name>; without it, a_node and b_node
    are the values.
    """

    def ends(pairs: DataFrame) -> DataFrame:
        for side in "ab" if payload is not None else "":
            own = payload.select(*(F.col(c).alias(f"{side}_{c}_" if c == "node" else f"{side}_{c}") for c in payload.columns))
            pairs = pairs.join(in_place(own), F.col(f"{side}_node") == F.col(f"{side}_node_")).drop(f"{side}_node_")
        return pairs

    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    groups = groups.withColumnRenamed("key", "k")
    members = table(keys.join(in_place(groups), F.col("key") == F.col("k")).select("key", "node", "n", "lo", "hi"), "members")
    payload = None if payload_of is None else table(payload_of(members.select("node").distinct()), "values")
    large = members.where("n > 3")
    score = large.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = large.select("key", "node").join(in_place(score), "node").groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("leader"))
    pairs = (
        members.select(F.col("node").alias("x"), F.col("lo").alias("y")).union(members.select("node", "hi"))
        .union(large.select("key", "node").join(in_place(hubs), "key").select("node", "leader")).where("x <> y")
        .select(F.least("x", "y").alias("a_node"), F.greatest("x", "y").alias("b_node")).distinct()
    )
    found = ends(pairs).where(distance("a", "b") <= limit).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    first = table(components(found), "components")
    named = first.withColumnRenamed("node", "nd")
    rest = large.select("key", "node").join(in_place(named), F.col("node") == F.col("nd"), "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    rest = table(rest, "rest")
    mixed = rest.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(F.col("key").alias("k"))
    rest = rest.join(in_place(mixed), F.col("key") == F.col("k"), "left_semi")
    rest = table(rest, "mixed")
    close = distance("a", "b") <= limit
    # nodes that are their own values are compared where they meet
    early = F.lit(True) if payload is not None else close
    size = rest.count()
    for turn in range(CENTRE_ROUNDS):
        # random members of a mixed bucket meet all of it: who is near many of a component joins it here, by a few links. They are
        # drawn by one order for all buckets, so a node's buckets, which share most members, mostly draw the same ones
        member = F.struct(*rest.columns)
        drawn = F.array_distinct(F.array(*(F.min_by(member, F.xxhash64(F.lit(turn * CENTRES + i), "node")) for i in range(CENTRES))))
        centres = rest.groupBy("key").agg(drawn.alias("drawn")).select(F.explode("drawn").alias("c")).select(*(F.col(f"c.{c}").alias(f"b_{c}") for c in rest.columns))
        over = merged(links(rest, centres, (F.col("a_comp") != F.col("b_comp")) & early, ends, close))
        if over is None:
            break
        first = table(renamed(first, over), "components")
        rest = rest.join(in_place(over), F.col("comp") == F.col("old"), "left").withColumn("comp", F.coalesce("new", "comp")).drop("old", "new")
        mixed = rest.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(F.col("key").alias("k"))
        rest = table(rest.join(in_place(mixed), F.col("key") == F.col("k"), "left_semi"), "mixed")
        before, size = size, rest.count()
        if size > (1 - CENTRE_GAIN) * before:
            break
    # what still holds several components: all of a bucket's members meet, with their values, and only links come out
    if payload is not None:
        rest = table(rest.join(in_place(payload.withColumnRenamed("node", "nd")), F.col("node") == F.col("nd")).drop("nd"), "valued")
    x, y = (rest.select(*(F.col(c).alias(f"{side}_{c}") for c in rest.columns)) for side in "ab")
    met = x.join(in_place(y), (F.col("a_key") == F.col("b_key")) & (F.col("a_comp") < F.col("b_comp")) & close)
    over = merged(met.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct())
    return first if over is None else renamed(first, over)


def near_components(prints: DataFrame) -> DataFrame:
    """(id, fp, component_id) for a table of (id, fp): the smallest identifier reachable over links of MAX_BITS bits or fewer."""
    reps = table(prints.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    keys = keyed(reps.select(F.col("fp").alias("node"), "fp"), "fp", four_bit_keys, 0)
    linked = link(keys, lambda a, b: F.bit_count(F.col(f"{a}_node").bitwiseXOR(F.col(f"{b}_node"))), MAX_BITS)
    of = reps.join(in_place(linked), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = table(of, "linked")
    least = of.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    named = of.join(in_place(least), F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(in_place(named), F.col("fp") == F.col("f")).select("id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = table(fingerprints(documents(spark, sf_dir)), "fingerprints")
    return near_components(prints).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near-duplicates by shingle similarity, for filtering: SimHash and Golay keys for candidates, whole sets of shingles to verify.

FILTER_WORDS = 5
#: Documents are linked from this Jaccard similarity of their sets of shingles on: a fraction in lowest terms.
LEAST_SIMILARITY = (4, 5)
#: Fingerprints of samples, and the sampled shingles of each. Whatever the edits are, two sets of Jaccard similarity j have no
#: sample in common with a chance of (1 - j ** BAND_ROWS) ** BANDS: 2.7e-5 at 0.8, 3.5e-7 at 0.85.
BANDS, BAND_ROWS = 20, 4


def _spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another independent 64-bit hash of each hash (the SplitMix64 finaliser)."""
    z = hashes + np.uint64((word + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` of the given word hashes."""
    if len(hashes) < size:
        size = len(hashes)
    out = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for k in range(size):
        out = _spread(out, k) ^ hashes[k : k + len(out)]
    return out


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of FILTER_WORDS words; a text without words has the single one 0."""
    from xxhash import xxh64_intdigest

    words = split_words(text)
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(_runs(h, FILTER_WORDS)) if len(words) else np.zeros(1, dtype=np.uint64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, s array of long): the sets of shingles, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingles(t.as_py()).astype(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).mapInArrow(run, "node long, s array<long>")


def dissimilar(a: str, b: str) -> Column:
    """0 where the sets <a>_s and <b>_s have LEAST_SIMILARITY or more, by whole numbers; 1 otherwise."""
    num, den = LEAST_SIMILARITY
    x, y = F.col(f"{a}_s"), F.col(f"{b}_s")
    n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    # both / (n + m - both) >= num / den; the sizes alone rule most others out
    return F.when(F.least(n, m) * den < F.greatest(n, m) * num, 1).when(both * (num + den) >= (n + m) * num, 0).otherwise(1)


def samples(hashes: np.ndarray) -> np.ndarray:
    """(BANDS, BAND_ROWS) of a set of shingles: hashes of the least shingles by as many random orders."""
    orders = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(orders), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, i : i + 1024] * orders).min(axis=1))
    return _spread(least, 0).reshape(BANDS, BAND_ROWS)


def majorities(hashes: np.ndarray) -> np.ndarray:
    """Of each row, the 64-bit number whose bits are set in over half of its hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    most = bits.sum(axis=1, dtype=np.int64) * 2 > hashes.shape[1]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def sample_keys(prints: np.ndarray) -> np.ndarray:
    """A key for each row of (n, BANDS) fingerprints of samples: the codewords of two segments of 23 bits, the other 18 bits, the sample's number."""
    mask = np.uint64((1 << golay.BITS) - 1)
    codes = [golay.keys(((prints >> np.uint64(at)) & mask).ravel())[:, 0].reshape(prints.shape) for at in (0, golay.BITS)]
    rest = (prints >> np.uint64(2 * golay.BITS)).astype(np.int64)
    return np.arange(prints.shape[1]) << 42 | codes[0] << 30 | codes[1] << 18 | rest


def shingle_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, fp long, keys array of long) of every text: its set's fingerprint, the keys of its samples' fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                fp = np.array([majority(x) for x in sets], dtype=np.uint64).astype(np.int64)
                sampled = np.array([samples(x) for x in sets], dtype=np.uint64).reshape(-1, BAND_ROWS)
                keys = sample_keys(majorities(sampled).reshape(-1, BANDS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "fp", "keys"])

    return docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).mapInArrow(run, "node long, fp long, keys array<long>")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group linked by similar shingles one document stays. All columns are kept.

    Candidates are found as in op10: fingerprints have the majority bits of shingles, and Golay codewords of their segments are
    the keys. The fingerprint of a whole set has four_bit_keys(): documents connected within MAX_BITS are candidates. Those that
    differ more meet by fingerprints of samples of their shingles, which agree where the samples do. Every link is verified.

    A document is known by a 64-bit hash of its identifier and text, so docs isn't copied; rows that agree in both stay or go
    together. What goes is found by that hash and the identifier: where the hashes of two documents collide, one of them isn't
    compared, and neither goes for the other. Null text counts as empty.
    """
    uid, gone, at = fresh(docs, "uid", "gone", "at")
    marked = docs.withColumn(uid, F.xxhash64(id_col, text_col))
    ids = marked.select(F.col(uid).alias("u"), F.col(id_col).alias("i"))
    prints = table(shingle_prints(marked, uid, text_col).dropDuplicates(["node"]), "shingle-prints")
    whole = table(near_components(prints.select(F.col("node").alias("id"), "fp")).select(F.col("component_id").alias("key"), F.col("id").alias("node")), "whole")

    def sets(nodes: DataFrame) -> DataFrame:
        met = marked.select(uid, text_col).join(in_place(nodes), F.col(uid) == F.col("node"), "left_semi")
        return shingle_sets(met, uid, text_col).dropDuplicates(["node"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = prints.repartition(parts, "node").select(F.explode("keys").alias("key"), "node").union(whole)
    linked = link(keys, dissimilar, 0, sets)
    drop = linked.where("node <> component").select("node")
    drop = table(ids.join(in_place(drop), F.col("u") == F.col("node")).groupBy("u").agg(F.min("i").alias("i")).select(F.col("u").alias(gone), F.col("i").alias(at)), "gone")
    return marked.join(in_place(drop), (F.col(uid) == F.col(gone)) & F.col(id_col).eqNullSafe(F.col(at)), "left_anti").select(*docs.columns)
