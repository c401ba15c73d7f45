"""Near-duplicates: banded MinHash, sequential Bayesian verification, exact confirmation.

A document's set holds the 64-bit hashes of its distinct word shingles (A-Z lower-cased); with
fewer words than a shingle has, the whole sequence is one. Documents of equal sets become one node.
Nodes meet in buckets, one for each band of their signature. Links are found in two rounds:

1. In each bucket every node is compared with the bucket's first one. Batches of the two signatures
   are compared in turn; a pair is pruned once the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below ``miss``. Survivors are verified on their full sets.
2. Buckets whose nodes are not yet of one component are compared completely, but only across
   components: the nodes outside a bucket's largest component against all of its nodes, in blocks
   of bounded size, each pair in the first bucket that it shares. Signatures come first and are
   pruned as before; only nodes that keep a partner in a block have their sets sent to it. There
   exact intersections are counted, and only links that join two components leave the block. So no
   bucket is capped, none emits all its pairs, and no link is lost that the bands could find.

Each pair at the threshold shares a band but for a probability of (1 - t ** rows) ** bands, 5e-6 by
default, and is pruned wrongly with one of about ``miss``.

Defined results: a null text and one without words has an empty set and is linked with nothing; its
component is itself. Rows that share a doc_id are separate rows with the same id; if their texts
aren't linked their components may differ. Repeated rows have equal results. Null ids don't count
for the smallest id of a component; one of null ids only has a null component, and is kept. An
empty table gives an empty table. Texts are compared byte by byte, also where they aren't UTF-8.
Other input columns aren't needed and are dropped by ``cluster``; ``keep_first`` returns them, for
one row of each component: the first by id, nulls last, then by the hash of the text. Of rows with
an empty set it keeps one for each id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import byte_texts, col, cut, free, text_hash, type_of
from rulestream.llm.components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-6
BROADCAST_NODES = 500_000
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Keys of at least so many rows, and of at least this share of all rows, are joined by broadcast: their number is bounded by the share.
HOT_ROWS, HOT_SHARE = 1_000, 20_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * _M2
    v = (v ^ (v >> np.uint64(27))) * _M3
    return v ^ (v >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; bytes.split cuts at exactly the ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    code = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        code = code * _M1 + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(code))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _M1)
    return seeds[:n] | np.uint64(1), seeds[n:]


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    a, b = _coefficients(size)
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, (found[at : at + 1024, None] * a + b).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(percent: int = PERCENT, miss: float = MISS, size: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, m): a pair with fewer than m of its first n hashes equal is pruned.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches of n, and it
    reaches t with the probability that at most m of n + 1 trials of chance t succeed.
    """
    t = percent / 100
    out = []
    for n in range(batch, size + 1, batch):
        mass, m = 0.0, 0
        while (mass := mass + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices aren't pruned."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, m in least:
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= m], n
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, sig): the size, identity and signature of each document's set; ``_th`` too if it is there."""
    kept = [c for c in ("doc_id", "_th") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, n, digest, sig = batch.slice(at, 512), [], [], []
                for text in byte_texts(part.column("text")):
                    found = shingles(text)
                    n.append(len(found))
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sig.append(signature(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in kept}, "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "sig": pa.array(sig, pa.binary())})

    return docs.select(*kept, "text").mapInArrow(run, ", ".join(f"{c} {type_of(docs, c)}" for c in kept) + ", n bigint, digest binary, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node): a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                key = band_keys(np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4"))
                node = np.repeat(np.array(part.column("node")), BANDS)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(key.reshape(-1)), "node": pa.array(node, pa.int64())})

    return nodes.select("node", "sig").mapInArrow(run, "bucket bigint, node bigint")


def _sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, found): the full sets of the wanted nodes, from the text of each one's first document.

    If rows are ``repeated``, a document may be there more than once, and one of its sets is kept.
    """
    n = wanted.count()
    wanted = wanted.select(F.col("doc").alias("_doc"), "node", "digest")
    if n <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, node, sets = batch.slice(at, 256), [], []
                for text, k, digest in zip(byte_texts(part.column("text")), part.column("node").to_pylist(), part.column("digest").to_pylist()):
                    found = shingles(text)
                    if len(found) and hashlib.blake2b(found.tobytes(), digest_size=16).digest() == digest:
                        node.append(k)
                        sets.append(found.tobytes())
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "found": pa.array(sets, pa.binary())})

    joined = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "inner")
    found = joined.select("node", "digest", "text").mapInArrow(run, "node bigint, found binary")
    return found.dropDuplicates(["node"]) if repeated else found


def _both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the values of both ends; a node of very many pairs is split by the adaptive join."""
    for end in ("b", "a"):
        pairs = pairs.join(values.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _first_round(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    least = least_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sig = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4").reshape(part.num_rows, -1) for c in ("sig_a", "sig_b")]
                yield part.take(pa.array(survivors(*sig, least))).select(["a", "b"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [i for i in range(batch.num_rows) if linked(*(np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("found_a", "found_b")))]
            yield batch.take(pa.array(right, pa.int64())).select(["a", "b"])

    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    # cut here, so that a task never runs the workers of both steps
    left = cut(_both(pairs, nodes.select("node", "sig"), "sig").mapInArrow(prune, "a bigint, b bigint"))
    return _both(left, sets, "found").mapInArrow(confirm, "a bigint, b bigint")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The buckets of signatures, one for each band."""
    sig = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * _M1 + sig[:, :, r])
    return key.view(np.int64)


def partners(sig: np.ndarray, comp: np.ndarray, role: np.ndarray, bucket: int, least: list[tuple[int, int]]) -> np.ndarray:
    """Of a block: which rows of role 1 (down) and of role 0 (across) must be compared exactly.

    They are of different components, aren't pruned, and this bucket is the first that they share.
    """
    outer, members = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    near = np.zeros((len(outer), len(members)), bool)
    if not near.size:
        return near
    band = int(np.argmax(band_keys(sig[:1])[0] == bucket))
    theirs = sig[members]
    for row, i in enumerate(outer):
        alive = np.flatnonzero(comp[members] != comp[i])
        matches, done = np.zeros(len(alive), int), 0
        for n, m in least:
            matches += (theirs[alive, done:n] == sig[i, done:n]).sum(1)
            go = matches >= m
            alive, matches, done = alive[go], matches[go], n
        if band:
            before = (theirs[alive, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(alive), band, ROWS)
            alive = alive[~before.all(2).any(1)]
        near[row, alive] = True
    return near


def compare_block(node: np.ndarray, comp: np.ndarray, role: np.ndarray, found: list[np.ndarray], near: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the components of a block: of the pairs in ``near``, as ``partners`` gives it.

    A link is left out if those before it in the block connect its components already.
    """
    outer, members = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    if not near.any():
        return []
    sizes = np.array([len(found[i]) for i in members])
    every, place = np.unique(np.concatenate([found[i] for i in members]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    out = []
    for i, wanted in zip(outer, near):
        if not wanted.any():
            continue
        mine = found[i]
        at = np.minimum(np.searchsorted(every, mine), len(every) - 1)
        mark = np.zeros(len(every), np.int32)
        mark[at[every[at] == mine]] = 1
        both = np.add.reduceat(mark[place], starts)
        for k in np.flatnonzero(wanted & (100 * both >= percent * (sizes + len(mine) - both)) & (both > 0)):
            j = members[k]
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b:
                up[a] = b
                out.append((int(node[i]), int(node[j])))
    return out


def _second_round(members: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    named = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    sized = named.join(nodes.select("node", "n"), "node")
    parts = sized.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "comp", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("k > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("bucket", F.col("main.comp").alias("main"), blocks(F.col("c"), F.col("s")).alias("nm"), blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("no"))
    rows = named.join(mixed, "bucket")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    inner = rows.select("bucket", "node", "comp", F.lit(0).alias("role"), part(F.col("nm")).alias("mb"), upto(F.col("no")).alias("ob"))
    outer = rows.where("comp <> main").select("bucket", "node", "comp", F.lit(1).alias("role"), upto(F.col("nm")).alias("mb"), part(F.col("no")).alias("ob"))
    laid = inner.unionByName(outer).join(nodes.select("node", "sig"), "node")
    least = least_matches()

    def read(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(x.as_py() for x in block.column("sig")), "<u4").reshape(block.num_rows, -1)
        comp, role = block.column("comp").to_numpy(), block.column("role").to_numpy()
        return comp, role, partners(sig, comp, role, block.column("bucket")[0].as_py(), least)

    def prune(block: pa.Table) -> pa.Table:
        _, role, near = read(block)
        kept = np.zeros(block.num_rows, bool)
        kept[np.flatnonzero(role == 1)] = near.any(1)
        kept[np.flatnonzero(role == 0)] = near.any(0)
        return block.filter(pa.array(kept)).select(["bucket", "mb", "ob", "node", "comp", "role", "sig"])

    def compare(block: pa.Table) -> pa.Table:
        comp, role, near = read(block)
        links = compare_block(block.column("node").to_numpy(), comp, role, [np.frombuffer(x.as_py(), np.uint64) for x in block.column("found")], near)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    left = cut(laid.groupBy("bucket", "mb", "ob").applyInArrow(prune, "bucket bigint, mb int, ob int, node bigint, comp bigint, role int, sig binary"))
    return left.join(sets, "node").groupBy("bucket", "mb", "ob").applyInArrow(compare, "a bigint, b bigint")


def _join_each(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` with the row of ``right`` that has its key, whose ``rows`` tells how many rows of ``left`` have it.

    What hot keys have is broadcast, so that the rows of none of them meet in a task.
    """
    hot = F.col("rows") >= max(HOT_ROWS, total // HOT_SHARE)
    few, many = right.where(hot).drop("rows"), right.where(~hot).drop("rows")
    if few.isEmpty():
        return left.join(many, key)
    few = F.broadcast(few)
    return left.join(few, key).unionByName(left.join(few, key, "left_anti").join(many, key))


def _clustered(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` as described; the nodes with the root of each; and for each root its component, with the component's smallest id and, with ``_th``, its first row."""
    told = cut(_describe(docs))
    lead = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("lead")] if "_th" in docs.columns else []
    nodes = told.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"), *lead)
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    bands = _bands(nodes)
    shared = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "first")
    members = cut(bands.join(shared, "bucket"))
    wanted = nodes.select("node", "doc", "digest").join(members.select("node").distinct(), "node", "left_semi")
    repeated = not told.where("n > 0").groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    sets = cut(_sets(docs, wanted, repeated))
    sure = cut(_first_round(members, nodes, sets))
    roots = components(sure)
    more = _second_round(members, roots, nodes, sets)
    # the second round's links join components, so they are few; the first round's are contracted to roots
    over = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    top = components(over.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    named = nodes.drop("n", "sig").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # from here on a component is a row for each of its roots, so a large one is gathered where its rows lie
    each = named.groupBy("root").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("rows"), *([F.min("lead").alias("lead")] if lead else []))
    each = each.join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").withColumn("top", F.coalesce("_top", "root")).drop("_top")
    return told, named, each


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    told, named, each = _clustered(docs.select("doc_id", "text"))
    total = told.count()
    smallest = each.groupBy("top").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    answer = _join_each(each.select("root", "top", F.col("rows").alias("held")), cut(smallest), "top", total).select("root", "component_id", F.col("held").alias("rows"))
    answer = _join_each(named.select("root", "digest", "copies"), cut(answer), "root", total).select("digest", "component_id", F.col("copies").alias("rows"))
    joined = told.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    joined = _join_each(joined, cut(answer), "digest", total).select("doc_id", "n_shingles", "component_id")
    joined = joined.unionByName(told.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of each component of ``docs``; of repeated rows, one."""
    told, _, each = _clustered(docs.select("doc_id", "text", text_hash().alias("_th")))
    first = each.groupBy("top").agg(F.min("lead").alias("lead")).select("lead.doc_id", "lead._th")
    th, d, t = free(docs, "_th", "_d", "_t")
    kept = first.unionByName(told.where("n = 0").select("doc_id", "_th")).distinct().select(F.col("doc_id").alias(d), F.col("_th").alias(t))
    keyed = docs.withColumn(th, text_hash())
    same = keyed["doc_id"].eqNullSafe(kept[d]) & keyed[th].eqNullSafe(kept[t])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", th]).select(*map(col, docs.columns))
