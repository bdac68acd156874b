"""N-gram Jaccard self-join by chosen paths, exact within what it finds, with recall set by the number of runs.

Every document is the set of its five-word shingles; equal sets form one class. A run sends each class down a path:
its bucket is named by a sampled minhash token (a token shared with the similarity's probability). Buckets of few
classes are compared by brute force on their signatures; larger ones are split again by two further sampled tokens
each, unless most of a bucket shares them, when splitting can't help. Runs are repeated until a pair at the threshold
is missed with a probability below 1 - RECALL, all levels of splitting counted. What the buckets link are candidate
groups: they are verified on the exact sets, all pairs of a group at once. A group beyond BLOCK classes is cut into
blocks, each written once; what is dealt out are pairs of block files, so no set is copied for the pairs it is in.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import Sums, WordHashes, mix, numbered
from .common import discard, materialize, shared_dir, tidy
from .components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99999999
#: Coordinates of a signature; classes to a bucket that is compared at once; branches and levels of a split.
COORDINATES, SMALL, BRANCHES, LEVELS = 64, 200, 2, 6
#: Share of a bucket that follows one token from which on splitting is given up; least agreement of signatures.
DENSE, LEAST_AGREEMENT = 0.5, 0.5
#: Classes that one task compares with as many others.
BLOCK = 2000
#: What a null doc_id counts as.
LAST = (1 << 63) - 1


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at the threshold has shared a bucket with probability `recall`, if its buckets are split
    on every level: it shares the first token, and on each level at least one of the branches."""
    met = similarity * (1 - (1 - similarity) ** BRANCHES) ** LEVELS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def shingles(symbols: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; of all words, if there are fewer."""
    return np.unique(Sums(symbols).every(min(n, len(symbols)))) if len(symbols) else np.empty(0, np.uint64)


def coefficients() -> np.ndarray:
    return mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signature(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least hash of the set in each coordinate."""
    best = np.full(len(by), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        best = np.minimum(best, mix(s[at : at + 2048, None] * by).min(0))
    return best


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(row, d, f, g, size, sig) of numbered documents: a 128-bit print of the set, its size, its signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, hashes, by = zstandard.ZstdDecompressor(), WordHashes(), coefficients()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                f, g, size, sig = [], [], [], []
                for z in part.column("z").to_pylist():
                    s = shingles(hashes.symbols([] if z is None else loose.decompress(z).split()), n)
                    f.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    g.append(int(mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).astype(np.int64)))
                    size.append(len(s))
                    sig.append(signature(s, by).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("d"), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], names=["row", "d", "f", "g", "size", "sig"])

    return docs.select("row", "d", "z").mapInArrow(tidy(sketch), "row long, d long, f long, g long, size int, sig binary")


def first_paths(classes: DataFrame, runs: int) -> DataFrame:
    """(path, id, s8) of every run; s8 holds a byte of each coordinate."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(-1, COORDINATES)
                bytes8 = pa.array([x.tobytes() for x in (sig & np.uint64(255)).astype(np.uint8)], pa.binary())
                for run in range(runs):
                    path = mix(sig[:, run % COORDINATES] ^ mix(np.full(1, run + 1, np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column("id"), bytes8], names=["path", "id", "s8"])

    return classes.select("id", "sig").mapInArrow(tidy(walk), "path long, id long, s8 binary")


def next_paths(rows: DataFrame) -> DataFrame:
    """(parent, branch, path, id, s8): every row of a large bucket on each branch, by a token sampled for the bucket."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parent = np.asarray(batch.column("path")).view(np.uint64)
            s8 = np.frombuffer(b"".join(batch.column("s8").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            for branch in range(BRANCHES):
                seed = mix(parent + np.uint64(branch + 1))
                token = s8[np.arange(len(s8)), (seed % np.uint64(COORDINATES)).astype(np.int64)]
                path = mix(seed ^ (token.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(np.full(len(s8), branch, np.int32)), pa.array(path.view(np.int64)), batch.column("id"), batch.column("s8")], names=["parent", "branch", "path", "id", "s8"])

    return rows.select("path", "id", "s8").mapInArrow(tidy(walk), "parent long, branch int, path long, id long, s8 binary")


def leaf_buckets(classes: DataFrame, runs: int) -> DataFrame:
    """(path, id, s8, n) of the buckets to compare: those of few classes, and those that are dense."""
    rows, leaves = materialize(first_paths(classes, runs), "paths"), []
    for level in range(LEVELS + 1):
        # Sizes are summed up before they move, and written, so that the join can split a large bucket.
        sizes = materialize(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        counted = materialize(rows.join(sizes, "path").select("path", "id", "s8", "n"), "counted")
        discard(sizes)
        leaves.append(counted.where(F.col("n") <= SMALL))
        big = counted.where(F.col("n") > SMALL)
        if not big.head(1):
            break
        if level == LEVELS:
            leaves.append(big)
            break
        children = materialize(next_paths(big), "children")
        share = children.groupBy("parent", "branch", "path").count().groupBy("parent", "branch").agg((F.max("count") / F.sum("count")).alias("x"))
        dense = materialize(share.groupBy("parent").agg(F.max("x").alias("x")).where(F.col("x") >= DENSE).select(F.col("parent").alias("path")), "dense")
        leaves.append(big.join(dense, "path", "left_semi"))
        discard(rows)
        rows = materialize(children.join(dense.select(F.col("path").alias("parent")), "parent", "left_anti").select("path", "id", "s8"), "paths")
        discard(children)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal leading columns, across batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def alike(ids: np.ndarray, s8: np.ndarray) -> tuple[list, list]:
    """Edges that span the groups of a bucket whose signatures agree in LEAST_AGREEMENT of the coordinates, by search
    from one member to the next; what is reached is compared no more, so a dense bucket takes a few rounds."""
    left, u, v = np.arange(len(ids)), [], []
    while len(left) > 1:
        root, left, front = ids[left[0]], left[1:], [left[0]]
        while front and len(left):
            same = (s8[left] == s8[front.pop()]).sum(1) >= LEAST_AGREEMENT * COORDINATES
            u += [root] * int(same.sum())
            v += ids[left[same]].tolist()
            front += left[same].tolist()
            left = left[~same]
    return u, v


Rows = list[tuple]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


def all_pairs(rows: DataFrame, group: str, payload: list[str], core: Callable[[Rows, int | None], pa.RecordBatch], schema: str) -> DataFrame:
    """core(rows, split) for the pairs of rows (id, payload) of each group; n tells a group's size.

    A group of at most BLOCK rows is handed over at once, with None. A larger one is cut into blocks by a hash of id.
    Each block is written to a file of its own in the shared folder by the task that has gathered it; its name holds
    the attempt, so a repeated task leaves only a file that nothing names. Every pair of blocks is then a row of its own, of two
    names, and core gets the rows of the first block, those of the second, and where the second begins (0: one block).
    """
    columns = ["id", *payload]
    small = rows.where(F.col("n") <= BLOCK).select(group, *columns)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = rows.where(F.col("n") > BLOCK).select(group, F.pmod(F.xxhash64("id"), blocks).alias("block"), *columns)
    folder = f"{shared_dir(rows.sparkSession)}/blocks/{uuid.uuid4().hex}"
    kinds = pa.schema([(c, {"bigint": pa.int64(), "binary": pa.binary()}[rows.schema[c].dataType.simpleString()]) for c in columns])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, 1):
            yield core([r[1:] for r in own], None)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _file_system(folder)
        for own in _groups(batches, 2):
            files.create_dir(path, recursive=True)
            name = f"{own[0][0] & 0xFFFFFFFFFFFFFFFF:016x}-{own[0][1]:06d}-{TaskContext.get().taskAttemptId()}.arrow"
            with files.open_output_stream(f"{path}/{name}", compression=None) as out, pa.ipc.new_stream(out, kinds) as writer:
                writer.write_batch(pa.record_batch([pa.array(c, k.type) for c, k in zip(list(zip(*own, strict=True))[2:], kinds, strict=True)], schema=kinds))
            yield pa.RecordBatch.from_arrays([pa.array([own[0][0]]), pa.array([own[0][1]], pa.int64()), pa.array([name])], names=["of", "block", "file"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _file_system(folder)

        def load(name: str) -> Rows:
            with files.open_input_stream(f"{path}/{name}", compression=None) as source, pa.ipc.open_stream(source) as reader:
                return list(zip(*(c.to_pylist() for c in reader.read_all().columns), strict=True))

        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = load(x)
                yield core(first, 0) if x == y else core(first + load(y), len(first))

    done = small.repartition(group).sortWithinPartitions(group).mapInArrow(tidy(whole), schema)
    files = materialize(large.repartition(group, "block").sortWithinPartitions(group, "block").mapInArrow(tidy(store), "of long, block long, file string"), "block-files")
    if not files.head(1):
        return done
    other = files.select("of", F.col("block").alias("block2"), F.col("file").alias("file2"))
    pairs = materialize(files.join(other, "of").where("block <= block2").select("file", "file2"), "block-pairs")
    tasks = max(1, min(pairs.count(), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return done.unionByName(pairs.repartition(tasks, "file", "file2").mapInArrow(tidy(compare), schema))


def candidate_edges(leaves: DataFrame) -> DataFrame:
    """(u, v) of classes whose signatures agree, from the leaf buckets; a spanning forest of each bucket."""

    def core(rows: Rows, split: int | None) -> pa.RecordBatch:
        u, v = alike(np.array([r[0] for r in rows]), np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, COORDINATES))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return all_pairs(leaves, "path", ["s8"], core, "u long, v long")


def intersections(sets: list[np.ndarray], split: int = 0) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, or of the first `split` ones with the others: rare members pair
    by pair, frequent ones by matrix products."""
    m = len(sets)
    ours, theirs = (slice(0, split), slice(split, m)) if split else (slice(0, m), slice(0, m))
    low = split or 0
    wide = m - low
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values := np.concatenate(sets), kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    count = np.diff(np.append(first, len(values)))
    out = np.zeros((split or m) * wide, np.float32)
    for k in range(2, min(17, m + 1)):
        rows = owner[first[count == k][:, None] + np.arange(k)]  # in a row, owners ascend
        for i in range(k if len(rows) else 0):
            for j in range(i + 1, k):
                a, b = rows[:, i], rows[:, j]
                if split:
                    across = (a < split) & (b >= split)
                    a, b = a[across], b[across]
                pair, times = np.unique(a * wide + (b - low), return_counts=True)
                out[pair] += times
    out = out.reshape(-1, wide)
    if not split:
        out = out + out.T
    often = np.flatnonzero(count > 16)
    width = max(64, min(4096, (32 << 20) // (4 * m)))
    for at in range(0, len(often), width):
        own = often[at : at + width]
        x = np.zeros((m, len(own)), np.float32)
        x[owner[np.concatenate([np.arange(f, f + c) for f, c in zip(first[own], count[own], strict=True)])], np.repeat(np.arange(len(own)), count[own])] = 1
        out += x[ours] @ x[theirs].T
    return out


LINK = "id long, root long, links long"


def verified(groups: DataFrame, similarity: float) -> DataFrame:
    """LINK rows from (component, n, id, weight, members) rows: exact links of each class among the pairs of a task."""

    def core(rows: Rows, split: int | None) -> pa.RecordBatch:
        ids, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets], np.float64)
        linked = np.zeros((len(rows), len(rows)), bool)
        both = intersections(sets, split or 0)
        for i in range(len(both)):  # row by row, so no second matrix of numbers is needed
            theirs = size[split or 0 :]
            linked[i, split or 0 :] = both[i].astype(np.float64) * (1 + similarity) >= similarity * (size[i] + theirs) - 1e-6
        if split:
            linked |= linked.T
        np.fill_diagonal(linked, False)
        links = linked @ weight
        root = ids.copy()
        left = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if left[i]:
                left[i], front = False, [i]
                while front:
                    new = np.flatnonzero(linked[front.pop()] & left)
                    left[new], root[new] = False, ids[i]
                    front += new.tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(links.astype(np.int64))], names=["id", "root", "links"])

    return all_pairs(groups, "component", ["weight", "members"], core, LINK)


def member_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows with the shingles of the packed text z as `members`."""
    names = [c for c in rows.columns if c != "z"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, hashes = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                sets = [shingles(hashes.symbols(loose.decompress(z).split()), n).tobytes() for z in part.column("z").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "members"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", members binary"
    return rows.mapInArrow(tidy(unpack), schema)


def similar_documents(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, **more: Column) -> DataFrame:
    """(doc_id, more, class_id, copy_id, n_links, first) of each row of docs; more: further longs of a row.

    Documents are linked if the Jaccard similarity of their n-word shingle sets is at least `similarity`; words are
    runs of non-space characters, unchanged. class_id is the smallest doc_id of the documents connected by links,
    copy_id the smallest with an equal set, n_links the number of other rows linked to this one, copies included. first
    marks the one row of a class that stands for it.

    A text of fewer words than n is one shingle. Null texts and texts without words have empty sets: they link to
    nothing and are classes of their own. A null doc_id counts as the largest and comes back as null. Rows are known by
    a number of their own, so rows of equal or null doc_id are told apart; repeated rows are copies of each other. An
    empty table gives an empty table; further columns are not read.
    """
    texts = numbered(docs, LAST, **more)
    sketched = materialize(sketches(texts, n), "sketches")
    spoken = sketched.where("size > 0")
    classes = spoken.groupBy("f", "g").agg(F.min(F.struct("d", "row")).alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "f", "g", "rep.d", "rep.row", "weight", "sig"), "classes")
    pairs = components(candidate_edges(leaf_buckets(classes, runs_for(recall, similarity))))
    pairs = materialize(pairs, "candidates")
    groups = pairs.join(materialize(pairs.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "group-sizes"), "component")
    members = classes.select("id", "row", "weight").join(groups, "id")
    sets = member_sets(texts.select("row", "z").join(members, "row").select("component", "id", "n", "weight", "z"), n)
    links = materialize(verified(sets, similarity), "links")
    joined = materialize(components(links.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v"))), "linked")
    per_class = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "f", "g", "d", "row", "weight").join(joined, "id", "left").join(per_class, "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min(F.struct("d", "row")).alias("least"))
    table = known.join(least, "component").select("f", "g", F.col("d").alias("copy"), "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketched.select("row", "d", (F.col("size") > 0).alias("spoken"), "f", "g")
    out = out.join(materialize(table, "class-table").withColumn("spoken", F.lit(True)), ["spoken", "f", "g"], "left")
    known_id = lambda c: F.nullif(F.coalesce(c, "d"), F.lit(LAST))
    out = out.select(
        "row", known_id("least.d").alias("class_id"), known_id("copy").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("row") == F.col("least.row"), F.lit(True)).alias("first"),
    )
    return texts.select("row", "doc_id", *more).join(out, "row").drop("row")


def one_of_each(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of similar_documents(), that of the smallest doc_id; all columns stay.

    Rows without words stay, those of equal doc_id and text once. A row is found again by its doc_id and 128 bits of
    hash of its text.
    """
    text = F.coalesce("text", F.lit(""))
    key = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_t": F.xxhash64("text"), "_u": F.xxhash64(F.lit(1), F.reverse(text))}
    stay = similar_documents(docs, n, similarity, **key).where("first").select(*key).distinct()
    kept = docs.select(F.struct("*").alias("doc"), *(k.alias(c) for c, k in key.items())).join(stay, [*key], "left_semi")
    return kept.dropDuplicates([*key]).select("doc.*")
