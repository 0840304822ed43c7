"""Near-duplicates by an LSH forest.

Documents are sets of word shingles. Documents of equal sets are one class. Each class gets
TREES x DEPTH minhashes; a tree is the sorted order of the classes by its DEPTH minhashes. In
that order a class's candidates are the nearest classes on either side that share at least
MIN_PREFIX minhashes with it: they have the longest common prefixes, so where a region is
crowded the candidates share more of the prefix, where it is sparse they share less. A
sketch of all minhashes drops candidates that are out of reach of the threshold by more than
six standard deviations; the rest is confirmed on the full sets. The forest is walked twice:
first only direct neighbours are confirmed, which joins up most of every group
however large it is; then all candidates whose ends are still apart. That gives the same
components as confirming all of them, with few pairs per class.

A class whose NEIGHBOURS-th neighbour still shares MIN_PREFIX minhashes lies in a crowded
region, where its window may end before a link. Two classes that share a prefix but lie
further apart in the order are both such classes, so whole regions of them are compared
(`crowded_links`) instead of the second walk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import fresh, named, table_written, text_of
from usetrail.llm.graph import components
from usetrail.llm.hashing import LOWER, grams, word_hashes
from usetrail.session import scratch_dir

TREES, DEPTH, MIN_PREFIX = 12, 6, 3
NEIGHBOURS = 24
#: Classes of a crowded region that one task compares with each other or with as many others, and their bytes.
BLOCK, BLOCK_BYTES = 4000, 16 << 20
HASHES = TREES * DEPTH
#: Rows of the sorted orders per task.
TASK_ROWS = 50_000
_RANDOM = np.random.default_rng(97)
_SCALE = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = word_hashes(text.encode().translate(LOWER))
    return np.unique(grams(words, min(width, len(words)))) if len(words) else words


def minhashes(found: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        part = found[i : i + 1024, None] * _SCALE
        part += _SHIFT
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch_of(signature: np.ndarray) -> bytes:
    """Four bits of every minhash, two to a byte."""
    bits = (signature * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).tobytes()


def least_agreement(similarity: float, chance: float = 1 / 16) -> int:
    """Values that agree in all pairs of that similarity but for a six-sigma event.

    `chance`: how often values of different minhashes agree (sketches: four bits).
    """
    p = similarity + (1 - similarity) * chance
    return max(1, math.floor(HASHES * p - 6 * math.sqrt(HASHES * p * (1 - p))))


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a ^ b
    return ((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _neighbours(
    keys: np.ndarray, sketches: np.ndarray, first: int, agree: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (row, earlier row) of the rows from `first` on, and the rows whose window is full.

    Prefixes get shorter with distance, so a row leaves once it shares too little with the
    row at hand.
    """
    prefix = 4 * (1 + MIN_PREFIX)
    rows = np.arange(max(first, 1), len(keys))
    ends: tuple[list, list] = ([], [])
    for distance in range(1, NEIGHBOURS + 1):
        rows = rows[rows >= distance]
        rows = rows[(keys[rows, :prefix] == keys[rows - distance, :prefix]).all(axis=1)]
        if not len(rows):
            break
        good = rows[_agreement(sketches[rows], sketches[rows - distance]) >= agree]
        ends[0].append(good)
        ends[1].append(good - distance)
    none = np.zeros(0, np.int64)
    full = np.concatenate((rows, rows - NEIGHBOURS)) if len(rows) else none
    return np.concatenate([none, *ends[0]]), np.concatenate([none, *ends[1]]), full


def signatures(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, set_id, signature, sketch; one row per document."""
    names = ["doc_id", "row_key", "n_shingles", "set_id", "signature", "sketch"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row_key, body in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"], strict=True):
                found = shingles(body.as_py(), width)
                if len(found):
                    signature = minhashes(found)
                    rows.append((doc, row_key, len(found), xxhash.xxh3_128_digest(found.tobytes()),
                                 signature.astype(">u4").tobytes(), sketch_of(signature)))
                else:
                    rows.append((doc, row_key, 0, None, None, None))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.binary()] * 3
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    body = text_of(docs, text)
    source = docs.select(named(docs, key).cast("long").alias("doc_id"), F.xxhash64(body).alias("row_key"), body.alias("text"))
    return source.mapInArrow(
        made, "doc_id long, row_key long, n_shingles long, set_id binary, signature binary, sketch binary"
    )


PAIRS = "a binary, b binary"


def candidates(classes: DataFrame, similarity: float, path: str, direct: bool) -> DataFrame:
    """a, b: class pairs (a < b) that the forest finds, each once, and (a, null) per class.

    `direct`: only direct neighbours are paired, every class that has any candidate or lies
    in a crowded region is listed with a null, and the latter with an empty b as well.
    Otherwise all candidates are paired whose `mark` differs, save those of two crowded
    classes (odd marks), which `crowded_links` joins up. The sorted orders are cut into ranges of rows; what lies across a
    cut is found from the last rows before and the first rows after it, so cuts lose no
    neighbour.
    """
    agree = least_agreement(similarity)
    parts = max(1, math.ceil(classes.count() * TREES / TASK_ROWS))
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = classes.select("set_id", "sketch", "signature", "mark", tree.alias("tree")).select(
        F.concat(F.unhex(F.lpad(F.hex("tree"), 8, "0")), F.substring("signature", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))).alias("key"),
        "set_id", "sketch", "mark",
    )
    schema = "seam long, side int, a binary, b binary, key binary, sketch binary, mark long"
    kinds = {"seam": pa.int64(), "side": pa.int32(), "mark": pa.int64()}
    names = ["seam", "side", "a", "b", "key", "sketch", "mark"]

    def arrays(batch) -> tuple[np.ndarray, ...]:
        ids = batch["set_id"] if "set_id" in batch.schema.names else batch["a"]
        return (_bytes(batch["key"], 4 + 4 * DEPTH), _bytes(ids, 16), _bytes(batch["sketch"], HASHES // 2),
                batch["mark"].to_numpy(zero_copy_only=False).astype(np.int64))

    def table(n: int, **columns: list) -> pa.Table:
        full = {c: columns.get(c, [None] * n) for c in names}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in full.items()})

    def edge(seam: int, side: int, keys, sets, sketches, marks) -> pa.Table:
        n = len(keys)
        return table(n, seam=[seam] * n, side=[side] * n, a=[x.tobytes() for x in sets], key=[x.tobytes() for x in keys],
                     sketch=[x.tobytes() for x in sketches], mark=marks.tolist())

    def paired(keys, sets, sketches, marks, first: int, left: int | None = None) -> pa.Table:
        i, j, full = _neighbours(keys, sketches, first, agree)
        if left is not None:
            across = (i >= left) & (j < left)
            i, j = i[across], j[across]
        alone: list[bytes] = []
        crowded: list[bytes] = []
        if direct:
            alone = [sets[x].tobytes() for x in np.unique(np.concatenate((i, j, full)))]
            crowded = [sets[x].tobytes() for x in np.unique(full)]
            near = i - j == 1
        else:
            near = (marks[i] >> 1 != marks[j] >> 1) & (marks[i] & marks[j] & 1 == 0)
        ends = [sorted((sets[x].tobytes(), sets[y].tobytes())) for x, y in zip(i[near], j[near], strict=True)]
        return table(
            len(alone) + len(crowded) + len(ends), a=alone + crowded + [e[0] for e in ends],
            b=[None] * len(alone) + [b""] * len(crowded) + [e[1] for e in ends],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, head = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = arrays(batch)
            if head < NEIGHBOURS:
                yield from edge(part - 1, 1, *(x[: NEIGHBOURS - head] for x in new)).to_batches()
                head += min(NEIGHBOURS - head, batch.num_rows)
            carried = 0 if held is None else len(held[0])
            both = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            yield from paired(*both, carried).to_batches()
            held = tuple(x[-NEIGHBOURS:] for x in both)
        if held is not None:
            yield from edge(part, 0, *held).to_batches()

    def seam(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("side", "ascending"), ("key", "ascending"), ("a", "ascending")])
        left = int((rows["side"].to_numpy() == 0).sum())
        return paired(*arrays(rows), left, left).select(["a", "b"])

    ordered = rows.repartitionByRange(parts, "key", "set_id").sortWithinPartitions("key", "set_id")
    scanned = table_written(ordered.mapInArrow(scan, schema), path)
    seams = scanned.where("seam IS NOT NULL").groupBy("seam").applyInArrow(seam, PAIRS)
    return scanned.where("seam IS NULL").select("a", "b").union(seams).distinct()


def crowded_links(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links that join up the classes (set_id, signature, n_shingles, mark) whose marks differ.

    Two classes of crowded regions that share the first MIN_PREFIX minhashes of a tree lie in
    one region of it, however far apart in the order. Regions with more than one mark are cut
    into blocks of bounded rows and bytes, and each pair of blocks is a group of its own. A
    group compares every pair of different marks on the full sets, passing over pairs
    that an earlier tree compares and pairs its links have joined already, so it gives fewer
    links than it has rows and yet joins all that is linked.
    """
    least = least_agreement(percent / 100, 0)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = crowded.select("set_id", "signature", "n_shingles", "mark", tree.alias("tree")).withColumn(
        "region", F.substring("signature", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * MIN_PREFIX))
    )
    regions = rows.groupBy("tree", "region").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("held"), F.min("mark").alias("m0"), F.max("mark").alias("m1")
    ).where("m0 < m1").select(
        "tree", "region", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("held") / BLOCK_BYTES)).alias("blocks")
    )
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    dealt = rows.join(regions, ["tree", "region"]).withColumn("block", block).select(
        "set_id", "signature", "mark", "tree", "region", "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    ).select(
        "*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    ).drop("other").join(sets, "set_id")

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, block = rows["set_id"].to_pylist(), rows["block"].to_numpy()
        sign = _bytes(rows["signature"], 4 * HASHES).view(">u4")
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["members"]]
        size = np.array([len(x) for x in held])
        label = np.unique(rows["mark"].to_numpy(), return_inverse=True)[1]
        open_ = np.ones(len(ids), bool)
        ends: list[tuple[bytes, bytes]] = []
        for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
            open_[i] = False
            near = open_ & (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if key[2].as_py() != key[3].as_py():
                near &= block != block[i]
            near = np.flatnonzero(near)
            same = sign[near] == sign[i]
            agree = same.sum(axis=1)
            before = same.reshape(-1, TREES, DEPTH)[:, : key[0].as_py(), :MIN_PREFIX].all(axis=2).any(axis=1)
            order = np.argsort(-agree, kind="stable")
            for j in near[order[(agree[order] >= least) & ~before[order]]].tolist():
                if label[i] != label[j]:
                    at = np.searchsorted(held[i], held[j])
                    shared = int((held[i][np.minimum(at, size[i] - 1)] == held[j]).sum())
                    if 100 * shared >= percent * (size[i] + size[j] - shared):
                        ends.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
        return pa.table({"u": pa.array([e[0] for e in ends], pa.binary()), "v": pa.array([e[1] for e in ends], pa.binary())})

    return dealt.groupBy("tree", "region", "low", "high").applyInArrow(joined, "u binary, v binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: the pairs (a, b) whose sets (set_id, members) share `percent` % of their union."""
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("right"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
            rows = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.record_batch([rows["a"], rows["b"]], ["u", "v"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        compared, "u binary, v binary"
    )


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept, head; one row per document.

    Documents are linked if their shingle sets share at least `percent` % of their union.
    `component_id` is the least id reachable over links, `kept` whether it is the document's
    own; `row_key` is a hash of the text; `head` marks one text of each component, also where
    ids are null or repeated. Texts without words are linked with nothing.
    Null ids are linked like others but do not name a component unless nothing else does;
    rows that repeat an id and its text are both kept or both not. An empty table gives no
    row. Links are found with probability 1 - (1 - s**MIN_PREFIX)**TREES or more at similarity
    s, that is all but one in 90,000 at 0.85 and fewer above; also in crowded regions.
    """
    folder = scratch_dir(docs.sparkSession, "minhash")
    made = table_written(signatures(docs, width, key, text), f"{folder}/signatures")
    classes = made.where("n_shingles > 0").groupBy("set_id").agg(
        F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
        F.first("n_shingles").alias("n_shingles"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least"),
    )
    direct = candidates(classes.withColumn("mark", F.lit(0).cast("long")), percent / 100, f"{folder}/direct", True)
    direct = table_written(direct, f"{folder}/direct-pairs")
    wanted = classes.join(direct.where("b IS NULL").select(F.col("a").alias("set_id")), "set_id").select(
        "set_id", F.col("least.doc_id").alias("doc_id"), F.col("least.row_key").alias("row_key")
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).tobytes() for t in batch["text"]]
            yield pa.record_batch([batch["set_id"], pa.array(found, pa.binary())], ["set_id", "members"])

    body = text_of(docs, text)
    texts = docs.select(named(docs, key).cast("long").alias("id"), F.xxhash64(body).alias("hash"), body.alias("text"))
    fetched = texts.join(
        wanted, (texts["hash"] == wanted["row_key"]) & texts["id"].eqNullSafe(wanted["doc_id"])
    ).select("set_id", "text").mapInArrow(members, "set_id binary, members binary")
    sets = table_written(fetched.dropDuplicates(["set_id"]), f"{folder}/members")

    crowded = direct.where("b = X''").select(F.col("a").alias("set_id"))
    links = table_written(confirmed(direct.where("b <> X''"), sets, percent), f"{folder}/direct-links")
    found = components(links)
    marked = classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").join(
        crowded.withColumn("odd", F.lit(1)), "set_id", "left"
    ).withColumn("mark", F.expr("shiftleft(xxhash64(coalesce(root, set_id)), 1) | coalesce(odd, 0)"))
    apart = candidates(marked, percent / 100, f"{folder}/apart", False)
    more = links.union(table_written(confirmed(apart, sets, percent), f"{folder}/more-links"))
    if not crowded.isEmpty():
        inside = table_written(marked.where("odd = 1").select("set_id", "signature", "n_shingles", "mark"), f"{folder}/crowded")
        more = more.union(table_written(crowded_links(inside, sets, percent), f"{folder}/crowded-links"))
    found = components(more)

    rooted = classes.select("set_id", "least").join(
        found.withColumnRenamed("node", "set_id"), "set_id", "left"
    ).select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    named_by = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_set = rooted.join(named_by, "root").select("set_id", "component")
    has_words = F.col("n_shingles") > 0
    return made.select("doc_id", "row_key", "n_shingles", "set_id").join(of_set, "set_id", "left").select(
        "doc_id", "row_key", "n_shingles",
        F.when(has_words, F.col("component.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~has_words | (F.col("row_key") == F.col("component.row_key"))).alias("head"),
    ).select(
        "doc_id", "row_key", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("head") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("head"),
    )


def deduplicated(docs: DataFrame, width: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with its columns; a row that repeats its id and text goes as well."""
    verdict = near_duplicates(docs, width, percent, key, text).where("head").select("doc_id", "row_key").distinct()
    (hashed,) = fresh(docs, "row_key")
    marked = docs.withColumn(hashed, F.xxhash64(text_of(docs, text)))
    verdict = verdict.withColumnsRenamed({"doc_id": "kept_id", "row_key": "kept_key"})
    kept = marked.join(
        verdict, marked[f"`{key}`"].cast("long").eqNullSafe(verdict["kept_id"]) & (marked[hashed] == verdict["kept_key"]), "left_semi"
    )
    return kept.dropDuplicates([key, hashed]).select(*[f"`{c}`" for c in docs.columns])
