"""SimHash near-duplicates by pivot distance tables.

Fingerprints: 64-bit majority over XXH64 (seed 42) of word shingles, repeats included. Distinct
fingerprints within a limit of bits are linked, and links make components.

Pivot tables are computed once, with the distinct fingerprints: ``PIVOTS`` bytes each, the Hamming
distances to fixed reference fingerprints, stored beside the fingerprint and carried along. By the
triangle inequality a pair within the limit differs by no more than it in any coordinate. So the
members of a bucket are sorted by their first coordinate, only pairs in neighbouring distance
intervals are looked at, those whose largest coordinate difference exceeds the limit are
discarded, and the survivors are verified bit by bit. Of each bucket only a spanning forest of its
links goes on.

Pivots alone would leave a third of all pairs, so what may share a bucket is narrowed first:

* up to 3 bits (``near_duplicates``): the 64 bits are cut into 6 blocks; two fingerprints at 3 bits
  or fewer agree on at least 3 blocks, so comparing inside each of the 20 choices of 3 equal blocks
  loses no link. A bucket of more than ``MOST`` members is not compared but cut again: the bits not
  yet fixed are split in 4 parts, of which one must be equal. Members are distinct, so after the
  last cut a bucket has at most 2**15: tasks stay bounded and the result exact.
* texts that share 80 % of their five-word shingles and more (``similar``): two such sets have a
  shingle in common among the first fifth of each, in any one order of all shingles. Those found
  often in a sample come last in it, which keeps groups of a common first shingle small. In a group
  the texts within ``TIED`` bits (fingerprints of the distinct shingles, pivots first) are tied, and
  of the others those whose sizes and bitmaps do not rule a link out; ties make clusters, each text
  is in one. The whole shingle sets of a cluster then decide. No step loses a link. A group of more
  than ``CROWD`` members, or a cluster of more than ``WEIGHT`` shingles, is cut into slices, of
  which every two meet.

A null text is empty; without a word the fingerprint is 0. Empty documents link like any other.
Texts of any length are read whole. Repeated rows share a fingerprint. An empty table gives no row.
Extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names;
names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.algorithms.stars import star_components
from weftgraph.llm.common import chunks, discard, lean, materialize

LIMIT = 3
PIVOTS = 16
MOST = 4096
#: Bits of 64 within which texts of a group are tied without a look at their bitmaps, members of a group that meet in one task.
TIED, CROWD = 10, 4096
#: Per cent of their distinct shingles that similar texts share; shingles of a cluster that one task holds, and for how many a row counts besides.
SHARED, WEIGHT, ROW = 80, 2_000_000, 256
#: One text of so many is asked for frequent shingles, in how many of them one is frequent, and how many the driver holds.
ASKED, OFTEN, KNOWN = 16, 4, 200_000
#: Ids up to which a table of them is sent to the texts; beyond, the texts are shuffled.
SENT = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of all texts, repeats included, and their number in each text."""
    from xxhash import xxh64_intdigest as digest

    hashes, counts = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        n = len(words)
        if n <= width:
            hashes += [digest(b" ".join(words), 42)] if n else []
            counts.append(min(n, 1))
            continue
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begins = np.r_[0, ends[: n - width]].tolist()
        hashes += [digest(whole[b:e], 42) for b, e in zip(begins, (ends[width - 1 :] - 1).tolist())]
        counts.append(n - width + 1)
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and their number."""
    h, counts = shingle_hashes(texts, width)
    own = [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])] if len(counts) else []
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.array([len(x) for x in own], np.int64)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: a bit is 1 if it is in over half of the text's hashes."""
    out = np.zeros(len(counts), np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts) * 256
    for byte in range(8):
        at = doc + ((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        table = np.bincount(at, minlength=256 * len(counts)).reshape(-1, 256)
        ones = table @ _BITS > counts[:, None] / 2
        out |= (ones @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(texts: list[str], width: int = 3) -> np.ndarray:
    """SimHash of each text as uint64."""
    return majority(*shingle_hashes(texts, width))


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) with the fingerprint as a signed long in `fp`."""
    kept = docs.drop("fp")
    at = kept.columns.index(text)
    names = [c for c in kept.columns if c not in drop]
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [np.zeros(0, np.uint64)]
            fps += [fingerprints(part, width) for _, part in chunks(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(fps).view(np.int64))], names=schema.fieldNames())

    return kept.mapInArrow(lean(run), schema)


def _pivots() -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence."""
    return np.random.default_rng(42).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1).astype(np.int8)


def close(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs (i, j) are within limit: discarded by the pivot tables first, then verified."""
    near = np.ones(len(i), bool)
    for k in range(0, table.shape[1], 4):
        own = table[:, k : k + 4]
        at = np.flatnonzero(near)
        near[at] = (np.abs(own[i[at]] - own[j[at]]) <= limit).all(axis=1)
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count(fps[i[at]] ^ fps[j[at]]) <= limit
    return near


def with_pivots(fps: DataFrame) -> DataFrame:
    """fps with the column pivots: the distances of fp to the reference fingerprints, a byte each."""
    schema = T.StructType([*fps.drop("pivots").schema.fields, T.StructField("pivots", T.BinaryType())])
    kept, pivots = fps.drop("pivots"), _pivots()
    at = kept.columns.index("fp")

    def run(batches):
        for batch in batches:
            table = distance_table(batch.column(at).to_numpy().view(np.uint64), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in table], pa.binary())], names=schema.fieldNames())

    return kept.mapInArrow(lean(run), schema)


def bucket_links(fps: np.ndarray, table: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one bucket, as index pairs.

    In order of the first pivot distance, each member meets those after it as long as they are in
    its distance interval.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    n, out = len(fps), []
    label = np.arange(n)
    reach = np.searchsorted(table[:, 0], table[:, 0] + limit, side="right")  # end of each one's interval
    far = np.arange(n)
    for step in range(1, n):
        far = far[reach[far] > far + step]
        if not len(far):
            break
        i = far[label[far] != label[far + step]]
        j = i + step
        near = close(fps, table, i, j, limit)
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            if label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label[label == high] = low
                out.append((int(order[a]), int(order[b])))
        if not label.any():
            break
    return out


def block_masks() -> list[int]:
    """The 20 masks of 3 of 6 blocks."""
    widths, at, blocks = (11, 11, 11, 11, 10, 10), 0, []
    for w in widths:
        blocks.append(((1 << w) - 1) << at)
        at += w
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def finer_masks(mask: int) -> list[int]:
    """mask with a quarter of its free bits fixed as well, for each quarter."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::4]) for k in range(4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(limit: int, most: int | None):
    """Map task over rows (mask, bucket, fp, pivots) sorted by bucket: kind 0 rows are links, kind 1 rows members of buckets to cut.

    Without most no bucket is cut. A bucket is held until it ends, or until it has more than most.
    """

    def small(fps, table, size, begin):
        """Links in buckets of up to 8, all at once."""
        rows = np.flatnonzero((size > 1) & (size <= 8))
        if not len(rows):
            return None
        own = np.repeat(begin[rows], size[rows])
        at = own + (np.arange(len(own)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]))
        end = np.repeat(begin[rows] + size[rows], size[rows])
        sub, near_table = fps[at], table[at]
        a, b = [], []
        for step in range(1, 8):
            i = np.flatnonzero(at + step < end)
            near = close(sub, near_table, i, i + step, limit)
            a.append(sub[i[near]])
            b.append(sub[i[near] + step])
        return emit(0, 0, np.concatenate(a), np.concatenate(b))

    def emit(kind, mask, a, b):
        n = len(a)
        cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, mask, np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "mask", "a", "b"])

    def large(mask, bucket, fps, table):
        if most is not None and len(fps) > most:
            yield emit(1, mask, np.full(len(fps), bucket, np.int64), fps)
        elif len(fps) > 1 and (pairs := bucket_links(fps, table, limit)):
            yield emit(0, 0, fps[[p[0] for p in pairs]], fps[[p[1] for p in pairs]])

    def run(batches):
        at, held, over = None, [], False  # the bucket that the last batch ended in; over: it is to be cut

        def end():
            if held:
                yield from large(*at, *(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, bucket, fps = (batch.column(k).to_numpy() for k in range(3))
            fps, raw = fps.view(np.uint64), batch.column(3)
            table = np.frombuffer(raw.buffers()[2], np.int8)
            first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
            table = table[first : first + PIVOTS * len(fps)].reshape(-1, PIVOTS)
            begin = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])])
            size = np.diff(np.r_[begin, len(fps)])
            low, last = 0, len(begin) - 1
            if at == (mask[0], bucket[0]):
                if over:
                    yield emit(1, mask[0], np.full(size[0], bucket[0], np.int64), fps[: size[0]])
                else:
                    held.append((fps[: size[0]], table[: size[0]]))
                low = 1
            if low <= last:
                yield from end()
                inner = slice(low, last)
                if (out := small(fps, table, size[inner], begin[inner])) is not None:
                    yield out
                for k in range(low, last):
                    if size[k] > 8:
                        own = slice(begin[k], begin[k] + size[k])
                        yield from large(mask[begin[k]], bucket[begin[k]], fps[own], table[own])
                at, over = (mask[begin[last]], bucket[begin[last]]), False
                held = [(fps[begin[last] :].copy(), table[begin[last] :].copy())]
            if most is not None and sum(len(x[0]) for x in held) > most:  # what has come and what comes is cut
                yield from end()
                held, over = [], True
        yield from end()

    return lean(run)


def _compared(rows: DataFrame, limit: int, most: int | None) -> DataFrame:
    """Links and members to cut of rows (mask, bucket, fp, pivots)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("mask", "bucket", "fp", "pivots").repartition(parts, "mask", "bucket")
    rows = rows.sortWithinPartitions("mask", "bucket", "fp")
    return materialize(rows.mapInArrow(_compare(limit, most), "kind int, mask long, a long, b long"), "simhash")


def links(fps: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """(src, dst): enough links between distinct fingerprints (column fp, and pivots if there) to span every component; exact."""
    if limit > LIMIT:
        raise ValueError(f"the blocks are made for {LIMIT} bits")
    own = fps if "pivots" in fps.columns else with_pivots(fps.select("fp").distinct())
    keys = own.select("fp", "pivots", F.explode(F.array(*[F.lit(_signed(m)) for m in block_masks()])).alias("mask"))
    out = None
    for level in range(4):
        rows = keys.withColumn("bucket", F.col("mask").bitwiseAND(F.col("fp")))
        found = _compared(rows, limit, most if level < 3 else None)
        linked = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        out = linked if out is None else out.union(linked)
        cut = found.where("kind = 1")
        if level == 3 or cut.isEmpty():
            return out
        masks = {r[0]: [_signed(m) for m in finer_masks(r[0] & (1 << 64) - 1)] for r in cut.select("mask").distinct().collect()}
        finer = F.create_map(*[x for m, fine in masks.items() for x in (F.lit(m), F.array(*map(F.lit, fine)))])  # 20 masks, then 80, 320
        again = cut.select(F.col("b").alias("fp"), F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        keys = again.join(own.select("fp", "pivots"), "fp")
    return out


def least_shared(n, shared: int = SHARED):
    """Shingles that a set of n has in common with any set it is linked to, at the least."""
    return -(-shared * n // 100)


def frequent_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in `OFTEN` or more of every `ASKED`-th text of rows (id, text), ascending, and their counts.

    They only decide an order, so which texts are asked changes the work and not the result.
    """

    def run(batches):
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part, width)[0].view(np.int64))], names=["shingle"])

    asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(ASKED)) == 0).select("text").mapInArrow(lean(run), "shingle long")
    counted = asked.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    table = counted.orderBy(F.desc("n"), "shingle").limit(KNOWN).toArrow()
    known, n = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(known)
    return known[order], n[order]


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each value of the hashes' low bits, one bit a shingle or more: whether an odd number of them has it.

    Every bit in which two bitmaps differ stands for a shingle that is in one set only. A bitmap of
    twice the length, its halves xored, is the one of the length.
    """
    bits = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def with_marks(rows: DataFrame, width: int, known: np.ndarray, often: np.ndarray) -> DataFrame:
    """(id, fp, n, whole, more, bitmap, keys) of rows (id, text).

    n is the number of distinct shingles, fp the fingerprint of these, whole and more are two hashes
    of their set. keys are its first shingles in one order of all shingles, the known ones last and
    the most frequent of them at the very end: so many that two sets which are linked have a key in
    common.
    """
    from xxhash import xxh64_intdigest as digest

    names = ["id", "fp", "n", "whole", "more", "bitmap", "keys"]
    place = np.empty(len(known), np.int64)
    place[np.lexsort((known, often))] = np.arange(1, len(known) + 1)

    def run(batches):
        for batch in batches:
            for begin, part in chunks(batch.column(1).to_pylist()):
                h, counts = shingle_sets(part, width)
                late = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    late = np.where(known[at] == h, place[at], 0)
                ends = np.cumsum(counts)[:-1]
                sets, keys = np.split(h, ends), []
                for own, own_late in zip(sets, np.split(late, ends)):
                    first = len(own) - least_shared(len(own)) + 1 if len(own) else 0
                    keys.append((own[np.argsort(own_late, kind="stable")] if own_late[:first].any() else own)[:first].view(np.int64))
                whole, more = (pa.array(np.array([digest(x.tobytes(), seed) for x in sets], np.uint64).view(np.int64)) for seed in (42, 43))
                cols = [batch.column(0).slice(begin, len(part)), pa.array(majority(h, counts).view(np.int64)), pa.array(counts), whole, more]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([bitmap(x) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    return rows.select("id", "text").mapInArrow(lean(run), "id long, fp long, n long, whole long, more long, bitmap binary, keys array<long>")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, a table of files, marked as sent to all tasks if it is not too long."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def key_groups(keys: DataFrame) -> DataFrame:
    """(bucket, id, members): the ids of rows (key, id) that have a key in common; groups with the same members are one."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.repartition(parts, "key").sortWithinPartitions("key", "id")

    def run(batches):
        seen = set()

        def groups(key, ids):
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), begin)
            some = np.flatnonzero(size > 1)
            some = some[np.unique(bucket[some], return_index=True)[1]]
            new = [k for k, x in zip(some.tolist(), bucket[some].tolist()) if x not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(bucket[new].tolist())
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(begin[k], begin[k] + size[k]) for k in new)])
            cols = [np.repeat(bucket[new], size[new]).view(np.int64), ids[at], np.repeat(size[new], size[new])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "id", "members"])

        held = []  # what the last key has so far
        for batch in batches:
            key, ids = (batch.column(k).to_numpy() for k in range(2))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if held and held[0][0][0] == key[-1]:
                held.append((key.copy(), ids.copy()))
                continue
            own = [*held, (key[:last], ids[:last])]
            held = [(key[last:].copy(), ids[last:].copy())]
            if sum(len(x[0]) for x in own):
                yield groups(*(np.concatenate(x) for x in zip(*own)))
        if held:
            yield groups(*(np.concatenate(x) for x in zip(*held)))

    return rows.mapInArrow(lean(run), "bucket long, id long, members long").distinct()


def _sliced(rows: DataFrame, size: str, most: int) -> DataFrame:
    """Rows of buckets of a size; of one larger than most every two slices meet in a bucket of their own."""
    slices = F.when(F.col(size) > most, F.ceil(F.col(size) / (most / 2))).otherwise(1).cast("long")
    out = rows.withColumn("__slices", slices).withColumn("__i", F.pmod(F.xxhash64("id"), F.col("__slices")))
    out = out.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slices") - 1)))
    bucket = F.when(F.col("__slices") > 1, F.xxhash64("bucket", F.least("__i", "__j"), F.greatest("__i", "__j"))).otherwise(F.col("bucket"))
    return out.withColumn("bucket", bucket).drop(size, "__slices", "__i", "__j")


def may_link(maps: list[bytes], size: np.ndarray, label: np.ndarray, shared: int = SHARED) -> np.ndarray:
    """label with all texts under one label that may be linked by their sizes and bitmaps; no link is missed.

    Two sets that share the per cent differ in at most 100 - shared of 100 + shared parts of the
    sum of their sizes. Bitmaps of linked sets have the same length or one has twice the other's.
    """
    length = np.array([len(m) for m in maps])
    for n in np.unique(length).tolist():
        at = np.flatnonzero((length == n) | (length == 2 * n))
        bits = np.empty((len(at), n), np.uint8)
        for row, k in enumerate(at.tolist()):
            own = np.frombuffer(maps[k], np.uint8)
            bits[row] = own if len(own) == n else own[:n] ^ own[n:]
        bits, own_size = bits.view(np.uint64), size[at]
        for row in np.flatnonzero(length[at] == n).tolist():
            other = label[at] != label[at[row]]
            other &= 100 * np.minimum(own_size, own_size[row]) >= shared * np.maximum(own_size, own_size[row])
            other = np.flatnonzero(other)
            if not len(other):
                continue
            differ = np.bitwise_count(bits[other] ^ bits[row]).sum(axis=1, dtype=np.int64)
            for k in other[(100 + shared) * differ <= (100 - shared) * (own_size[other] + own_size[row])].tolist():
                if label[at[k]] != label[at[row]]:
                    label[label == label[at[k]]] = label[at[row]]
    return label


def _tied(batches):
    """Map task over rows (bucket, id, fp, n, bitmap) sorted by bucket: pairs that tie all texts of a bucket that may be linked."""
    at, held = None, []
    pivots = _pivots()

    def end():
        ids, fps, size, maps = zip(*held)
        fps, size = np.array(fps, np.int64).view(np.uint64), np.array(size)
        label = np.arange(len(ids))
        for a, b in bucket_links(fps, distance_table(fps, pivots), TIED):
            label[label == label[a]] = label[b]
        label = may_link(maps, size, label)
        first = {}
        pairs = [(ids[first[x]], ids[k]) for k, x in enumerate(label.tolist()) if first.setdefault(x, k) != k]
        cols = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(cols, names=["src", "dst"])

    for batch in batches:
        for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if at != bucket:
                if len(held) > 1:
                    yield end()
                at, held = bucket, []
            held.append(row)
    if len(held) > 1:
        yield end()


def clusters(marks: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(id, bucket): texts of marks that may be linked to another one; linked texts have the same bucket."""
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = materialize(key_groups(marks.select(F.explode("keys").alias("key"), "id")), "groups")
    rows = _sliced(groups, "members", crowd).join(marks.select("id", "fp", "n", "bitmap"), "id")
    rows = rows.select("bucket", "id", "fp", "n", "bitmap").repartition(parts, "bucket").sortWithinPartitions("bucket", "id")
    ties = materialize(rows.mapInArrow(lean(_tied), "src long, dst long").distinct(), "ties")
    discard(groups)
    out = materialize(star_components(ties).withColumnRenamed("component", "bucket"), "clusters")
    discard(ties)
    return out


def set_links(sets: list[np.ndarray], shared: int = SHARED) -> list[tuple[int, int]]:
    """A spanning forest of the links among some texts, as index pairs; a link's sets share `shared` per cent or more."""
    size, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        near = label[rest] != label[i]
        near &= 100 * np.minimum(size[rest], size[i]) >= shared * np.maximum(np.maximum(size[rest], size[i]), 1)
        every = np.flatnonzero(near) + i + 1
        for part in range(0, len(every), 256):
            j = every[part : part + 256]
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            others = np.concatenate([sets[k] for k in j])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], others), size[i] - 1)] == others
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[j]) - size[j])
            for k in j[100 * common >= shared * (size[i] + size[j] - common)].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    out.append((i, k))
    return out


def exact_links(members: DataFrame, rows: DataFrame, width: int, weight: int = WEIGHT) -> DataFrame:
    """(src, dst): links between members (bucket, id, n) of a bucket, decided by the shingle sets of their texts in rows (id, text)."""
    sums = members.groupBy("bucket").agg(F.sum(F.col("n") + ROW).alias("weight"))
    placed = materialize(_sliced(members.join(sums, "bucket").drop("n"), "weight", weight), "placed")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("id", "text").join(_sent(placed), "id")
    texts = texts.select("bucket", "id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "id")

    def run(batches):
        at, ids, sets = None, [], []

        def end():
            pairs = set_links(sets)
            cols = [pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(cols, names=["src", "dst"])

        for batch in batches:
            buckets, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, part in chunks(batch.column(2).to_pylist()):
                h, counts = shingle_sets(part, width)
                for k, x in enumerate(np.split(h, np.cumsum(counts)[:-1]), begin):
                    if at != buckets[k]:
                        if len(ids) > 1:
                            yield end()
                        at, ids, sets = buckets[k], [], []
                    ids.append(own[k])
                    sets.append(x.copy())
        if len(ids) > 1:
            yield end()

    out = materialize(texts.mapInArrow(lean(run), "src long, dst long").distinct(), "links")
    discard(placed)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): the smallest document id reachable over links, itself included."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(with_fingerprint(rows, "text", width, drop=("text",)), "fingerprints")
    return _components(marked, limit)


def _components(marked: DataFrame, limit: int) -> DataFrame:
    """marked with component_id."""
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    own = materialize(with_pivots(own), "fingerprints")
    stars = star_components(links(own, limit))
    named = own.join(stars.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "components")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marked.join(materialize(by_fp, "components"), "fp", "left")


def similar(docs: DataFrame, text: str = "text", row: str = "__row", width: int = 5, crowd: int = CROWD, weight: int = WEIGHT) -> DataFrame:
    """(row, group): rows of docs in groups of near-duplicates, texts that share 80 % or more of their distinct five-word shingles.

    group is the least row of a group; groups are closed over chains of links. No link is missed.
    """
    rows = docs.select(F.col(row).alias("id"), F.col(text).cast("string").alias("text"))
    marks = materialize(with_marks(rows, width, *frequent_shingles(rows, width)), "marks")
    equal = ["n", "fp", "whole", "more"]
    least = marks.groupBy(*equal).agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = materialize(marks.select("id", *equal).join(least, equal).where("id <> first").select("id", "first"), "copies")
    texts = marks.join(_sent(copies.select("id")), "id", "left_anti")
    members = materialize(clusters(texts, crowd).join(marks.select("id", "n"), "id"), "members")
    links = exact_links(members, rows, width, weight)
    stars = materialize(star_components(links), "similar")
    named = marks.select("id").join(copies, "id", "left").select("id", F.coalesce("first", "id").alias("first"))
    named = named.join(stars.withColumnRenamed("id", "first"), "first", "left")
    out = materialize(named.select(F.col("id").alias(row), F.coalesce("component", "first").alias("group")), "similar")
    for table in (marks, copies, members, links, stars):
        discard(table)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """docs without near-duplicates (see similar): of each group the row of the smallest id stays, with all its columns.

    Null ids come last. Among repeated rows of that id the one with the smallest row number stays.
    """
    full = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "simhash_docs")
    groups = similar(full, text, "__row", width)
    ids = full.select("__row", F.col(doc_id).alias("__id"))
    order = F.struct(F.col("__id").isNull(), "__id", "__row")
    least = groups.join(ids, "__row").groupBy("group").agg(F.min(order)["__row"].alias("__keep"), F.count("*").alias("n")).where("n > 1")
    gone = materialize(groups.join(least, "group").where("__row <> __keep").select("__row"), "gone")
    discard(groups)
    return full.join(_sent(gone), "__row", "left_anti").drop("__row")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
