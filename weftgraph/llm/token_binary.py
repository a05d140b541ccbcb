"""Token-ID output: documents as zstandard frames with one shared dictionary, an index by offset.

A shard is a self-contained byte string:

    magic "WTOK1", width (1 byte: 2 or 4 bytes an id), sha256 of the dictionary (32 bytes),
    documents (u32), then a document each: id present (u8), id (i64), frame offset (u64),
    frame length (u32), ids (u64); then the frames, little endian throughout.

Each document is a frame of its own, so one short document is read by its index entry alone. Ids
are stored in ascending document order over (part, shard). Shards are rows of a Parquet table in
the shared folder and the dictionary is a second table: Spark's commit protocol makes the output
whole although executors are lost, on any store Spark can write.

Texts are tokenised where they are read; only compressed frames are shuffled, to parts cut at
quantiles of the document id. A heavily repeated id spans several parts by a hash of its ids.

A null text is empty (just the end id). A null document id sorts first. Repeated ids are all kept,
ordered by a hash of their tokens. An empty table gives no shard. Extra columns are ignored. The
dictionary is trained on about ``samples`` documents (lowest hashes of the id), part of the format.
A text of any length is one frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import lean

MAGIC = b"WTOK1"
_HEAD, _ENTRY = struct.Struct("<5sB32sI"), struct.Struct("<BqQIQ")
#: A piece may begin with these after a blank or newline: no tokenizer's pattern takes them for white space.
_SAFE = re.compile(r"[!-~\w]")
#: Pieces that can be encoded many at a time, and pieces with a tail of signs after a letter or digit.
_EASY = "^\n?[!-~\u00c0-\u024f]+$"
_SIGNS = ".,;:!?|*#&%$@()"
_TAILED = f"^(?P<bare>(?s:.*)[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?P<tail>[{_SIGNS}]+)$"
_NEW = object()
_KEPT = 450_000
#: Ids of a training sample of the dictionary.
PIECE = 4096
#: Fixed value of the format: how a trained dictionary begins.
_TRAINED = (0xEC30A437).to_bytes(4, "little")


def _is_byte_level(tokenizer) -> bool:
    """Whether the file is a plain byte-level BPE, for which texts may be cut into units."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and spec["post_processor"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") for t in spec["added_tokens"])


class Pieces(dict):
    """Ids (little-endian uint32 bytes) of pieces: a newline and what follows it, or what follows a blank. None: not separable."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}
        self.newline = self.whole("\n")
        if hasattr(tokenizer.model, "_resize_cache"):
            tokenizer.model._resize_cache(0)  # what it would hold is held here

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes easy pieces line by line: each newline is one id, which shows where a piece begins."""
        mark = int.from_bytes(self.newline, "little")
        lines = [p if p[0] == "\n" else f"\n {p}" for p in pieces]
        texts = ["".join(lines[i : i + 200]) for i in range(0, len(lines), 200)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        cuts = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
        if len(self.newline) != 4 or len(cuts) != len(pieces) + 1:
            raise ValueError("the tokenizer does not keep newlines apart")
        data = ids.tobytes()
        for p, a, b in zip(pieces, cuts, cuts[1:]):
            self[p] = data[4 * a : 4 * b] if p[0] == "\n" else data[4 * a + 4 : 4 * b]

    def ids(self, pieces: pa.Array) -> list[bytes | None]:
        old, texts = self.old, pieces.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.get, texts, repeat(_NEW)))
        new = [k for k, v in enumerate(out) if v is _NEW]
        if old:
            for k in new:
                if (v := old.get(texts[k], _NEW)) is not _NEW:
                    self[texts[k]] = out[k] = v
            new = [k for k in new if out[k] is _NEW]
        if new:
            easy = pc.match_substring_regex(pieces.take(pa.array(new)), _EASY).to_numpy(zero_copy_only=False).tolist()
            missing = []
            for k, plain in zip(new, easy):
                p = texts[k]
                if plain and "<|" not in p:
                    missing.append(p)
                    continue
                rest = p[1:] if p[:1] == "\n" else p
                if not _SAFE.match(rest):
                    self[p] = None
                elif rest is p:
                    self[p] = self.whole(" " + p)
                else:
                    self[p] = self.newline + self.whole(rest)
            if missing:
                self.learn(missing)
            for k in new:
                out[k] = self[texts[k]]
        if len(self) > _KEPT:  # two generations: what was not asked for during one is forgotten
            self.old = dict(self)
            self.clear()
        return out


class Encoder:
    """tokenizer.encode(text).ids as bytes; a plain byte-level tokenizer's texts are cut where its pattern must cut.

    A blank before a character that is no white space starts a pre-token, and a newline before
    one is a pre-token; pieces between such places do not depend on each other. So a batch is
    split, its distinct pieces are encoded once, and the ids are gathered by piece number.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.plain, self.pieces = tokenizer, _is_byte_level(tokenizer), Pieces(tokenizer)

    def encode(self, text: str) -> bytes:
        return next(self.encode_many(pa.array([text])))

    def encode_many(self, texts: pa.Array, most: int = 5_000_000) -> Iterator[bytes]:
        """Ids of each text (null: empty), computed in slices of about `most` bytes."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.plain:
            yield from (self.pieces.whole(t) for t in texts.to_pylist())
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield from self._slice(texts.slice(begin, end - begin))
            begin = end

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        one, none = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        lines = pc.replace_substring(pc.binary_join_element_wise(one, texts, none), "\n", " \n")
        split = pc.split_pattern(lines, " ")
        coded = split.values.dictionary_encode()
        codes, known = coded.indices.to_numpy(), coded.dictionary
        signed = np.flatnonzero(pc.not_equal(pc.ascii_rtrim(known, _SIGNS), known).to_numpy(zero_copy_only=False))
        cut = pc.extract_regex(known.take(pa.array(signed)), _TAILED)  # null: no tail
        place = np.full(len(known), -1)
        place[signed] = np.arange(len(signed))
        place = pa.array(place, mask=place < 0)
        bare = pc.coalesce(pc.struct_field(cut, "bare").take(place), known).dictionary_encode()
        tail = pc.fill_null(pc.struct_field(cut, "tail").take(place), "").dictionary_encode()
        heads = self.pieces.ids(bare.dictionary)
        tails = [self.pieces.whole(t) for t in tail.dictionary.to_pylist()]
        bad = np.fromiter((h is None for h in heads), bool, len(heads))[bare.indices.to_numpy()]
        ids = [*(h or b"" for h in heads), *tails]
        length = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(length) - length).astype(np.int32)
        both = np.empty(2 * len(codes), np.int32)  # each piece: the ids of its bare part, then of its tail
        both[::2], both[1::2] = bare.indices.to_numpy()[codes], tail.indices.to_numpy()[codes] + len(heads)
        n = length[both]
        upto = np.cumsum(n, dtype=np.int32)  # a slice has far fewer than 2**31 ids
        gathered = flat[np.repeat(start[both] - upto + n, n) + np.arange(upto[-1], dtype=np.int32)]
        total = np.r_[0, upto[1::2]]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        wrong = np.r_[0, np.cumsum(bad[codes])]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        # The first piece of each text is the empty one before its first newline: it is known as wrong.
        whole = special | (wrong[offsets[1:]] - wrong[offsets[:-1]] > 1)
        del codes, known, signed, cut, place, bare, tail, heads, tails, both, n, flat, start, split, coded, lines
        for k, (a, b, alone) in enumerate(zip(total[offsets[:-1]].tolist(), total[offsets[1:]].tolist(), whole.tolist())):
            if alone:
                text = texts[k].as_py()
                yield self.pieces.whole(text) if text else b""
            else:
                yield gathered[a + len(self.pieces.newline) // 4 : b].tobytes()


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(path))


@lru_cache(4)
def _zstd(dictionary: bytes, level: int):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=level, write_content_size=True), zstandard.ZstdDecompressor()
    own = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True), zstandard.ZstdDecompressor(dict_data=own)


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def train_dictionary(
    docs: DataFrame,
    tokenizer: str,
    width: int,
    rows: int,
    samples: int = 400,
    size: int = 32_768,
    doc_id: str = "doc_id",
    text: str = "text",
) -> bytes:
    """A zstandard dictionary from the serialised ids of about `samples` of the table's rows (lowest hashes of the id).

    Texts of any length take part, long ones as several samples of ``PIECE`` ids. Where the ids are
    too few or too alike for the trainer, their last `size` bytes are the dictionary as they stand,
    which the format's readers take alike; it is empty only if the sample has no text.
    """
    import zstandard

    share = min(1.0, samples / max(1, rows))
    most = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    picked = docs.select(doc_id, text).where((F.xxhash64(doc_id) <= most) & (F.length(text) > 0)).limit(4 * samples)
    encoder, step = _encoder(tokenizer), PIECE * width
    texts = sorted((r[0] is None, r[0] or 0, r[1]) for r in picked.collect())
    whole = [_narrow(encoder.encode(t), width) for _, _, t in texts]
    data = [ids[i : i + step] for ids in whole for i in range(0, len(ids), step)]
    try:
        return zstandard.train_dictionary(size, data).as_bytes()
    except (zstandard.ZstdError, ValueError):
        plain = b"".join(data)[-size:]
        return plain if plain[:4] != _TRAINED else plain[4:]


def _frames(tokenizer: str, dictionary: bytes, width: int, end: int, level: int):
    last = struct.pack("<I", end)

    def run(batches):
        encoder, (pack, _) = _encoder(tokenizer), _zstd(dictionary, level)
        for batch in batches:
            n, crc, frames = [], [], []
            for ids in encoder.encode_many(batch.column(1)):
                ids += last
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                frames.append(pack.compress(_narrow(ids, width)))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "crc", "frame"])
        encoder.pieces.old = {}  # what an idle worker keeps is the newest generation

    return lean(run)


def shard_bytes_of(held: list[tuple[int | None, int, bytes]], width: int, digest: bytes) -> bytes:
    """A shard of (doc_id, ids, frame)."""
    at, index = 0, [_HEAD.pack(MAGIC, width, digest, len(held))]
    for doc, n, frame in held:
        index.append(_ENTRY.pack(doc is not None, doc or 0, at, len(frame), n))
        at += len(frame)
    return b"".join([*index, *(f for _, _, f in held)])


def _shards(dictionary: bytes, width: int, most: int):
    """Packs a part's sorted frames into shards of about `most` bytes; each knows how many ids of its part come before."""
    digest = hashlib.sha256(dictionary).digest()

    def pack(part, shard, before, held):
        values = (part, shard, before, len(held), sum(n for _, n, _ in held), shard_bytes_of(held, width, digest))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "shard", "before", "n_docs", "n_ids", "data"])

    def run(batches):
        part, shard, before, size, held = None, 0, 0, 0, []
        for batch in batches:
            for p, doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame"))):
                if held and (p != part or size >= most):
                    yield pack(part, shard, before, held)
                    shard, before, size, held = shard + 1, before + sum(n for _, n, _ in held), 0, []
                if p != part:
                    part, shard, before = p, 0, 0
                held.append((doc, n, frame))
                size += len(frame)
        if held:
            yield pack(part, shard, before, held)

    return lean(run)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, parts: int | None = None, shard_bytes: int = 4 << 20, level: int = 1, samples: int = 400, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every text, each with end_id appended, below path (tables `shards` and `dictionary`)."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    width = 2 if max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size() - 1) < 1 << 16 else 4
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    cuts, n = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts), F.count("*")).first()
    cuts = sorted(cuts or [])[: parts - 1]
    dictionary = train_dictionary(rows, tokenizer, width, n, samples)
    frames = rows.mapInArrow(_frames(tokenizer, dictionary, width, end_id, level), "doc_id long, n long, crc long, frame binary")
    # Parts below and up to an id: equal cuts belong to a repeated id, which is spread over its parts by the crc.
    low, high = _searched(cuts)
    low, high = F.when(F.col("doc_id").isNull(), 0).otherwise(low), F.when(F.col("doc_id").isNull(), 0).otherwise(high)
    span = F.when(high - low > 1, F.pmod(F.col("crc"), high - low + 1)).otherwise(0)
    placed = frames.withColumn("part", F.least(low + span, F.lit(parts - 1)).cast("int"))
    dealt = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "crc", "n")
    dealt.select("part", "doc_id", "n", "frame").mapInArrow(_shards(dictionary, width, shard_bytes), "part int, shard int, before long, n_docs long, n_ids long, data binary").write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), width, end_id)], "data binary, sha256 string, width int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")


def _searched(cuts: list[int]):
    """Columns: cuts below the id and cuts up to the id, by a search tree of comparisons (log depth)."""
    doc = F.col("doc_id")

    def tree(lo: int, hi: int, right: bool):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        left = doc < cuts[mid] if right else doc <= cuts[mid]
        return F.when(left, tree(lo, mid, right)).otherwise(tree(mid + 1, hi, right))

    return tree(0, len(cuts), False), tree(0, len(cuts), True)


def parse_index(data: bytes) -> tuple[int, bytes, int, list[tuple]]:
    """width, dictionary digest, start of the frames, and (doc_id, offset, length, ids) of each document."""
    magic, width, digest, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    entries = [(d if has else None, at, size, ids) for has, d, at, size, ids in (_ENTRY.unpack_from(data, _HEAD.size + i * _ENTRY.size) for i in range(n))]
    return width, digest, _HEAD.size + n * _ENTRY.size, entries


def read_document(data: bytes, dictionary: bytes, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard; touches its index entry and frame only."""
    magic, width, digest, n = _HEAD.unpack_from(data)
    if magic != MAGIC or not 0 <= k < n or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("wrong shard, document or dictionary")
    _, _, at, size, _ = _ENTRY.unpack_from(data, _HEAD.size + k * _ENTRY.size)
    begin = _HEAD.size + n * _ENTRY.size + at
    return np.frombuffer(_wide(_zstd(dictionary, 3)[1].decompress(data[begin : begin + size]), width), "<u4")


def _documents(dictionary: bytes, offsets: dict[int, int], with_ids: bool):
    digest = hashlib.sha256(dictionary).digest()

    def run(batches):
        unpack = _zstd(dictionary, 3)[1]
        for batch in batches:
            for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data"))):
                width, own, begin, entries = parse_index(data)
                if own != digest:
                    raise ValueError("shard and dictionary do not belong together")
                start, out = offsets[part] + before, []
                for doc, at, size, n in entries:
                    ids = _wide(unpack.decompress(data[begin + at : begin + at + size]), width)
                    if len(ids) != 4 * n:
                        raise ValueError("a frame's length differs from its index entry")
                    out.append((doc, start, n, zlib.crc32(ids), np.frombuffer(ids, "<u4").tolist() if with_ids else None))
                    start += n
                cols = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
                if with_ids:
                    arrays.append(pa.array(cols[4], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return lean(run)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every stored document; start counts the ids before it."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])
    shards = spark.read.schema("part int, shard int, before long, n_docs long, n_ids long, data binary").parquet(f"{path}/shards")
    totals, offsets, at = {r[0]: r[1] for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()}, {}, 0  # a row a part
    for part in sorted(totals):
        offsets[part] = at
        at += totals[part]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.select("part", "before", "data").mapInArrow(_documents(dictionary, offsets, with_ids), schema)
