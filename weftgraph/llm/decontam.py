"""Benchmark decontamination with one Aho-Corasick automaton.

Normalisation lower-cases A-Z and keeps as words the runs of ASCII letters, digits and non-ASCII
characters. The patterns are the windows of 8 consecutive words of every benchmark item (a
shorter item is one window), joined by and enclosed in blanks, so that matches end at words. Each
text is normalised and scanned once; a match maps to word numbers and to code points of the
original text.

What reaches the driver and the workers is a list of (window, item) pairs. Its size, windows and
item ids together, is counted first: a benchmark of more than ``BLOCK`` characters is cut into
several lists by a hash of the pairs, so that not even the items of one frequent window need to
fit at once. The texts are then scanned once a list; such a scan leaves only the hits (row
number, places, item), never the texts again, and a join brings them to their documents.

A null text, here or in an item, has no words; an item without words has no window and is never
hit. Texts of any length are scanned whole. Repeated items count once. Items are compared by their
id as text; items with a null id are ignored. An empty table gives no rows, an empty benchmark no
hits. Repeated rows have equal hits. Extra columns are kept, those named as the results replaced;
names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import lean, materialize

WINDOW = 8
BLOCK = 8_000_000
_NORMAL = bytes((b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32) if b < 128 else b for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: The same words in the original text, as Spark's regular expressions write them.
_WORD_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalise(text: str) -> list[bytes]:
    """Words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(text: str | None, width: int = WINDOW) -> list[str]:
    """Distinct windows of an item as patterns."""
    words = normalise(text or "")
    if not words:
        return []
    parts = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    return sorted({" " + b" ".join(p).decode("latin-1") + " " for p in parts})


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(pattern, item): each distinct window of each item, the item by its id as text."""

    def run(batches):
        for batch in batches:
            both = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows = [(p, i) for i, t in both for p in item_windows(t, width)]
            cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["pattern", "item"])

    items = benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(item_id).isNotNull())
    return items.mapInArrow(lean(run), "pattern string, item string").distinct()


_BUILT: dict = {}


def _automaton(key: str, pairs: list[tuple[str, str]]):
    """The automaton of sorted (pattern, item) pairs; a match gives its width in words and its pairs as a range."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found, begin = ahocorasick.Automaton(), 0
        for end in range(1, len(pairs) + 1):
            if end == len(pairs) or pairs[end][0] != pairs[begin][0]:
                pattern = pairs[begin][0]
                found.add_word(pattern, (pattern.count(" ") - 1, begin, end))
                begin = end
        if pairs:
            found.make_automaton()
        _BUILT[key] = (found, pa.array([i for _, i in pairs], pa.string()))
    return _BUILT[key]


_PLACE = (("first", pa.int64()), ("last", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("item", pa.string()))
HIT = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "item" else T.LongType()) for n, _ in _PLACE]))


def _places(text: str, words: list[bytes], automaton) -> list[tuple[np.ndarray, ...]]:
    """Of all matches: first and last word, begin and end in code points, and pair numbers, as arrays."""
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    at = np.array([m.span() for m in _WORD.finditer(text.translate(_LOWER))], np.int64)
    ends = np.array([e for e, _ in found], np.int64)
    width, low, high = np.array([v for _, v in found], np.int64).T
    last = np.searchsorted(blanks, ends) - 1
    first, n = last - width + 1, high - low
    pairs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return [np.repeat(x, n) for x in (first, last, at[first, 0], at[last, 1])] + [pairs]


def _scan(shared, key: str, at: int, names: list[str], only_hits: bool):
    """Map task: rows with n_words and hits; or, with only_hits, hits alone with their __row, and n_words as item null."""

    def run(batches):
        automaton, items = _automaton(key, shared.value)
        for batch in batches:
            n, counts, parts = [], [], []
            for text in batch.column(at).to_pylist():
                words = normalise(text or "")
                n.append(len(words))
                own = _places(text, words, automaton) if words and len(items) else []
                counts.append(len(own[0]) if own else 0)
                if own:
                    parts.append(own)
            flat = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5)]
            cols = [*(pa.array(x) for x in flat[:4]), items.take(pa.array(flat[4]))]
            if only_hits:
                row = batch.column(batch.schema.get_field_index("__row")).to_numpy()
                cols = [pa.array(np.repeat(row, counts)), *cols]
                yield pa.RecordBatch.from_arrays(cols, names=["__row", *(n for n, _ in _PLACE)])
                continue
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cols, [n for n, _ in _PLACE]))
            more = [pa.array(n, pa.int64()), hits]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, "n_words", "hits"])

    return lean(run)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    block: int = BLOCK,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """docs (without drop) with n_words and hits.

    hits has every occurrence of a window for every item that has it: first and last word number,
    begin and end (exclusive) in code points of the original text, and the item.
    """
    kept = docs.drop("n_words", "hits")
    found = materialize(windows(benchmark, item_id, item_text, width), "windows")
    size = found.agg(F.sum(F.length("pattern") + F.length("item") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block))
    names = [c for c in kept.columns if c not in drop]
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField("n_words", T.LongType()), T.StructField("hits", HIT)])

    def mapped(rows: DataFrame, k: int, out, columns: list[str], only_hits: bool) -> DataFrame:
        own = found.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == k) if blocks > 1 else found
        pairs = sorted(zip(*(c.to_pylist() for c in own.select("pattern", "item").toArrow().columns)))
        key = hashlib.sha256(repr(pairs).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(pairs)
        return rows.mapInArrow(_scan(shared, key, rows.columns.index(text), columns, only_hits), out)

    if blocks == 1:
        return mapped(kept, 0, schema, names, False)
    base = materialize(kept.withColumn("__row", F.monotonically_increasing_id()), "scan")
    places = ["first", "last", "begin", "end"]
    hit_schema = ", ".join(["__row long", *(f"{c} long" for c in places), "item string"])
    rows = base.select("__row", text)
    every = mapped(rows, 0, hit_schema, [], True)
    for k in range(1, blocks):
        every = every.unionByName(mapped(rows, k, hit_schema, [], True))
    own = every.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(*places, "item"))).alias("hits"))  # of one text
    counted = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD_SQL)), F.lit(0)).cast("long")
    marked = base.withColumn("n_words", counted).join(own, "__row", "left")
    return marked.withColumn("hits", F.coalesce("hits", F.array().cast(HIT))).select(*names, "n_words", "hits")


def digest(scanned: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """scanned (without hits and drop) with n_hit, n_items, items_sha256, contaminated and spans.

    spans: begin:end of the stretches of the original text that hits cover, comma-joined.
    """
    added = ("n_hit", "n_items", "items_sha256", "contaminated", "spans")
    kinds = (T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.StringType())
    names = [c for c in scanned.columns if c not in ("hits", *added, *drop)]
    schema = T.StructType([*(scanned.schema[c] for c in names), *(T.StructField(n, k) for n, k in zip(added, kinds))])

    def run(batches):
        none = (0, 0, hashlib.sha256(b"").hexdigest(), False, "")
        for batch in batches:
            out, hits = [], batch.column("hits")
            ends = hits.offsets.to_numpy()
            values = hits.values
            cols = [values.field(c).to_numpy() for c in ("first", "last", "begin", "end")]
            item = values.field("item")
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if low == high:
                    out.append(none)
                    continue
                items = sorted(set(item.slice(low, high - low).to_pylist()))
                first, last, begin, end = (c[low:high] for c in cols)
                parts = merged(first, last)
                words = sum(int(last[j] - first[i] + 1) for i, j in parts)
                spans = ",".join(f"{begin[i]}:{end[j]}" for i, j in parts)
                out.append((words, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= 2, spans))
            more = list(zip(*out)) or [[]] * 5
            arrow = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            own = [pa.array(c, k) for c, k in zip(more, arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], names=schema.fieldNames())

    return scanned.mapInArrow(lean(run), schema)


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint word ranges that hits cover, adjacent ones joined: each as the hit it begins with and the hit it ends with."""
    order = np.lexsort((last, first))
    reach = np.maximum.accumulate(last[order])
    starts = np.flatnonzero(np.r_[True, first[order][1:] > reach[:-1] + 1])
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        own = order[a:b]
        out.append((int(own[0]), int(own[last[own].argmax()])))
    return out
