"""Language ID: interpolated Kneser-Ney character models, one per language.

Map tasks count the character 4-grams of all training texts in sorted runs, one shuffle sums them,
and Spark derives all that the models are made of: continuation counts of the lower orders, the
discounts, the probabilities and back-off weights of every n-gram seen. No n-gram is left out, so
the model grows with the corpus.

The model is cut into blocks: languages in groups of ``GROUP``, and within a group the n-grams by
a hash of the two characters before the last one, on which every order above the second depends in
full. As many blocks are made as keep each under ``BLOCK`` entries; orders 1 and 2 are part of
each. The driver holds one block at a time; it makes sorted hash arrays with a column per language
of it and broadcasts them. Workers read the texts once and go through the blocks for every stretch
of texts, one block in memory at a time.

A text gets the language of the lowest cross-entropy per character; ties go to the language first
by code point. It is rejected where that exceeds a limit calibrated for the language and length
class: one training text in ``LEFT_OUT``, by a hash of its content, is kept out of the counts, and
the limit is at or beyond the entropy that a share of ``1 - FALSE`` of these texts stay within.

Nulls and empties: a null text or one without a letter gives ``und``, score 0 and rejected; a null
language is never learned from; without any training text everything is ``und``. A language with
no training text but left-out ones is learned from these. An empty table gives no rows. Texts of
any length are read whole. Repeated rows are predicted alike. Extra columns are kept; those named
as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import chunks, discard, lean, materialize

ORDER = 4
BITS = 16
CLASSES = 1 << BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = 1_000_003
#: Upper ends of the length classes (letters) in which rejection is calibrated.
LENGTHS = (20, 60, 200, 1000)
#: Languages and entries of a block of the model.
GROUP, BLOCK = 32, 4_000_000
#: One training text in so many calibrates; the share of such texts that may be beyond the limit.
LEFT_OUT, FALSE = 10, 0.001


@lru_cache(1)
def _classes() -> np.ndarray:
    """Character class by code point: 0 for all but letters; letters lower-cased.

    Letters beyond the basic plane are hashed into the code points of surrogates and of private
    use, where no letter is; so no two letters of the basic plane share a class.
    """
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[point] = low if low < CLASSES else 0xD800 + low * 2654435761 % (0xF900 - 0xD800)
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of all texts, the index of each key's text, and letters per text.

    Runs of other characters count as one boundary (class 0); contexts never cross texts.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    cls = _classes()[raw]
    keep = cls != 0
    letters = keep.copy()
    keep[1:] |= letters[:-1]
    keep[0] = True
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens + 1)
    counts = np.bincount(doc[letters], minlength=len(texts))
    cls, doc = cls[keep].astype(np.uint64), doc[keep]
    keys = cls.copy()
    for k in range(1, ORDER):
        same = doc[k:] == doc[:-k]
        keys[k:] |= np.where(same, cls[:-k], np.uint64(0)) << np.uint64(BITS * k)
    return keys, doc, counts


def _count_rows(langs: list[str]):
    """Map task: (lang, key, n) of all its rows, merged in sorted runs of bounded size."""
    index = {x: i for i, x in enumerate(langs)}

    def flush(held: dict):
        for i, parts in held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            cols = [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "key", "n"])

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            texts, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, part in chunks(texts):
                keys, doc, _ = grams(part)
                tag = np.array([index.get(x, -1) for x in tags[begin : begin + len(part)]], np.int32)
                of = tag[doc]
                for i in np.unique(tag):
                    if i >= 0:
                        found = np.unique(keys[of == i], return_counts=True)
                        held.setdefault(int(i), []).append(found)
                        size += len(found[0])
                if size > 4_000_000:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return lean(run)


def _suffix(key: str, order: int) -> Column:
    """The last `order` characters of an n-gram."""
    return F.col(key).bitwiseAND(F.lit((1 << BITS * order) - 1))


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, ord, kind, key, value) from (lang, key, n) of 4-grams: kind 0 has p of each n-gram, kind 1 gamma of each context.

    Interpolated Kneser-Ney: raw counts at order 4, below it the number of different characters
    before an n-gram; one discount a language and order, n1 / (n1 + 2 n2), or 0.5 without n1.
    """
    top = counted.groupBy("lang", "key").agg(F.sum("n").cast("double").alias("c"))
    levels = {ORDER: materialize(top, "langid_counts")}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy("lang", _suffix("key", k).alias("key")).agg(F.count("*").cast("double").alias("c"))
        levels[k] = materialize(shorter, "langid_counts")
    ones = None
    for k, level in levels.items():
        own = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        own = own.withColumn("ord", F.lit(k))
        ones = own if ones is None else ones.unionByName(own)
    d = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    discounts = materialize(ones.select("lang", "ord", d.alias("d")), "langid_discounts")  # 4 rows a language
    out, below = None, None
    for k in range(1, ORDER + 1):
        rows = levels[k].join(F.broadcast(discounts.where(F.col("ord") == k).drop("ord")), "lang")
        rows = rows.withColumn("ctx", F.shiftrightunsigned("key", BITS))
        totals = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.first("d") * F.count("*") / F.sum("c")).alias("gamma"))
        totals = materialize(totals, "langid_contexts")
        rows = rows.join(totals, ["lang", "ctx"])
        if below is None:
            base = F.lit(1.0 / CLASSES)
        else:
            lower = below.select("lang", F.col("key").alias("suffix"), F.col("value").alias("base"))
            rows = rows.withColumn("suffix", _suffix("key", k - 1)).join(lower, ["lang", "suffix"])
            base = F.col("base")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * base
        below = materialize(rows.select("lang", "key", p.alias("value")), "langid_p")
        own = below.select("lang", F.lit(k).alias("ord"), F.lit(0).alias("kind"), "key", "value")
        ctx = totals.select("lang", F.lit(k).alias("ord"), F.lit(1).alias("kind"), F.col("ctx").alias("key"), F.col("gamma").alias("value"))
        out = own.unionByName(ctx) if out is None else out.unionByName(own).unionByName(ctx)
    done = materialize(out, "langid_model")
    for table in (*levels.values(), discounts):
        discard(table)
    return done


def _middle_column() -> Column:
    """The two characters before an n-gram's last one (of a context: its last two); -1 for orders 1 and 2."""
    shift = F.when(F.col("kind") == 0, F.shiftrightunsigned("key", BITS)).otherwise(F.col("key"))
    return F.when(F.col("ord") >= 3, shift.bitwiseAND(F.lit((1 << 2 * BITS) - 1))).otherwise(F.lit(-1))


def _block_column(blocks: int) -> Column:
    middle = _middle_column()
    return F.when(middle < 0, F.lit(-1)).otherwise(F.pmod(F.shiftright(middle * _SPREAD, 12), F.lit(blocks))).cast("int")


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each 4-gram, as _block_column has it."""
    middle = (keys >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1)
    return (middle * np.uint64(_SPREAD) >> np.uint64(12)) % np.uint64(blocks)


@dataclass
class Block:
    """Sorted hash arrays by order (1..4): n-gram hashes with log2 probabilities and context hashes with log2 back-off weights, a column per language."""

    first: int  # number of its first language
    part: int  # of `parts` blocks of these languages
    parts: int
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    def score(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 p of each key's last character after its context, a column per language."""
        width = self.logp[0].shape[1]
        if order == 0:
            return np.full((len(keys), width), -float(BITS), np.float32)
        at, found = _find(self.keys[order - 1], keys)
        out = self.logp[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(keys), width), np.float32)
        if not found.all():
            rest = keys[~found]
            lower = self.score(rest & np.uint64((1 << BITS * (order - 1)) - 1), order - 1)
            at, known = _find(self.contexts[order - 1], rest >> np.uint64(BITS))
            lower[known] += self.backoff[order - 1][at[known]]
            out[~found] = lower
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    hashed = keys * _MIX
    at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
    return at, table[at] == hashed


def make_block(first: int, width: int, part: int, parts: int, rows: pa.Table) -> Block:
    """A block from its rows (lang, ord, kind, key, value); what a language has not seen is filled in by back-off."""
    lang, order, kind, value = (rows[c].to_numpy() for c in ("lang", "ord", "kind", "value"))
    key = rows["key"].to_numpy().view(np.uint64)
    keys, logp, contexts, backoff = [], [], [], []
    lower = None
    for k in range(1, ORDER + 1):
        own, ctx = (order == k) & (kind == 0), (order == k) & (kind == 1)
        every, at = np.unique(key[own], return_inverse=True)
        ctxs, ctx_at = np.unique(key[ctx], return_inverse=True)
        gammas = np.ones((len(ctxs), width))
        gammas[ctx_at, lang[ctx] - first] = value[ctx]
        if k == 1:
            base = np.full((len(every), width), 1 / CLASSES)
        else:
            down = np.searchsorted(lower[0], every & np.uint64((1 << BITS * (k - 1)) - 1))
            base = lower[1][down]
        probs = gammas[np.searchsorted(ctxs, every >> np.uint64(BITS))] * base
        probs[at, lang[own] - first] = value[own]
        lower = (every, probs)
        by, by_ctx = np.argsort(every * _MIX), np.argsort(ctxs * _MIX)
        keys.append((every * _MIX)[by])
        logp.append(np.log2(probs[by]).astype(np.float32))
        contexts.append((ctxs * _MIX)[by_ctx])
        backoff.append(np.log2(gammas[by_ctx]).astype(np.float32))
    return Block(first, part, parts, keys, logp, contexts, backoff)


@dataclass
class Model:
    """Languages in code-point order and, for each block, what loads it: a broadcast, or the block itself."""

    langs: list[str]
    blocks: list[Callable[[], Block]]


class _Shared:
    """A broadcast block. One block is kept unpacked in a worker; others are read anew from Spark's file of the broadcast."""

    held: tuple[int, Block] | None = None

    def __init__(self, broadcast, alone: bool):
        self.broadcast, self.alone = broadcast, alone

    def __call__(self) -> Block:
        if self.alone or not getattr(self.broadcast, "_path", None):
            return self.broadcast.value
        if _Shared.held is None or _Shared.held[0] != id(self.broadcast):
            _Shared.held = None
            _Shared.held = (id(self.broadcast), self.broadcast.load_from_path(self.broadcast._path))
        return _Shared.held[1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", group: int = GROUP, block: int = BLOCK) -> Model | None:
    """Fits the models on all rows whose text and language are not null; None without any."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())  # a row a language
    if not langs:
        return None
    table = probabilities(rows.mapInArrow(_count_rows(langs), "lang int, key long, n long"))
    sizes = table.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("ord") <= 2).alias("fixed")).collect()
    sizes = {r["lang"]: (r["n"], r["fixed"]) for r in sizes if r["n"]}
    if not sizes:
        return None
    names, number = [langs[i] for i in sorted(sizes)], {old: new for new, old in enumerate(sorted(sizes))}
    renumber = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    blocks = []
    for first in range(0, len(names), group):
        own = [i for i in sizes if first <= number[i] < first + group]
        parts = max(1, -(-sum(n - fixed for n, fixed in map(sizes.get, own)) // block))
        members = table.where(F.col("lang").isin(own)).withColumns({"part": _block_column(parts), "lang": renumber[F.col("lang")]})
        for part in range(parts):
            got = members.where(F.col("part").isin(-1, part)).drop("part").toArrow()
            made = make_block(first, min(group, len(names) - first), part, parts, got)
            alone = parts == 1 and len(names) <= group
            blocks.append(_Shared(spark.sparkContext.broadcast(made), alone))
    discard(table)
    return Model(names, blocks)


def score_texts(model: Model, texts: list[str | None], most: int = 8_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits per character for each text and language, and letters per text."""
    out, letters = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    places = np.zeros(len(texts))
    for stretch in _stretches(texts, most if len(model.blocks) > 1 else 1):
        held = []
        for begin, part in stretch:
            keys, doc, n = grams(part)
            letters[begin : begin + len(part)] = n
            places[begin : begin + len(part)] = np.bincount(doc, minlength=len(part))
            held.append((begin + doc.astype(np.int64), keys))
        for load in model.blocks:
            own = load()
            for doc, keys in held:
                if own.parts > 1:
                    here = np.flatnonzero(_block_of(keys, own.parts) == own.part)
                    doc, keys = doc[here], keys[here]
                if not len(keys):
                    continue
                bits = own.score(keys)
                starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                width = bits.shape[1]
                out[doc[starts], own.first : own.first + width] -= np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
    return out / np.maximum(places, 1)[:, None], letters


def _stretches(texts: list[str | None], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Chunks of texts, as many together as have about `most` characters."""
    held, size = [], 0
    for begin, part in chunks(texts):
        held.append((begin, part))
        size += sum(map(len, part))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _judge(entropy: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best column, score and its cross-entropy. Score: softmax of the negative entropies, sharper for longer texts."""
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(best)), best]
    sharp = np.log(2) * np.minimum(letters, 64)[:, None] / 4
    score = 1 / np.exp(-(entropy - low[:, None]) * sharp).sum(axis=1)
    return best, score, low


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, bits (cross-entropy, null for und) and n_letters added; columns of these names are replaced."""
    names = ["lang_pred", "score", "bits", "n_letters"]
    kept = docs.drop(*names)
    if model is None:
        nothing = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits": F.lit(None).cast("double"), "n_letters": F.lit(0).cast("long")}
        return kept.withColumns(nothing)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    at = kept.columns.index(text)

    def run(batches):
        for batch in batches:
            entropy, letters = score_texts(model, batch.column(at).to_pylist())
            best, score, low = _judge(entropy, letters)
            und = letters == 0
            tags = pa.array(["und" if u else model.langs[i] for i, u in zip(best, und)], pa.string())
            more = [tags, pa.array(np.where(und, 0.0, score)), pa.array(low, mask=und), pa.array(letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.fieldNames())

    return kept.mapInArrow(lean(run), schema)


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i in range(len(LENGTHS) - 1, -1, -1):
        out = F.when(n <= LENGTHS[i], F.lit(i)).otherwise(out)
    return out


def left_out(text: str = "text") -> Column:
    """Whether a training text calibrates; equal texts do alike."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(text)), F.lit(LEFT_OUT)) == 0, F.lit(False))


def reject_limits(scored: DataFrame, calibrating: Column, false: float = FALSE) -> DataFrame:
    """(lang_pred, k, limit): limit in bits a character by language and length class, five rows a language.

    A share `false` of the calibrating texts, which the models have not seen, is beyond the quantile
    q. The limit is half way from q to 8 bits, what text unlike anything seen costs at least, so
    that at most this share of texts like them is rejected; a class without calibrating texts
    rejects nothing.
    """
    rows = scored.where(calibrating & F.col("bits").isNotNull())
    q = F.percentile_approx("bits", 1 - false, 10000).alias("q")
    found = rows.groupBy("lang_pred", length_class(F.col("n_letters")).alias("k")).agg(q)
    return found.select("lang_pred", "k", (F.col("q") + F.greatest(F.lit(0.5), (8.0 - F.col("q")) / 2)).alias("limit"))


def with_rejection(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """scored with rejected; limits (five rows a language) is broadcast."""
    own = limits.select(F.col("lang_pred").alias("__lang"), F.col("k").alias("__k"), F.col("limit").alias("__limit"))
    on = (F.col("lang_pred") == F.col("__lang")) & (length_class(F.col("n_letters")) == F.col("__k"))
    beyond = F.col("bits").isNull() | F.coalesce(F.col("bits") > F.col("__limit"), F.lit(False))
    return scored.join(F.broadcast(own), on, "left").withColumn("rejected", beyond).drop("__lang", "__k", "__limit")


def identify(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) with lang_pred, score, bits, n_letters, rejected and training; learned from the rows where training holds.

    The scored rows are written once; calibration and result both read that table.
    """
    known = F.col("training") & F.col(text).isNotNull() & F.col(lang).isNotNull()
    marked = docs.withColumn("training", F.coalesce(training, F.lit(False))).withColumn("__left", known & left_out(text))
    tag = F.col(lang).cast("string")
    kinds = marked.where(known).groupBy(tag.alias("lang")).agg(F.count_if(~F.col("__left")).alias("n")).collect()
    lone = [r["lang"] for r in kinds if not r["n"]]  # learned from left-out texts, as there are no others
    if lone:
        marked = marked.withColumn("__left", F.col("__left") & ~F.coalesce(tag.isin(lone), F.lit(False)))
    model = train(marked.where(F.col("training") & ~F.col("__left")), text, lang)
    scored = materialize(predict(marked, model, text).drop(*drop), "langid")
    limits = materialize(reject_limits(scored, F.col("__left")), "langid_limits")
    return with_rejection(scored, limits).drop("__left")
