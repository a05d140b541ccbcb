"""PII by information-theoretic sanitisation.

Base spans (e-mail, IP address, card, phone) are protected entities. Which other terms give an
entity away is estimated from the corpus: a term t in a text with entity e discloses the share
PMI(t, e) / IC(e) of e's information, where PMI = log2(N n(t,e) / (n(t) n(e))),
IC(e) = log2(N / n(e)), N texts in all, and n counts texts. A term that reaches ``DISCLOSES``, and
meets the entity more often than chance would have it (``CHANCE``, a bound on the
hypergeometric tail of one pair), discloses it: each of its occurrences in the texts with the
entity is a span of its own (kind ``term``), generalised, or removed beyond ``REMOVES``. There is
no least number of texts: a word found nowhere else gives a single passage's entity away once the
corpus is large enough to call it rare. Copies of a text with entities count as one text. Pairs are
formed of a text's entities and those of its terms that are rare enough for the share (an exact
bound), and meet their occurrences in a join, never in a broadcast of unknown size.

A null text is empty. A table without entities has no terms, an empty table gives no rows. Repeated
rows get equal spans. Extra columns are kept, those named as the results replaced; names that begin
with two underscores are the operator's own. Every scan is linear in the text, whatever its length
and its runs of characters.
"""

from __future__ import annotations

import hashlib
import re
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import lean, materialize

DISCLOSES = 0.9
CHANCE = 0.001
REMOVES = 0.999
SLOTS = 1 << 22
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        free = at + 1
        if m:
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) in order; kind indexes KINDS."""
    out = [(b, 0, e) for b, e in emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL[k]}:{b}:{e}" for b, k, e in spans)


def _entity(kind: int, value: str) -> str:
    """An entity is the same whatever separates its digits or however its letters are cased."""
    value = value.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", value)
    return hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).hexdigest()


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """All words of the text outside the base spans."""
    out, k, reached = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reached = max(reached, spans[k][2])
            k += 1
        if m.start() >= reached:
            out.append({"term": m.group().lower(), "begin": m.start(), "end": m.end()})
    return out


SPAN = "struct<begin:int,kind:int,end:int>"
COUNTS = ("n_email", "n_ip", "n_card", "n_phone")
BASE = (
    ", ".join(f"{c} long" for c in COUNTS)
    + f", base_sha256 string, base array<{SPAN}>, __words array<struct<term:string,begin:int,end:int>>"
    + ", __entities array<string>, __copy string, __text string"
)
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_WORDS = pa.list_(pa.struct([("term", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))


def find_base(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) with the base spans of every whole text.

    Texts with entities also get these, their other words, a hash and themselves (__entities,
    __words, __copy, __text); for other texts these columns are empty or null.
    """
    added = T.StructType.fromDDL(BASE)
    kept = docs.drop(*added.fieldNames())
    at = kept.columns.index(text)
    names = [c for c in kept.columns if c not in drop]
    schema = T.StructType([*(kept.schema[c] for c in names), *added.fields])
    kinds = (*[pa.int64()] * 4, pa.string(), _SPANS, _WORDS, pa.list_(pa.string()), pa.string(), pa.string())

    def described(t: str | None) -> tuple:
        spans = base_spans(t) if t else []
        counts = (sum(x[1] == k for x in spans) for k in range(4))
        digest = hashlib.sha256(joined(spans).encode()).hexdigest()
        if not spans:
            return (*counts, digest, [], [], [], None, None)
        own = [{"begin": b, "kind": k, "end": e} for b, k, e in spans]
        entities = sorted({_entity(k, t[b:e]) for b, k, e in spans})
        copy = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        return (*counts, digest, own, words_outside(t, spans), entities, copy, t)

    def run(batches):
        for batch in batches:
            rows = [described(t) for t in batch.column(at).to_pylist()]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            more = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=schema.fieldNames())

    return kept.mapInArrow(lean(run), schema)


def _slot(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % SLOTS


def _bitmap(batches):
    """The slots of a task's terms: as many rows at most as there are slots."""
    slots = {_slot(t) for batch in batches for t in batch.column(0).to_pylist()}
    yield pa.RecordBatch.from_arrays([pa.array(sorted(slots), pa.int32())], names=["slot"])


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_t): texts of docs with each of the terms.

    What map tasks get to know the terms by is a bitmap of SLOTS bits, whatever their number; a
    term that only shares a slot falls out in the join at the end.
    """
    slots = terms.select("term").mapInArrow(lean(_bitmap), "slot int").distinct().toArrow()["slot"].to_numpy().astype(np.int64)
    bits = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(bits, slots // 8, np.uint8(1) << (slots % 8).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        bits, seen, known = shared.value, {}, {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in {x.lower() for x in set(_TERM.findall(t or ""))}:
                    on = known.get(w)
                    if on is None:
                        slot = _slot(w)
                        on = known[w] = bool(bits[slot >> 3] >> (slot & 7) & 1)
                    if on:
                        seen[w] = seen.get(w, 0) + 1
                if len(known) > 400_000:
                    known.clear()
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    counted = docs.select(text).mapInArrow(lean(run), "term string, n long")
    return counted.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def by_chance(n: int, n_e: int, n_t: int, n_et: int) -> float:
    """Log of a bound on the chance of n_et texts or more with both: the expected number of sets of n_et such texts."""
    return _log_choose(n_e, n_et) + _log_choose(n_t, n_et) - _log_choose(n, n_et)


def disclosing(docs: DataFrame, found: DataFrame, text: str = "text", least: float = DISCLOSES, chance: float = CHANCE) -> DataFrame | None:
    """(__row, term, share): the terms of each text that give one of its entities away; None without entities.

    found: find_base() with a row number __row. Of the copies of a text with entities one is
    counted, in N and n(t) as well.
    """
    known = found.where("__copy is not null")
    copies = materialize(known.groupBy("__copy").agg(F.min("__row").alias("__row"), F.count("*").alias("copies")), "pii_copies")
    more = copies.agg(F.sum(F.col("copies") - 1)).first()[0]
    if more is None:
        return None
    n = docs.count() - more
    first = copies.select("__row", "copies")
    entities = known.select("__row", F.explode("__entities").alias("entity"))
    n_e = entities.join(first, "__row", "left_semi").groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = materialize(known.select("__row", F.explode(F.array_distinct("__words.term")).alias("term")).join(first, "__row", "left"), "pii_terms")
    extra = terms.groupBy("term").agg(F.sum(F.coalesce(F.col("copies") - 1, F.lit(0))).alias("extra"))
    counts = materialize(term_counts(docs, extra, text), "pii_counts")  # the texts are read once, whatever the plan below
    n_t = extra.join(counts, "term").select("term", (F.col("n_t") - F.col("extra")).alias("n_t"))
    # PMI >= least * IC needs n(t) <= N^(1 - least) n(e)^least, as n(t,e) <= n(e)
    rare = F.col("n_t") <= F.pow(F.lit(float(n)), F.lit(1 - least)) * F.pow("n_e", F.lit(least)) * (1 + 1e-9)
    pairs = entities.join(n_e, "entity").join(terms.join(n_t, "term"), "__row").where(rare)
    pairs = materialize(pairs.select("__row", "entity", "term", "n_e", "n_t", F.col("copies").isNotNull().alias("counts")), "pii_pairs")
    together = pairs.where("counts").groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_et"))
    pmi, ic = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log2(F.lit(float(n)) / F.col("n_e"))
    shares = together.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))).where(F.col("share") >= least)

    def run(batches):
        for batch in batches:
            e, t, et = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_e", "n_t", "n_et"))
            yield batch.filter(pa.array([by_chance(n, *x) <= log(chance) for x in zip(e, t, et)], pa.bool_())).select(["entity", "term", "share"])

    telling = shares.mapInArrow(lean(run), "entity string, term string, share double")
    return pairs.join(telling, ["entity", "term"]).groupBy("__row", "term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) with counts, base_sha256, base, all_spans and clean.

    all_spans: base and disclosing terms in order, terms with their share. clean: the sanitised
    text (see masked) where the text has spans, null where it has none and is its own clean text.
    """
    found = find_base(docs, text, drop).withColumn("__row", F.monotonically_increasing_id())
    found = materialize(found.drop("all_spans", "clean"), "pii")
    telling = disclosing(docs, found, text)
    ordered = "array<struct<begin:int,kind:int,end:int,share:double>>"
    share = F.lit(None).cast("double").alias("share")
    base = F.transform("base", lambda x: F.struct(x["begin"].alias("begin"), x["kind"].alias("kind"), x["end"].alias("end"), share))
    known = found.where("__copy is not null").select("__row", "__text", base.cast(ordered).alias("__base"), "__words")
    if telling is not None:
        words = known.select("__row", F.explode("__words").alias("x")).select("__row", "x.*")
        place = F.struct("begin", F.lit(4).alias("kind"), "end", "share")
        terms = words.join(telling, ["__row", "term"]).groupBy("__row").agg(F.collect_list(place).alias("__terms"))  # of one text
        every = F.concat("__base", F.coalesce(F.col("__terms").cast(ordered), F.array().cast(ordered)))
        known = known.join(terms, "__row", "left").select("__row", "__text", F.array_sort(every).alias("all_spans"))
    else:
        known = known.select("__row", "__text", F.col("__base").alias("all_spans"))
    rest = [c for c in found.columns if not c.startswith("__")]
    out = found.select(*rest, "__row").join(_cleaned(known), "__row", "left").drop("__row")
    return out.withColumn("all_spans", F.coalesce("all_spans", F.array().cast(ordered)))


def _cleaned(known: DataFrame) -> DataFrame:
    """(__row, all_spans, clean) of (__row, __text, all_spans)."""
    schema = T.StructType([known.schema["__row"], known.schema["all_spans"], T.StructField("clean", T.StringType())])

    def run(batches):
        for batch in batches:
            row, text, spans = batch.columns
            clean = [masked(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist())]
            yield pa.RecordBatch.from_arrays([row, spans, pa.array(clean, pa.string())], names=schema.fieldNames())

    return known.mapInArrow(lean(run), schema)


def spans_text(column: str = "all_spans"):
    """kind:begin:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL])
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["begin"].cast("string"), x["end"].cast("string"))))


def masked(text: str | None, spans: list[dict]) -> str | None:
    """text with base spans and terms generalised to their kind, and terms of a share beyond REMOVES removed."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        if s["begin"] >= at:
            out += [text[at : s["begin"]], "" if (s["share"] or 0) > REMOVES else f"<{ALL[s['kind']]}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their texts masked, and the columns of find() but clean (offsets are those of the original)."""
    found = find(docs, text)
    return found.withColumn(text, F.coalesce("clean", F.col(text))).drop("clean")
