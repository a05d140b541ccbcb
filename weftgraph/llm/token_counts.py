"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are put into a trie (visited in sorted order, which is the
trie's depth-first order). Each trie node holds the best score and token count of the prefix it
stands for, so a prefix shared by many pre-tokens is computed once; terminal nodes leave their
count in a table by which the texts are summed. No shuffle: each map task works on whole texts.

Scores: log(1 / (rank + 2)) by a piece's rank in the public vocabulary, no training. A character
outside the vocabulary costs one token a UTF-8 byte. Best score first, then fewer tokens.

A null or blank text has 0 tokens; an empty table gives no rows; repeated rows count alike. Pre-tokens are what white space separates, each preceded by
the word mark. Pre-tokens over ``LONG`` characters are put into a trie of their own each and not stored. Memory: at
most ``HELD`` stored counts a worker, in two generations. Extra columns are kept; columns named
as the results are replaced.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.common import lean

MARK = "▁"
LONG = 64
HELD = 400_000


@lru_cache(2)
def load_pieces(path: str) -> tuple[dict[str, float], int]:
    """Piece scores and the longest piece's length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces[model.id_to_piece(i)] = -math.log(i + 2)
    return pieces, max(map(len, pieces))


class TrieCounter:
    """Counts tokens of pre-tokens; a node's (score, tokens) is computed once for all pre-tokens through it."""

    def __init__(self, pieces: dict[str, float], longest: int):
        self.pieces, self.longest = pieces, longest
        self.floor = min(pieces.values(), default=0.0) - 1.0
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.nodes = 0

    def _extend(self, word: str, score: list[float], tokens: list[int], start: int) -> None:
        get, longest = self.pieces.get, self.longest
        for end in range(start + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, count = score[end - 1] + self.floor * n, tokens[end - 1] + n
            for begin in range(max(0, end - longest), end):
                own = get(word[begin:end])
                if own is not None:
                    s, c = score[begin] + own, tokens[begin] + 1
                    if s > best or (s == best and c < count):
                        best, count = s, c
            score.append(best)
            tokens.append(count)
            self.nodes += 1

    def insert(self, words: list[str]) -> dict[str, int]:
        """Terminal counts of distinct words."""
        out = {}
        score, tokens, last = [0.0], [0], ""
        for word in sorted(words):
            full = MARK + word
            shared, most = 0, min(len(full), len(last))
            while shared < most and full[shared] == last[shared]:
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            self._extend(full, score, tokens, shared)
            last = full
            out[word] = tokens[-1]
        return out

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        words = [t.split() if t else [] for t in texts]
        fresh = {w for ws in words for w in ws if w not in self.new}
        table = {w: self.old[w] for w in fresh if w in self.old}
        alone = {w for w in fresh if len(w) > LONG}
        counted = self.insert([w for w in fresh if w not in table and w not in alone])
        table.update(counted)
        for w in alone:
            table.update(self.insert([w]))
        for w in alone:
            fresh.discard(w)
        if len(self.new) + len(fresh) > HELD // 2:
            known = self.new
            self.old, self.new = known, {}
            lookup = {w: known[w] for ws in words for w in ws if w in known} | table
        else:
            lookup = None
        self.new.update((w, table[w]) for w in fresh)
        if lookup is None:
            new = self.new
            return [sum([new[w] if w in new else table[w] for w in ws]) for ws in words], [len(ws) for ws in words]
        return [sum([lookup[w] for w in ws]) for ws in words], [len(ws) for ws in words]


@lru_cache(1)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(*load_pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) with n_tokens and n_pretokens; vocabulary is the path of a sentencepiece file on every machine."""
    kept = docs.drop("n_tokens", "n_pretokens")
    at = kept.columns.index(text)
    names = [c for c in kept.columns if c not in drop]
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())])

    def run(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            n, m = [], []
            for i in range(0, len(texts), 500):
                a, b = counter.count(texts[i : i + 500])
                n += a
                m += b
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.array(n, np.int64)), pa.array(np.array(m, np.int64))], names=schema.fieldNames())

    return kept.mapInArrow(lean(run), schema)
