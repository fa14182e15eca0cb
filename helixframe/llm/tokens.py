"""Token counts of a SentencePiece BPE vocabulary by rank-synchronous array merging.

Texts fall into pre-tokens at places that no merge can cross. Pre-tokens not met before are held together as one ragged
array of symbols; in each step every pre-token merges its pair of lowest rank, the leftmost on a tie, all at once. What
survives is counted: one token for a symbol of the vocabulary, one per UTF-8 byte for any other character."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Pre-tokens of up to so many symbols are merged together, one pair of each in a step; a longer one is merged by itself, all places
#: of a pair in a step.
LONG = 512
#: Texts on which a model with another normaliser, without byte fallback or without the dummy prefix gives other counts.
_PROBES = ["a", " a", "a  b", "ﬁ Å é é Ａ", "\u200b\x00\x07", "😀中文", "a\tb\r\nc", "½ ™ ﷺ", "ＡＢＣ １２３", "The quick brown fox"]
#: The counts of so many pre-tokens are remembered by a worker; then it forgets them. This only saves time.
REMEMBERED = 600_000
_SPACE = "▁"
_FAR = np.iinfo(np.int64).max


class BpeCounter:
    """Counts tokens as the model's own encoder does with its defaults: identity normaliser, dummy prefix, byte fallback."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        scores = [sp.get_score(i) for i in ids]
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.symbol = {p: i for i, p in enumerate(pieces)}
        joined = {c for p in pieces if len(p) > 1 for c in p}
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece crosses from a word into the next; pre-tokens can't be cut at spaces")
        self.in_vocab = len(pieces)
        for c in sorted(joined - self.symbol.keys()):  # characters that only occur inside pieces
            self.symbol[c] = len(self.symbol)
        table = {}
        for p, s in zip(pieces, scores):
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    table[a << 20 | b] = (rank[s], self.symbol[p])
        self.table = table
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        self.free_newline = "\n" not in joined  # then no merge crosses a line end
        self.counts: dict[str, int] = {}
        self.newline = self._lone("\n")
        self._check(sp)

    def _check(self, sp) -> None:
        """Refuse a model whose encoder works otherwise."""
        self.cut = re.compile(rf"\n|{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+" if self.free_newline else rf"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        wrong = [t for t, n in zip(_PROBES, self.count_all(_PROBES)) if n != len(sp.encode(t))]
        if wrong:
            raise ValueError(f"this model doesn't encode as the counter does: {wrong!r}")

    def _lone(self, c: str) -> int:
        return 1 if self.symbol.get(c, self.in_vocab) < self.in_vocab else len(c.encode())

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        if self.free_newline and "  " not in text and _SPACE not in text and text[0] != " ":
            return (_SPACE + text.replace(" ", " " + _SPACE).replace("\n", " \n ")).split(" ")
        return self.cut.findall(_SPACE + text.replace(" ", _SPACE))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and products of adjacent symbols; _FAR where they don't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _FAR), self.made[at]

    def merge_batch(self, words: list[str]) -> np.ndarray:
        """Token counts of short pre-tokens."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        get = self.symbol.get
        chars = "".join(words)
        sym = np.array([get(c, -1) for c in chars], np.int64)
        alone = np.array([0 if 0 <= get(c, -1) < self.in_vocab else len(c.encode()) for c in chars], np.int64)  # tokens of a lone character, 0: it's in the vocabulary
        seq = np.repeat(np.arange(len(words)), lengths)
        while len(sym):
            # rank of each symbol with its right neighbour
            rank = np.full(len(sym), _FAR)
            same = seq[:-1] == seq[1:]
            at = np.flatnonzero(same)
            rank[at], made = self._pairs(sym[at], sym[at + 1])
            full = np.zeros(len(sym), np.int64)
            full[at] = made
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            key = np.where(rank == _FAR, _FAR, rank << 32 | np.arange(len(sym)))
            low = np.minimum.reduceat(key, starts)
            done = low == _FAR
            ended = np.repeat(done, np.diff(np.concatenate([starts, [len(sym)]])))
            if done.any():
                np.add.at(out, seq[ended], np.where(alone[ended] > 0, alone[ended], 1))
            pick = low[~done] & 0xFFFFFFFF
            sym[pick] = full[pick]
            alone[pick] = 0
            keep = ~ended
            keep[pick + 1] = False
            sym, seq, alone = sym[keep], seq[keep], alone[keep]
        return out

    def merge_long(self, word: str) -> int:
        """Token count of one long pre-token: all places of its lowest-rank pair merge at once, as long as no pair that this
        makes ranks as low; otherwise only the first of them does. The ranks stand in an array, in which a step changes those
        beside its merges only."""
        n = len(word)
        get = self.symbol.get
        sym = np.array([get(c, -1) for c in word], np.int64)
        alone = np.array([0 if 0 <= get(c, -1) < self.in_vocab else len(c.encode()) for c in word], np.int64)
        made, rank = np.zeros(n, np.int64), np.full(n, _FAR)
        rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        live, dead = np.ones(n, bool), 0
        while True:
            low = rank.min()
            if low == _FAR:
                return int(np.where(alone[live] > 0, alone[live], 1).sum())
            at = np.flatnonzero(rank == low)
            # of places that overlap each second one merges, from the left
            chain = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            start = np.flatnonzero(~chain)
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))) % 2 == 0]
            if len(at) > 1:
                right = nxt[nxt[at]]  # what follows each, before its own merge
                left = prev[at]
                merged_left = np.concatenate([[False], nxt[nxt[at[:-1]]] == at[1:]])
                before = np.where(left >= 0, sym[left], -1)
                before[merged_left] = made[at[:-1]][merged_left[1:]]
                after = np.where(right < n, sym[np.minimum(right, n - 1)], -1)
                if min(self._pairs(before, made[at])[0].min(), self._pairs(made[at], after)[0].min()) <= low:
                    at = at[:1]
            gone = nxt[at]
            sym[at], alone[at] = made[at], 0
            live[gone], rank[gone] = False, _FAR
            nxt[at] = nxt[gone]
            inner = nxt[at] < n
            prev[nxt[at[inner]]] = at[inner]
            touched = np.concatenate([at, prev[at][prev[at] >= 0]])
            ahead = nxt[touched]
            ends = ahead >= n
            rank[touched], made[touched] = self._pairs(sym[touched], np.where(ends, -1, sym[np.minimum(ahead, n - 1)]))
            dead += len(at)
            if 2 * dead > n:  # close the gaps
                kept = np.flatnonzero(live)
                sym, alone, made, rank = sym[kept], alone[kept], made[kept], rank[kept]
                n, dead = len(kept), 0
                live = np.ones(n, bool)
                nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)

    def count_all(self, texts: Iterable[str]) -> list[int]:
        cut = [self.pre_tokens(t or "") for t in texts]
        counts = self.counts
        if len(counts) > REMEMBERED:
            counts.clear()
        new = set().union(*cut).difference(counts)
        new.discard("")
        counts[""] = 0
        for w in [w for w in new if len(w) > LONG]:
            counts[w] = self.merge_long(w)
            new.discard(w)
        todo = sorted(new, key=len)
        for i in range(0, len(todo), 20_000):
            part = todo[i : i + 20_000]
            counts.update(zip(part, self.merge_batch(part).tolist()))
        if self.free_newline:
            counts["\n"] = self.newline
        return [sum(map(counts.__getitem__, words)) for words in cut]


_loaded: dict[str, BpeCounter] = {}


def counter(model_file: str) -> BpeCounter:
    if model_file not in _loaded:
        _loaded[model_file] = BpeCounter(model_file)
    return _loaded[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Texts are read whole. Repeated rows are counted each for itself; other
    columns are ignored; an empty table gives an empty result. model_file must exist on every executor."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(model_file)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            n = pa.array(bpe.count_all(texts), pa.int64())
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), size, n], names=["id", "n_bytes", "n_tokens"])

    out = thin.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
