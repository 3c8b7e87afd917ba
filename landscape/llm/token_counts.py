"""Byte-pair token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch that were not seen before are laid end to end in one
symbol array. In each round every pre-token finds its own lowest-rank
neighbouring pair and all pre-tokens merge theirs at once; pre-tokens without
a mergeable pair leave the array. The number of symbols left is the token
count. No text crosses a shuffle: the job is one pass over the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_texts, rows_of

# The published byte-level pre-tokeniser pattern.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHE_ENTRIES = 400_000   # per Python worker; cleared when full
BLOCK = 50_000            # pre-tokens of a long text handled at once
NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class RankMerger:
    """Counts the symbols that survive byte-pair merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = np.int64(max(vocab.values()) + 1)
        self.byte_id = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cache: dict[str, int] = {}
        self.pattern = regex.compile(PRETOKEN)
        self.split = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NO_RANK)

    def symbols_left(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string."""
        left = np.zeros(len(words), np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.flatnonzero(size)
        size = size[ids]
        if not len(ids):
            return left
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        owner = np.repeat(np.arange(len(ids)), size)
        # rank of the pair that starts at each symbol; none at a word's last symbol
        rank = np.full(len(sym), NO_RANK)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while True:
            low = np.minimum.reduceat(rank, start)
            going = low < NO_RANK
            if not going.all():
                done = ~going
                left[ids[done]] = size[done]
                if not going.any():
                    return left
                keep = going[owner]
                sym, rank = sym[keep], rank[keep]
                ids, size, low = ids[going], size[going], low[going]
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                owner = np.repeat(np.arange(len(ids)), size)
            hit = rank == low[owner]
            # a run of overlapping hits (only of one symbol repeated) merges every other one from its left end
            over = hit[1:] & hit[:-1]
            if over.any():
                at = np.flatnonzero(hit)
                new = np.ones(len(at), bool)
                new[1:] = np.diff(at) > 1
                run = np.cumsum(new) - 1
                hit[at[(at - at[new][run]) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size -= np.bincount(owner[at], minlength=len(ids))
            sym, rank, owner = sym[keep], rank[keep], owner[keep]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            # only the merged symbols and their left neighbours have new pairs
            now = np.cumsum(keep)[at] - 1
            touched = np.concatenate([now, now[now > 0] - 1])
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(sym)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self._ranks(sym[touched], sym[touched + 1])

    def _pieces(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(special tokens before, pre-tokens) blocks of a text."""
        parts = self.split.split(text) if self.split else [text]
        for i, part in enumerate(parts):
            if len(part) < 8 * BLOCK:
                yield int(i > 0), self.pattern.findall(part)
                continue
            found = (m[0] for m in self.pattern.finditer(part))
            special = int(i > 0)
            while block := list(islice(found, BLOCK)):
                yield special, block
                special = 0

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text (null: 0)."""
        out = np.zeros(len(texts), np.int64)
        pending: list[tuple[int, list[str]]] = []
        waiting = 0
        for row, text in enumerate(texts):
            if not text:
                continue
            for special, block in self._pieces(text):
                out[row] += special
                pending.append((row, block))
                waiting += len(block)
                if waiting >= 4 * BLOCK:
                    self._settle(pending, out)
                    pending, waiting = [], 0
        self._settle(pending, out)
        return out

    def _settle(self, pending: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = self.cache
        new = {w for _, block in pending for w in block if w not in known}
        if new:
            words = list(new)
            known.update(zip(words, self.symbols_left([w.encode("utf-8") for w in words]).tolist()))
        for row, block in pending:
            out[row] += sum(map(known.__getitem__, block))


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """One per Python worker and vocabulary."""
    return RankMerger(path)


def count_tokens(docs: DataFrame, vocab_path: str, text: str = "text",
                 n_tokens: str = "n_tokens", n_bytes: str = "n_bytes",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the number of UTF-8 bytes and of tokens of each text.

    ``vocab_path`` is a byte-level ``tokenizers`` file that every executor has
    (a parameter; the file is never shipped). Null text counts as empty (0, 0);
    repeated rows are counted each; an empty table gives an empty result. Output
    columns replace columns of the same name; the others (those to ``keep``, if
    named) stay.
    Special strings inside texts count as one token each, as the library's
    default does.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    src, back = carried(docs, text, (n_tokens, n_bytes), keep, nb_=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocab_path)
        for batch in rows_of(batches, "text_", 4 << 20):
            n = m.count(batch.column("text_").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_"])

    done = map_texts(src, run, "n_ bigint", keep is None or text in keep)
    return done.select(*back, F.col("nb_").alias(n_bytes), F.col("n_").alias(n_tokens))
