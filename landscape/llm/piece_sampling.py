"""SentencePiece segmentations sampled by forward filtering and backward
sampling, and lossless decoding.

Every segmentation of a text into pieces is a path through its lattice; its
weight is the product of the pieces' weights (from the model's scores at a
temperature). No piece holds a blank after another character, so the lattice
falls apart into words with their leading blanks. The forward filter sums the
weights of all paths to each position, once for the distinct words of a block
and level by level for all of them; the backward pass draws pieces from the
end of every word occurrence, all occurrences a step at a time. The random
numbers are hashes of the row key, the word's number in its text and the
position, so a row's segmentation depends on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, carried, map_texts, mix64, rows_of

WORD = regex.compile(r" +[^ ]*")
BLOCK = 3 << 20


@dataclass(frozen=True)
class SamplingParams:
    """``theta`` scales the scores (0: all segmentations alike; large: the best
    one); ``floor`` bounds scores from below; ``fallback`` is the score of each
    byte piece that stands for a character without a piece."""

    theta: float = 0.0003
    floor: float = -32000.0
    fallback: float = -40000.0
    seed: int = 17


class PieceLattice:
    """Piece tables of a model with byte fallback."""

    def __init__(self, path: str, p: SamplingParams):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.p = p
        size = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * size
        normal = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                normal[text] = i
                self.bytes_of[i] = text.encode("utf-8")
        self.weight = np.array([p.theta * max(sp.get_score(i), p.floor) for i in range(size)])
        # trie: a hash table of (node, character) keys and their targets; piece of a node or -1
        nodes: dict[str, int] = {"": 0}
        key, target = [], []
        for text in sorted(normal):
            for k in range(1, len(text) + 1):
                if text[:k] not in nodes:
                    nodes[text[:k]] = len(nodes)
                    key.append((nodes[text[:k - 1]] << 21) + ord(text[k - 1]))
                    target.append(nodes[text[:k]])
        keys, targets = np.array(key, np.int64), np.array(target, np.int32)
        self.root = np.full(1 << 21, -1, np.int32)  # first characters: looked up directly
        self.root[keys[keys < 1 << 21]] = targets[keys < 1 << 21]
        self.slots = 1 << (4 * len(keys)).bit_length()
        self.key, self.target = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int32)
        self.longest = 0  # steps of linear probing
        for at, k, t in zip(self._slot(keys).tolist(), key, target):
            step = 0
            while self.key[(at + step) % self.slots] >= 0:
                step += 1
            self.key[(at + step) % self.slots], self.target[(at + step) % self.slots] = k, t
            self.longest = max(self.longest, step)
        self.piece = np.full(len(nodes), -1, np.int32)
        for text, i in normal.items():
            self.piece[nodes[text]] = i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        shift = np.uint64(65 - self.slots.bit_length())
        return ((key.astype(np.uint64) * MIX) >> shift).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        want = (node.astype(np.int64) << 21) + char
        at = self._slot(want)
        found = self.key[at]
        out = np.where(found == want, self.target[at], -1)
        open_ = np.flatnonzero((found != want) & (found >= 0))
        for step in range(1, self.longest + 1):
            if not len(open_):
                break
            at_ = (at[open_] + step) % self.slots
            found = self.key[at_]
            hit = found == want[open_]
            out[open_[hit]] = self.target[at_[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _edges(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start node, end node, piece, log weight) of all lattice edges; word w
        of ``size`` characters owns size + 1 nodes. A character without a piece is
        an edge of its own with the negated code point minus one as piece."""
        word = np.repeat(np.arange(len(size)), size)
        stop = np.repeat(np.cumsum(size), size)  # behind the last character of the word
        at = np.arange(len(chars))
        start = (at + word).astype(np.int32)
        node = np.zeros(len(chars), np.int32)
        out: list[tuple[np.ndarray, ...]] = []
        length = 0
        live = at
        while len(live):
            node = self._step(node, chars[live + length]) if length else self.root[chars[live]]
            length += 1
            if length == 1:
                known = (node >= 0)
                known[known] = self.piece[node[known]] >= 0
                lone = live[~known]
                c = chars[lone]
                many = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                out.append((start[lone], start[lone] + 1, (-c - 1).astype(np.int32), self.p.theta * self.p.fallback * many))
            on = node >= 0
            live, node = live[on], node[on]
            piece = self.piece[node]
            hit = piece >= 0
            out.append((start[live[hit]], start[live[hit]] + length, piece[hit], self.weight[piece[hit]]))
            more = live + length < stop[live]
            live, node = live[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out))

    def sample(self, words: list[str], which: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences in order and the number of each: occurrence
        i is ``words[which[i]]`` with the random seed ``noise[i]``."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        s, e, piece, weight = self._edges(chars, size)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # first node of each word
        owner = np.repeat(np.arange(len(size)), size + 1)
        order = np.argsort(e, kind="stable")  # a merge: the edges of one length are in order already
        s, e, piece, weight = s[order], e[order], piece[order], weight[order]
        # forward filter, by the end's place in its word
        place = (np.arange(len(owner)) - first[owner])[e]
        deepest = int(size.max())
        order = np.argsort(place.astype(np.uint16) if deepest < 1 << 16 else place, kind="stable")
        alpha = np.zeros(len(owner))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=deepest + 1)[1:])])
        for lo, hi in zip(bounds, bounds[1:]):
            if hi > lo:
                level = order[lo:hi]
                end = e[level]
                h = np.flatnonzero(np.concatenate([[True], np.diff(end) != 0]))
                value = alpha[s[level]] + weight[level]
                top = np.maximum.reduceat(value, h)
                span = np.diff(np.append(h, hi - lo))
                alpha[end[h]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, span)), h))
        # distribution function of the edges into each node
        total = np.cumsum(np.exp(alpha[s] + weight - alpha[e]))
        head = np.flatnonzero(np.concatenate([[True], np.diff(e) != 0]))
        last = np.zeros(len(owner), np.int64)
        last[e[head]] = np.append(head[1:], len(e)) - 1
        base = np.repeat(np.concatenate([[0.0], total])[head], np.diff(np.append(head, len(e))))
        key = e + np.minimum(total - base, 1.0)
        # backward sampling, one piece of every unfinished occurrence at a time
        who = np.argsort(which, kind="stable")  # occurrences of a word together: neighbouring look-ups
        begin = first[which[who]]
        now = begin + size[which[who]]
        drawn, owners, counts = [], [], np.zeros(len(which), np.int64)
        while len(who):
            u = (mix64(noise[who] + (now - begin).astype(np.uint64) * MIX) >> np.uint64(11)) * 2.0 ** -53
            edge = np.minimum(np.searchsorted(key, now + u), last[now])
            drawn.append(piece[edge])
            owners.append(who)
            counts[who] += 1
            now = s[edge]
            on = now > begin
            who, now, begin = who[on], now[on], begin[on]
        offset = np.cumsum(counts)
        out = np.empty(int(offset[-1]) if len(offset) else 0, np.int64)
        for step, (ids, own) in enumerate(zip(drawn, owners)):
            out[offset[own] - 1 - step] = ids
        return out, counts

    def expand(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their byte pieces."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, counts
        many = np.ones(len(pieces), np.int64)
        code = -pieces[odd] - 1
        many[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.cumsum(many) - many
        out = np.repeat(pieces, many)
        for c in np.unique(code):
            for k, b in enumerate(chr(c).encode("utf-8")):
                out[at[odd[code == c]] + k] = self.byte_id[b]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, many, len(counts)).astype(np.int64)

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled piece ids of each text; an empty text has none."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        block: list[tuple[int, int, list[str]]] = []
        waiting = 0

        def settle() -> None:
            index: dict[str, int] = {}
            which = np.array([index.setdefault(w, len(index)) for _, _, ws in block for w in ws], np.int64)
            row = np.repeat([r for r, _, _ in block], [len(ws) for _, _, ws in block])
            number = np.concatenate([np.arange(k, k + len(ws)) for _, k, ws in block])
            noise = mix64(keys[row] ^ mix64((number + 1).astype(np.uint64) * MIX + np.uint64(self.p.seed)))
            out, counts = self.expand(*self.sample(list(index), which, noise))
            ends = np.cumsum(counts)[np.cumsum([len(ws) for _, _, ws in block]) - 1]
            for (r, _, _), ids in zip(block, np.split(out, ends[:-1])):
                parts[r].append(ids.astype(np.int32))

        for r, text in enumerate(texts):
            if not text:
                continue
            text, number, lo = " " + text, 0, 0
            while lo < len(text):
                hi = len(text)
                if hi - lo > BLOCK:  # a long text goes on behind the next word
                    cut = regex.search(r"[^ ] ", text, pos=lo + BLOCK // 2)
                    hi = cut.start() + 1 if cut else hi
                ws = WORD.findall(text[lo:hi])
                block.append((r, number, ws))
                number += len(ws)
                waiting += hi - lo
                lo = hi
                if waiting >= BLOCK:
                    settle()
                    block.clear()
                    waiting = 0
        if block:
            settle()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in parts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of ragged piece ids (row r: offsets[r] to offsets[r + 1])."""
        table = self.bytes_of
        out = []
        for lo, hi in zip(offsets, offsets[1:]):
            raw = b"".join([table[i] for i in ids[lo:hi].tolist()])
            out.append(raw.decode("utf-8", "replace")[1:])
        return out


@lru_cache(maxsize=2)
def lattice(path: str, p: SamplingParams) -> PieceLattice:
    return PieceLattice(path, p)


def sample_pieces(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
                  pieces: str = "pieces", params: SamplingParams = SamplingParams(),
                  keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the sampled piece ids of each text (array<int>).

    The draw depends on the row's ``key``, the text and the parameters only, so
    repeated rows get the same pieces; null keys draw like the text "null". Null
    and empty texts have no pieces. A column named like the result is replaced,
    the others (those to ``keep``, if named) stay. Texts are taken as they are (no normalisation), with
    the model's leading blank added.
    """
    draw = F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(params.seed))
    src, back = carried(docs, text, (pieces,), keep, key_=draw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(model_path, params)
        for batch in rows_of(batches, "text_", BLOCK):
            ids = m.encode(batch.column("text_").to_pylist(), batch.column("key_").to_numpy().view(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()),
                                             pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "p_"])

    out = map_texts(src, run, "p_ array<int>", keep is None or text in keep)
    return out.select(*back, F.col("p_").alias(pieces))


def decode_pieces(rows: DataFrame, model_path: str, pieces: str = "pieces", text: str = "decoded",
                  params: SamplingParams = SamplingParams()) -> DataFrame:
    """``rows`` with the text that each array of piece ids spells. Null and
    empty arrays give an empty text; ids of control pieces spell nothing; ids
    outside the model fail."""
    keep = [c for c in rows.columns if c != text]
    src = rows.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
                      + [F.coalesce(F.col(f"`{pieces}`"), F.array().cast("array<int>")).alias("p_")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(model_path, params)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column("p_")
                offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
                texts = m.decode(np.asarray(ids.flatten()), offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, "t_"])

    schema = ", ".join(f"`{k}` {v}" for k, v in src.dtypes) + ", t_ string"
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("t_").alias(text))
