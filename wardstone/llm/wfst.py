"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model compiles into transducers that are composed lazily with each input:

* the normaliser: an arc at the start of a text that writes a leading blank, and arcs that map blanks to U+2581 and every
  other character to itself. It is composed with the pieces when compiling: the piece arcs read the text as it is;
* byte fallback: a character that is no piece becomes a chain of arcs, one to each of its bytes' ids;
* the pieces: a trie of arcs from a piece's characters, ending in its id, weighing minus its score;
* for a merge model (BPE), the acceptor of neighbouring pieces: its states are pieces, and an arc leads from one to
  the next if merging the characters of both ends in these two. A sequence of such arcs is the merge order's own
  result, runs of blanks included, so the composed lattice holds one complete path. For a unigram model it has one
  state and accepts all.

A state of the composition is a position with the acceptor's state. Positions are its topological order; each arc
out of a position relaxes the state it leads to in the tropical semiring (sums along a path, the least over paths),
and the least state at the end gives the path back, which is the ids.

Between two characters that no piece holds side by side nothing merges and no arc passes, so the lattice has a cut point
there and falls into chunks, whose paths a worker remembers. Chunks are cut by kinds of characters, which the model's pieces
are checked against when compiling: at line breaks and before blanks, and where letters meet others, if no piece mixes them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import text_batches

BLANK = "▁"
BEGIN = "\ud800"  # stands before the first character on the input tape; no Unicode text holds it
BYTE = 0x110000  # the symbol of byte b on the tape is BYTE + b, beyond all characters
CHUNKS_KEPT = 200_000  # chunk paths a worker remembers
SYMBOLS_AT_ONCE = 80_000  # characters of chunks that are relaxed together
LONG = 64  # characters of a chunk, beyond which it is not relaxed together with others
NEVER = 2**31 - 1  # the rank of a merge that the model lacks
_BLANKS = rf" {BLANK}{BEGIN}"
_FIGURES = r"\d_²³¹¼½¾"  # of the word class, but with the marks
#: Ways to cut a text into chunks, the finest first. Each cuts between two characters by their kinds alone.
_CHUNKS = (
    re.compile(rf"[{_BLANKS}]*[^\W{_FIGURES}]+|[{_BLANKS}]*(?:[^{_BLANKS}\n\w]|[{_FIGURES}])+|[{_BLANKS}]+|\n"),  # letters and others apart
    re.compile(rf"[{_BLANKS}]*[^{_BLANKS}\n]+|[{_BLANKS}]+|\n"),
)


class Table:
    """Numbers by key, for many keys at once: open addressing with a load of a quarter at most, so that one probe mostly settles a key."""

    def __init__(self, entries: dict[int, float], default: float, kind: type):
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.default = np.full(1 << bits, -1, np.int64), np.full(1 << bits, default, kind), default
        keys, values = np.array(list(entries), np.int64), np.array(list(entries.values()), kind)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.keys[at[own]], self.values[at[own]] = keys[own], values[own]
            rest = np.delete(np.arange(len(keys)), own)
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, the default for those that are none."""
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        more = np.flatnonzero((found != keys) & (found != -1))
        at = at[more]
        while len(more):
            at = (at + 1) & self.mask
            found = self.keys[at]
            out[more] = self.values[at]
            on = np.flatnonzero((found != keys[more]) & (found != -1))
            more, at = more[on], at[on]
        return out


class Transducer:
    """The compiled model at a path; encode and decode whole texts."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with a leading blank is compiled")
        if kind not in (1, 2) or not proto.trainer_spec.byte_fallback:
            raise ValueError("only unigram and merge models with byte fallback are compiled")
        self.merges = kind == 2
        self.arcs, self.weight, self.byte, self.bytes_of = {}, {}, {}, []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (1, 4):
                self.arcs[p.piece] = i
                self.weight[i] = -p.score
                self.bytes_of.append(p.piece.replace(BLANK, " ").encode())
            else:
                self.bytes_of.append(b"")
        self.text_of = {i: s for s, i in self.arcs.items()}
        self.chunks = next((way for way in _CHUNKS if all(way.findall(s) == [s] for s in self.arcs)), None)
        if self.chunks is None:
            raise ValueError("pieces span cut points")
        if any(c not in self.arcs for s in self.arcs for c in s):
            raise ValueError("characters of pieces must be pieces")
        self.passes: dict[int, bool] = {}  # arcs of the acceptor found so far, and pairs without one
        self.unknown = max(self.weight.values(), default=0) + 10.0
        self.width = "<u2" if len(proto.pieces) <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        self.known: dict[str, bytes] = {}  # paths of chunks met of late, and before those
        self.before: dict[str, bytes] = {}
        self.made = dict(self.arcs)
        if self.merges:
            self._compile_pairs()
        self._compile_tables()

    # -- the acceptor of neighbouring pieces ---------------------------------------------------------

    def _compile_pairs(self):
        #: Rank of the merge that makes a piece; characters are never made. Parts: what that merge joined.
        self.rank = {i: -1.0 if len(s) == 1 else self.weight[i] for s, i in self.arcs.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        for s, i in sorted(self.arcs.items(), key=lambda x: self.rank[x[1]]):
            if len(s) > 1:
                parts = self._last_merge(s)
                if parts[0] >= 0:
                    self.parts[i] = parts
                else:  # merging never makes it, so no arc leads to it
                    del self.made[s]

    def _last_merge(self, s: str) -> tuple[int, int]:
        symbols = [self.arcs.get(c, -1) for c in s]
        names = list(s)
        while len(symbols) > 2:
            best = min(((self.weight[self.arcs[a + b]], k) for k, (a, b) in enumerate(zip(names, names[1:], strict=False)) if a + b in self.arcs), default=None)
            if best is None:
                break
            k = best[1]
            names[k : k + 2] = [names[k] + names[k + 1]]
            symbols[k : k + 2] = [self.arcs[names[k]]]
        return (symbols[0], symbols[1]) if len(symbols) == 2 else (-1, -1)

    def accepts(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces ends in these two: no merge across the seam comes first."""
        if self.is_byte[left] or self.is_byte[right]:  # bytes merge with nothing
            return True
        key = left << 20 | right
        known = self.passes.get(key)
        if known is None:
            if len(self.passes) > 50_000:
                self.passes.clear()
            known = self.passes[key] = self._accepts(left, right)
        return known

    def _accepts(self, left: int, right: int) -> bool:
        text, rank, before = self.text_of, self.rank, (np.inf, 0)
        while True:
            across = self.arcs.get(text[left] + text[right])
            if across is not None and (rank[across], 0) < before:
                return False
            if rank[left] > rank[right]:  # take back the later of the two merges; of equals the left one came first
                before, left = (rank[left], 0), self.parts[left][1]
            elif rank[right] >= 0:
                before, right = (rank[right], 1), self.parts[right][0]
            else:
                return True

    # -- shortest paths ------------------------------------------------------------------------------

    def _tape(self, chunk: str) -> np.ndarray:
        """The symbols of a chunk: characters that are pieces as they are, others as a chain of their bytes."""
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        return points if self.single[points].all() else self._with_bytes(points, np.zeros(len(points), np.int64))[0]

    def _with_bytes(self, points: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words, with the bytes of every character that is no piece in its place."""
        at = np.flatnonzero(~self.single[points])
        chains = [chr(c).encode("utf-8", "surrogatepass") for c in points[at].tolist()]
        size = np.ones(len(points), np.int64)
        size[at] = [len(c) for c in chains]
        out = np.repeat(points, size)
        out[np.repeat(~self.single[points], size)] = np.frombuffer(b"".join(chains), np.uint8).astype(np.int64) + BYTE
        return out, np.repeat(word, size)

    def _shortest(self, chunk: str) -> list[int]:
        """The ids on the shortest path of a chunk's lattice, symbol by symbol.

        Of equally long paths of a unigram model that whose last arcs begin first.
        """
        tape, step, piece_at, weights, merges = self._tape(chunk).tolist(), self.next_node, self.piece_list, self.weight_list, self.merges
        n = len(tape)
        states: list = [None] * (n + 1)  # per position: (length, acceptor's state, state before)
        states[0] = [(0.0, -1, None)]
        for at in range(n):
            here = states[at]
            if here is None:
                continue
            if not merges and len(here) > 1:
                here = [min(here, key=lambda x: x[0])]
            node, to = 0, at
            while to < n and (node := step.get(node << 21 | tape[to])) is not None:
                to += 1
                piece = piece_at[node]
                if piece < 0:
                    continue
                best = None
                for state in here:
                    if merges and state[1] >= 0 and not self.accepts(state[1], piece):
                        continue
                    if best is None or state[0] < best[0]:
                        best = state
                if best is not None:
                    new = (best[0] + weights[piece], piece, best)
                    if states[to] is None:
                        states[to] = [new]
                    else:
                        states[to].append(new)
        state, path = min(states[n], key=lambda x: x[0]), []
        while state[2] is not None:
            path.append(state[1])
            state = state[2]
        return path[::-1]

    # -- the same relaxation for many chunks at once ---------------------------------------------------

    def _compile_tables(self):
        """The normaliser, byte fallback and piece arcs as one trie of (node, symbol) keys, and the merges across two pieces
        as (left, right) keys."""
        next_node, piece_at = {}, [-1]
        read_as = {BLANK: (" ", BLANK, BEGIN)}  # what the normaliser writes as a character
        for s, i in self.made.items():
            node = 0
            for c in s:
                to = next_node.setdefault(node << 21 | ord(c), len(piece_at))
                if to == len(piece_at):
                    piece_at.append(-1)
                for other in read_as.get(c, ()):
                    next_node[node << 21 | ord(other)] = to
                node = to
            piece_at[node] = i
        size = len(self.bytes_of)
        self.is_byte = np.zeros(size, bool)
        self.weight_of, self.rank_of, self.left_of, self.right_of = np.zeros(size), np.full(size, -1, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b, i in self.byte.items():
            next_node[BYTE + b] = len(piece_at)
            piece_at.append(i)
            self.is_byte[i], self.weight_of[i] = True, 0.0 if b & 0xC0 == 0x80 else self.unknown  # a chain weighs this once
        self.steps = Table(next_node, -1, np.int32)
        self.next_node, self.piece_list, self.piece_at = next_node, piece_at, np.array(piece_at, np.int64)
        self.first_node = np.full(BYTE + 256, -1, np.int32)  # the arcs that leave the root, by symbol
        for k, to in next_node.items():
            if k < BYTE + 256:
                self.first_node[k] = to
        self.single = np.zeros(BYTE, bool)  # characters that are pieces after the normaliser
        self.single[[k for k, to in next_node.items() if k < BYTE and piece_at[to] >= 0]] = True
        for i, w in self.weight.items():
            self.weight_of[i] = w
        self.weight_list = self.weight_of.tolist()
        merged = {}
        if self.merges:
            order = {r: 2 * k for k, r in enumerate(sorted({r for r in self.rank.values() if r >= 0}))}  # even, so that odd numbers come right after
            for i, r in self.rank.items():
                self.rank_of[i] = order.get(r, -1)
            for i, (left, right) in self.parts.items():
                self.left_of[i], self.right_of[i] = left, right
            for s, i in self.arcs.items():
                for k in range(1, len(s)):
                    if s[:k] in self.arcs and s[k:] in self.arcs:
                        merged[self.arcs[s[:k]] << 20 | self.arcs[s[k:]]] = order[self.rank[i]]
        self.merge_rank = Table(merged, NEVER, np.int32)

    def _accept_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """accepts() of many pairs. Bytes have no parts and no merges, so nothing forbids them."""
        ok = np.ones(len(left), bool)
        at, a, b, before = np.arange(len(left)), left, right, np.full(len(left), NEVER, np.int32)
        while len(at):
            bad = self.merge_rank.get(a << 20 | b) < before
            ok[at[bad]] = False
            ra, rb = self.rank_of[a], self.rank_of[b]
            go = np.flatnonzero(~bad & ((ra >= 0) | (rb >= 0)))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            before = np.where(undo_left, ra, rb + 1)  # a merge of equal rank comes before one on its right
            a, b = np.where(undo_left, self.right_of[a], a), np.where(undo_left, b, self.left_of[b])
        return ok

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids on the shortest paths of chunks, none empty, one after another, and where those of each chunk end.

        Positions go in order, those of all chunks together. A position has one state that counts, the arc that ends in it
        on the least path: a unigram model's acceptor has no other, and a merge model lets one arc in (what comes before
        a position is a text too, with one path). Of equally long paths that whose last arcs begin first.
        """
        size = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if not self.single[points].all():
            points, word = self._with_bytes(points, np.repeat(np.arange(len(words)), size))
            size = np.bincount(word, minlength=len(words))
        end = np.cumsum(size)
        begin = end - size
        # Arcs are walked from every position at once, by their lengths; then they stand by the positions that they leave.
        place, node, left, found, count = np.arange(len(points)), self.first_node[points], np.repeat(end, size) - 1, [], np.zeros(len(points) + 1, np.int64)
        left -= place  # symbols that follow in the chunk
        length = 0
        while len(place):
            piece = self.piece_at[node]
            some = np.flatnonzero(piece >= 0)
            from_here = place[some]
            found.append((from_here, count[from_here], length, piece[some]))
            count[from_here] += 1
            inside = np.flatnonzero(left > length)
            length += 1
            place, left = place[inside], left[inside]
            node = self.steps.get(node[inside].astype(np.int64) << 21 | points[place + length])
            good = np.flatnonzero(node >= 0)
            place, node, left = place[good], node[good], left[good]
        first = np.r_[0, np.cumsum(count[:-1])]  # the first arc that leaves a position
        start, last, piece = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        for place, nth, length, pieces in found:
            to = first[place] + nth
            start[to], last[to], piece[to] = place, place + length, pieces
        weight = self.weight_of[piece]
        total, into = np.full(len(points), np.inf), np.full(len(points), -1)  # of the least path that ends with a symbol, and its last arc
        for t in range(int(size.max())):
            at = begin[size > t] + t
            if t:
                at = at[into[at - 1] >= 0]
            n = count[at]
            arc = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            new = weight[arc]
            if t:
                before = np.repeat(at - 1, n)
                if self.merges:
                    ok = np.flatnonzero(self._accept_many(piece[into[before]], piece[arc]))
                    arc, before, new = arc[ok], before[ok], new[ok]
                new = total[before] + new
            to = last[arc]
            less = np.flatnonzero(new < total[to])
            total[to[less]], into[to[less]] = new[less], arc[less]
        own, now, steps = np.arange(len(words)), into[end - 1], []
        while len(own):  # back from the ends
            steps.append((own, piece[now]))
            on = np.flatnonzero(start[now] > begin[own])
            own, now = own[on], into[start[now[on]] - 1]
        ends = np.cumsum(np.bincount(np.concatenate([own for own, _ in steps]), minlength=len(words)))
        ids = np.empty(ends[-1], np.int64)
        for k, (own, pieces) in enumerate(steps, 1):
            ids[ends[own] - k] = pieces
        return ids, ends

    def _shortest_many(self, words: list[str]) -> list[list[int]]:
        """_shortest() of chunks, none empty."""
        ids, ends = self._relax(words)
        return [path.tolist() for path in np.split(ids, ends[:-1])]

    def _learn(self, chunks: set[str]) -> None:
        """Find and remember the ids of chunks: short ones together, long ones by themselves."""
        short = sorted((c for c in chunks if len(c) <= LONG), key=len, reverse=True)  # of one length together: fewer steps for each part
        at = 0
        while at < len(short):
            part = short[at : at + SYMBOLS_AT_ONCE // len(short[at])]
            at += len(part)
            ids, ends = self._relax(part)
            raw, ends = ids.astype(self.width).tobytes(), (ends * int(self.width[-1])).tolist()
            for chunk, begin, end in zip(part, [0, *ends], ends, strict=False):
                self.known[chunk] = raw[begin:end]
        for chunk in chunks:
            if len(chunk) > LONG:
                self.known[chunk] = array(self.code, self._shortest(chunk)).tobytes()

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; null and empty texts have none. U+2581 in a text is a blank, as in the library."""
        out, held, waiting = [[] for _ in texts], [], 0
        for i, text in enumerate(texts):
            chunks = self.chunks.findall(BEGIN + text) if text else []
            for at in range(0, len(chunks), 20_000):
                held.append((i, chunks[at : at + 20_000]))
                waiting += len(held[-1][1])
                if waiting > 60_000:
                    self._join(held, out)
                    held, waiting = [], 0
        self._join(held, out)
        return [np.frombuffer(b"".join(parts), self.width) for parts in out]

    def _join(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        own = set().union(*(part for _, part in held))
        missing = own.difference(self.known)
        new = missing.difference(self.before)
        self.known.update({c: self.before[c] for c in missing - new})  # those that come again stay
        self._learn(new)
        for i, part in held:
            out[i].append(b"".join(map(self.known.__getitem__, part)))
        if len(self.known) > CHUNKS_KEPT // 2:
            self.before, self.known = self.known, {}

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of ids without the leading blank; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids if isinstance(ids, list) else ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    with open(path, "rb") as f:  # a library's own file, installed on every worker
        return Transducer(f.read())


def encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip[, ids]) of every row of docs.

    ids_crc32 is taken over the ids as little-endian 32-bit integers; round_trip tells whether decoding gives
    the text back (U+2581 counts as a blank). Null and empty texts have no ids and round-trip. Null ids and
    repeated rows pass through; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        t = transducer(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                ids = t.encode_many(texts)
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([t.decode(x) == (y or "").replace(BLANK, " ") for x, y in zip(ids, texts, strict=True)], pa.bool_())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
