"""Byte-level BPE: a segment tree over byte positions holds the leftmost minimum pair rank.

A leaf is the rank of the pair that starts at a live position, joined with the position, so
the root is the leftmost pair of lowest rank. A merge changes three leaves (the merged pair,
its left neighbour's pair and the swallowed position), each by a walk to the root. Short
pieces of one width run through their trees together, one array operation per level; a
longer piece has a tree of its own.

Splitting follows the vocabulary's published pattern, by character class over code points.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowsentry.llm.blocks import Block, ragged_index, text_blocks
from flowsentry.llm.pieces import PieceCache

_OPEN = np.int64(1) << 62
_POSITION_BITS = 8
#: Pieces up to this many bytes go through the arrays of trees.
_WIDEST = 64
#: The contractions of the published pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4

_LOADED: dict[str, Tokenizer] = {}
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _CLASSES:
        points = np.arange(0x110000)
        out = np.full(0x110000, _OTHER, dtype=np.uint8)
        valid = np.concatenate([points[:0xD800], points[0xE000:]]).astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
            for found in regex.finditer(pattern + "+", valid):
                a, b = ord(found[0][0]), ord(found[0][-1])
                if b - a + 1 == len(found[0]):
                    out[a : b + 1] = kind
                else:  # the run crosses the surrogates
                    out[[ord(c) for c in found[0]]] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pattern's matches in UTF-8 `data`; none crosses a document edge in `offsets`."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each code point
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, dtype=bool)  # documents' first code points
    edges = np.searchsorted(at, offsets)
    first[edges] = True
    first[n] = True
    new_run = first.copy()
    new_run[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new_run[:n])
    run_end = np.append(run[1:], n)
    run_kind = kind[run]
    cuts = np.zeros(n + 1, dtype=bool)
    cuts[run] = True
    cuts[n] = True

    # White space: its last code point is left for what follows in the document, and a blank there joins that.
    blank = run_kind == _SPACE
    last = run_end[blank] - 1
    followed = ~first[run_end[blank]]
    last = last[followed]
    cuts[last] = True
    joins = last[points[last] == 0x20]
    cuts[joins + 1] = False

    # Contractions: a lone apostrophe at a piece's start and the letters after it.
    apostrophe = run[(points[run] == 0x27) & (run_end - run == 1) & (run_kind == _OTHER)]
    apostrophe = apostrophe[cuts[apostrophe] & ~first[apostrophe + 1]]
    apostrophe = apostrophe[kind[np.minimum(apostrophe + 1, n - 1)] == _LETTER]
    if len(apostrophe):
        one = points[apostrophe + 1]
        inside = (apostrophe + 2 < n) & ~first[np.minimum(apostrophe + 2, n)]
        two = np.where(inside, points[np.minimum(apostrophe + 2, n - 1)], 0)
        taken = np.zeros(len(apostrophe), dtype=np.int64)
        for word in CONTRACTIONS:
            hit = (one == ord(word[0])) if len(word) == 1 else (one == ord(word[0])) & (two == ord(word[1]))
            taken[hit & (taken == 0)] = len(word)
        apostrophe, taken = apostrophe[taken > 0], taken[taken > 0]
        cuts[apostrophe + 1] = False
        cuts[apostrophe + 1 + taken] = True
    at = np.append(at, len(data))
    borders = at[np.flatnonzero(cuts)]
    return borders[:-1], borders[1:]


class _PairTable:
    """Rank of (left id, right id) in an open-addressing table of arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        rest = np.arange(len(keys))
        slot = self._slot(keys)
        while len(rest):
            free = self.keys[slot] == -1
            chosen, where = np.unique(slot[free], return_index=True)
            put = rest[free][where]
            self.keys[chosen], self.values[chosen] = keys[put], values[put]
            stay = ~np.isin(rest, put)
            rest, slot = rest[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.values[slot]
        found = self.keys[slot]
        out[found != keys] = -1
        rest = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            rest, slot = rest[go], slot[go]
        return out


class Tokenizer:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for word, rank in ranks.items():
            self.token[rank] = word
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, value = [], [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), value.append(rank)
        keys = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        self.pairs = _PairTable(keys, np.array(value, dtype=np.int64))
        self.pair_rank = dict(zip(keys.tolist(), value))
        joined = b"".join(self.token)
        self.token_bytes = np.frombuffer(joined, dtype=np.uint8)
        self.token_len = np.array([len(t) for t in self.token], dtype=np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        digits = [f"{i} ".encode() for i in range(self.size)]
        self.digits = np.zeros((self.size, max(map(len, digits))), dtype=np.uint8)
        for i, word in enumerate(digits):
            self.digits[i, : len(word)] = np.frombuffer(word, dtype=np.uint8)
        self.digits_len = np.array([len(d) for d in digits], dtype=np.int64)
        self._cache = PieceCache()

    # One piece -----------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece by a segment tree of its own."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, never, ranks, size = len(piece), 1 << 62, self.pair_rank, self.size
        width = 1 << max(1, (n - 1).bit_length())
        shift = width.bit_length()
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [never] * (2 * width)

        def key(at: int) -> int:
            nxt = after[at]
            rank = ranks.get(ids[at] * size + ids[nxt]) if nxt < n else None
            return never if rank is None else rank << shift | at

        for at in range(n):
            tree[width + at] = key(at)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] != never:
            at = tree[1] & ((1 << shift) - 1)
            gone = after[at]
            ids[at] = tree[1] >> shift
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, never)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    # Many pieces of one width -----------------------------------------------------------------

    def _encode_width(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in order, and each piece's count; `width` is a power of two, no piece longer."""
        m = len(starts)
        column = np.arange(width)
        inside = column[None, :] < lens[:, None]
        ids = self.byte_id[data[np.where(inside, starts[:, None] + column[None, :], 0)]]
        ids[~inside] = -1
        tree = np.full((m, 2 * width), _OPEN, dtype=np.int64)
        leaf = tree[:, width:]
        both = inside[:, 1:] & inside[:, :-1]
        found = self.pairs[(ids[:, :-1] * self.size + ids[:, 1:])[both]]
        keys = np.where(found >= 0, found << _POSITION_BITS | np.broadcast_to(column[:-1], both.shape)[both], _OPEN)
        leaf[:, :-1][both] = keys
        half = width
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        after = np.broadcast_to(column + 1, (m, width)).astype(np.int64).copy()
        before = np.broadcast_to(column - 1, (m, width)).astype(np.int64).copy()
        tree, flat_ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        live = np.flatnonzero(tree[1 :: 2 * width] < _OPEN)
        while len(live):
            root = tree[live * 2 * width + 1]
            at, base = root & ((1 << _POSITION_BITS) - 1), live * width
            gone = after[base + at]
            following = after[base + gone]
            flat_ids[base + at] = root >> _POSITION_BITS
            flat_ids[base + gone] = -1
            after[base + at] = following
            has_next = following < lens[live]
            before[(base + following)[has_next]] = at[has_next]
            previous = before[base + at]
            has_previous = previous >= 0
            rows = np.concatenate([live, live[has_next], live[has_previous]])
            places = np.concatenate([gone, at[has_next], previous[has_previous]])
            l, r = np.concatenate([at[has_next], previous[has_previous]]), np.concatenate([following[has_next], at[has_previous]])
            pair_rows = np.concatenate([live[has_next], live[has_previous]]) * width
            rank = self.pairs[flat_ids[pair_rows + l] * self.size + flat_ids[pair_rows + r]]
            no_next = live[~has_next], at[~has_next]
            rows, places = np.concatenate([rows, no_next[0]]), np.concatenate([places, no_next[1]])
            values = np.concatenate([np.full(len(live), _OPEN), np.where(rank >= 0, rank << _POSITION_BITS | l, _OPEN), np.full(len(no_next[0]), _OPEN)])
            offset, node = rows * (2 * width), places + width
            tree[offset + node] = values
            while node[0] > 1:
                node = node >> 1
                child = offset + 2 * node
                tree[offset + node] = np.minimum(tree[child], tree[child + 1])
            live = live[tree[live * 2 * width + 1] < _OPEN]
        ids = flat_ids.reshape(m, width)
        keep = ids >= 0
        return ids[keep].astype(np.int32), keep.sum(axis=1)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, count per piece) without the cache."""
        lens = ends - starts
        counts = np.zeros(len(starts), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (piece numbers, tokens)
        low, width = 0, 2
        while width <= _WIDEST:
            chosen = np.flatnonzero((lens > low) & (lens <= width))
            for some in np.array_split(chosen, max(1, len(chosen) * width // (1 << 20))) if len(chosen) else []:
                tokens, n = self._encode_width(data, starts[some], lens[some], width)
                counts[some] = n
                parts.append((np.repeat(some, n), tokens))
            low, width = width, width * 2
        for i in np.flatnonzero(lens > _WIDEST).tolist():
            tokens = np.array(self.encode_piece(data[starts[i] : ends[i]].tobytes()), dtype=np.int32)
            counts[i] = len(tokens)
            parts.append((np.full(len(tokens), i), tokens))
        if not parts:
            return np.zeros(0, dtype=np.int32), counts
        owner = np.concatenate([p[0] for p in parts])
        tokens = np.concatenate([p[1] for p in parts])
        # A piece that is a token by itself is that token, whatever its merges give.
        out = tokens[np.argsort(owner, kind="stable")]
        firsts = np.cumsum(counts) - counts
        several = np.flatnonzero(counts > 1)
        exact = {i: t for i in several.tolist() if (t := self.ranks.get(data[starts[i] : ends[i]].tobytes())) is not None}
        if exact:
            drop = np.zeros(len(out), dtype=bool)
            for i, t in exact.items():
                out[firsts[i]] = t
                drop[firsts[i] + 1 : firsts[i] + counts[i]] = True
                counts[i] = 1
            out = out[~drop]
        return out, counts

    # Blocks of documents ------------------------------------------------------------------------

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all documents in order, token count per document)."""
        starts, ends = split_pieces(block.data, block.offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(block), dtype=np.int64)
        ids, lens = self._cache.encode(block.data, starts, ends, self.encode_pieces)
        total = np.concatenate([[0], np.cumsum(lens)])
        upto = total[np.searchsorted(starts, block.offsets)]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as one array."""
        return self.token_bytes[ragged_index(self.token_start[ids], self.token_len[ids])]

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """Each id in decimal digits and a blank, as one array of bytes."""
        rows = self.digits[ids]
        return rows[rows > 0]


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<i4") -> DataFrame:
    """(doc_id, n_tokens, ids): each text's token ids as numbers of `dtype`, by default little-endian int32.

    Null text is empty and has no tokens. Repeated rows give repeated rows, an empty table an
    empty result. `vocabulary` is a rank file that every executor has at that path. Memory
    follows the block size or the longest text, never the partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                ids, counts = bpe.encode_block(block)
                ends = np.cumsum(counts)
                rows = [ids[e - c : e].astype(dtype).tobytes() for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text): the inverse of `encode_documents`; null ids decode to an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            rows = [bpe.decode(np.frombuffer(x or b"", dtype="<i4")).tobytes().decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, and of what they decode to.

    Rows, nulls and memory as in `encode_documents`; the ids never leave the task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                ids, counts = bpe.encode_block(block)
                digits, text = bpe.decimal(ids), bpe.decode(ids)
                borders = np.concatenate([[0], np.cumsum(counts)])
                digit_at = np.concatenate([[0], np.cumsum(bpe.digits_len[ids])])[borders].tolist()
                text_at = np.concatenate([[0], np.cumsum(bpe.token_len[ids])])[borders].tolist()
                spelled = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(digit_at, digit_at[1:])]
                decoded = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(text_at, text_at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(counts, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
