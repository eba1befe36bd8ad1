"""BPE of a merges file by tree concatenation.

Text that nothing splits is encoded by halves: leaves of some dozens of bytes at once, then
neighbours are joined level by level. A join re-encodes a window of tokens around the border
and widens it until the window begins with the left side's token and ends with the right
side's. As the pairs of neighbours at both edges then stand as in the parts, and a sequence of
tokens is an encoding exactly if each pair of neighbours is, the joined tokens are those of the
whole.

The same is done one level up. A long document is cut into parts wherever a part ends, whatever
stands there; tasks encode the parts, and the parts are joined in order: the pattern is applied
again around each border until a cut falls together with one of the right part (from a common
cut on, the pattern goes on alike), and a piece that runs over the border is joined as above.

Special strings of the vocabulary are taken out first, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.blocks import ragged_index, text_blocks
from flowsentry.llm.bpe import _PairTable, split_pieces
from flowsentry.llm.pieces import PieceCache

#: Unsplit text of more bytes is encoded by halves.
LEAF = 32
#: Tokens on each side of a border in the first window of a join.
WINDOW = 4
#: Bytes of a part; a longer document is encoded by several tasks.
PART_BYTES = 1 << 16
#: Pieces before the end of a text that what follows may still change: a lone apostrophe, its letters, white space.
_OPEN_PIECES = 3

_LOADED: dict[str, TreeTokenizer] = {}


def _printable_bytes() -> dict[str, int]:
    """The published printable stand-in of each byte: itself if visible, else the next code point from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoded:
    """Text (bytes) cut into pieces: `starts` of the pieces, `counts` of their tokens, `ids` of all tokens."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.data, self.starts, self.counts, self.ids = data, starts, counts, ids

    def tokens(self, piece: int) -> list[int]:
        first = int(self.counts[:piece].sum())
        return self.ids[first : first + int(self.counts[piece])].tolist()


class TreeTokenizer:
    """Encodes and decodes with one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("a byte-level BPE without normalizer, prefix space, unknown token or affixes is asked for")
        byte_of = _printable_bytes()
        spelled = lambda word: bytes(byte_of[c] for c in word)
        vocabulary = model["vocab"]
        self.size = max([*vocabulary.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.token = [b""] * self.size
        for word, i in vocabulary.items():
            self.token[i] = spelled(word)
        self.special: dict[bytes, int] = {}
        for added in spec["added_tokens"]:
            if added["single_word"] or added["lstrip"] or added["rstrip"]:
                raise ValueError("special strings that look at their neighbours are not supported")
            self.special[added["content"].encode()] = added["id"]
            self.token[added["id"]] = added["content"].encode()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for char, b in byte_of.items():
            self.byte_id[b] = vocabulary[char]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in side], dtype=np.int64) for side in zip(*((a, b, a + b) for a, b in rules)))
        keys = left * self.size + right
        #: Rank of a pair, and the token that it makes.
        self.rank = {key: (rank, token) for rank, (key, token) in enumerate(zip(keys.tolist(), made.tolist()))}
        self.pairs = _PairTable(keys, np.arange(len(keys)))
        self.made = made
        self.token_bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.token_len = np.array([len(t) for t in self.token], dtype=np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self._cache = PieceCache()

    # Unsplit text ------------------------------------------------------------------------------

    def _leaves(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, count) of ranges of up to LEAF bytes: all of them merge their least pair together, again and again."""
        lens = ends - starts
        counts = np.zeros(len(starts), dtype=np.int64)
        owners, found = [], []
        low, width = 0, 1
        while low < LEAF:
            chosen = np.flatnonzero((lens > low) & (lens <= width))
            for some in np.array_split(chosen, len(chosen) * width // (1 << 20) + 1) if len(chosen) else []:
                column = np.arange(width)
                inside = column < lens[some][:, None]
                ids = np.where(inside, self.byte_id[data[np.where(inside, starts[some][:, None] + column, 0)]], -1)
                live = np.arange(len(some))
                while width > 1 and len(live):
                    row = ids[live]
                    both = row[:, 1:] >= 0
                    rank = np.full(both.shape, len(self.made), dtype=np.int64)
                    got = self.pairs[(row[:, :-1] * self.size + row[:, 1:])[both]]
                    rank[both] = np.where(got >= 0, got, len(self.made))
                    at = rank.argmin(axis=1)  # the leftmost of the least
                    best = rank[np.arange(len(live)), at]
                    go = best < len(self.made)
                    live, at, row = live[go], at[go], row[go]
                    row[np.arange(len(live)), at] = self.made[best[go]]
                    row[:, :-1] = np.where(column[:-1] > at[:, None], row[:, 1:], row[:, :-1])
                    row[:, -1] = -1
                    ids[live] = row
                keep = ids >= 0
                counts[some] = keep.sum(axis=1)
                owners.append(np.repeat(some, counts[some]))
                found.append(ids[keep])
            low, width = width, width * 2
        if not owners:
            return np.zeros(0, dtype=np.int64), counts
        return np.concatenate(found)[np.argsort(np.concatenate(owners), kind="stable")], counts

    def merge_all(self, text: bytes) -> list[int]:
        """Tokens of unsplit text by a heap of its pairs: what windows are re-encoded with."""
        n, ids = len(text), self.byte_id[np.frombuffer(text, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, size = self.rank, self.size
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, token = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = token, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rank.get(token * size + ids[k]):
                    heapq.heappush(heap, (r[0], i, token, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] * size + token)):
                heapq.heappush(heap, (r[0], h, ids[h], token, r[1]))
        return [t for t in ids if t >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring parts of unsplit text from the tokens of each."""
        if not left or not right:
            return left + right
        reach = WINDOW
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge_all(b"".join([self.token[t] for t in left[a:]] + [self.token[t] for t in right[:b]]))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            reach *= 2

    def unsplit(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, count) of ranges of any length that the pattern does not split."""
        lens = ends - starts
        leaves = np.maximum(1, -(-lens // LEAF))
        first = np.cumsum(leaves) - leaves
        k = np.arange(int(leaves.sum())) - np.repeat(first, leaves)
        span, parts = np.repeat(lens, leaves), np.repeat(leaves, leaves)
        base = np.repeat(starts, leaves)
        tokens, counts = self._leaves(data, base + span * k // parts, base + span * (k + 1) // parts)
        several = np.flatnonzero(leaves > 1)
        if not len(several):
            return tokens, counts
        borders = np.concatenate([[0], np.cumsum(counts)])
        out = np.split(tokens, borders[first[1:]]) if len(first) > 1 else [tokens]
        for i in several.tolist():
            at = borders[first[i] : first[i] + leaves[i] + 1]
            level = [tokens[x:y].tolist() for x, y in zip(at, at[1:])]
            while len(level) > 1:
                odd = level[len(level) & ~1 :]
                level = [self.join(x, y) for x, y in zip(level[::2], level[1::2])] + odd
            out[i] = np.array(level[0], dtype=np.int64)
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    # Whole texts -------------------------------------------------------------------------------

    def _special_ranges(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special strings: the leftmost first, of several there the longest; none overlap."""
        text, found, at = data.tobytes(), [], 0
        ahead = {word: text.find(word) for word in self.special}
        while any(place >= 0 for place in ahead.values()):
            place, _, word = min((p, -len(w), w) for w, p in ahead.items() if p >= 0)
            found.append((place, place + len(word), self.special[word]))
            at = place + len(word)
            ahead = {w: p if p >= at or p < 0 else text.find(w, at) for w, p in ahead.items()}
        return found

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, special id or -1) of the pieces of the documents data[offsets[i]:offsets[i + 1]]."""
        ranges = self._special_ranges(data)
        # A special string is one only inside a document.
        inner = [r for r in ranges if np.searchsorted(offsets, r[0], side="right") == np.searchsorted(offsets, r[1], side="left")]
        if len(inner) < len(ranges):  # borders hide some: look in each document
            inner = [(int(a) + x, int(a) + y, i) for a, b in zip(offsets, offsets[1:]) for x, y, i in self._special_ranges(data[a:b])]
        if not inner:
            starts, ends = split_pieces(data, offsets)
            return starts, ends, np.full(len(starts), -1)
        edges = np.array([x for r in inner for x in r[:2]], dtype=np.int64)
        starts, ends = split_pieces(data, np.sort(np.concatenate([offsets, edges])))
        a, b, ids = (np.array(x, dtype=np.int64) for x in zip(*inner))
        within = np.searchsorted(a, starts, side="right") - 1
        covered = (within >= 0) & (starts < b[np.maximum(within, 0)])
        lead = covered & (starts == a[np.maximum(within, 0)])
        kind = np.where(lead, ids[np.maximum(within, 0)], -1)
        ends = np.where(lead, b[np.maximum(within, 0)], ends)
        keep = ~covered | lead
        return starts[keep], ends[keep], kind[keep]

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, count) of pieces; `kind` holds the id of a special string, else -1."""
        ids, counts = self._cache.encode(data, starts, ends, self.unsplit)
        if (kind >= 0).any():
            owner = np.repeat(np.arange(len(starts)), counts)
            keep = kind[owner] < 0
            own = np.flatnonzero(kind >= 0)
            order = np.argsort(np.concatenate([owner[keep], own]), kind="stable")
            ids = np.concatenate([ids[keep], kind[own].astype(ids.dtype)])[order]
            counts = np.where(kind >= 0, 1, counts)
        return ids, counts

    def encode_documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all documents in order, count per document)."""
        starts, ends, kind = self.split(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets) - 1, dtype=np.int64)
        ids, counts = self.pieces(data, starts, ends, kind)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def encode_part(self, data: np.ndarray) -> Encoded:
        starts, ends, kind = self.split(data, np.array([0, len(data)]))
        ids, counts = self.pieces(data, starts, ends, kind)
        return Encoded(data, starts, counts, ids)

    def join_parts(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of two neighbouring parts of a document from those of both; no border stands in a special string."""
        n, reach = len(left.data), _OPEN_PIECES
        while True:
            a = max(0, len(left.starts) - reach)
            at = int(left.starts[a]) if len(left.starts) else 0
            whole = reach >= len(right.starts)
            upto = len(right.data) if whole else int(right.starts[reach])
            window = np.concatenate([left.data[at:], right.data[:upto]])
            starts, ends, kind = self.split(window, np.array([0, len(window)]))
            # What the window's end may still change is no common cut, unless the text ends there.
            sure = np.append(starts, len(window)) if whole else starts[: max(0, len(starts) - _OPEN_PIECES)]
            cuts = sure[sure >= n - at] + at - n
            common = np.intersect1d(cuts, np.append(right.starts, len(right.data)))
            if len(common):
                break
            reach *= 2
        cut = int(common[0])
        some = starts < n - at + cut
        starts, ends, kind = starts[some], ends[some], kind[some]
        tail = int(np.searchsorted(right.starts, cut))
        ids, counts = [], []
        for s, e, k in zip(starts.tolist(), ends.tolist(), kind.tolist()):
            over = k < 0 and s < n - at < e and e - s > LEAF
            if over and s + at == left.starts[-1] and tail == 1 and e - (n - at) == cut:
                own = self.join(left.tokens(len(left.starts) - 1), right.tokens(0))  # a piece that runs over the border
            elif k >= 0:
                own = [k]
            else:
                own = self.unsplit(window, np.array([s]), np.array([e]))[0].tolist()
            ids += own
            counts.append(len(own))
        before, gone = int(left.counts[:a].sum()), int(right.counts[:tail].sum())
        return Encoded(
            np.concatenate([left.data, right.data]),
            np.concatenate([left.starts[:a], starts + at, right.starts[tail:] + n]),
            np.concatenate([left.counts[:a], np.array(counts, dtype=np.int64), right.counts[tail:]]),
            np.concatenate([left.ids[:before], np.array(ids, dtype=left.ids.dtype), right.ids[gone:]]),
        )

    def part_borders(self, data: np.ndarray, part_bytes: int) -> list[int]:
        """Borders of the parts of a text: on code points, in no special string, else blind."""
        longest = max(map(len, self.special), default=1)
        borders, at = [0], 0
        while len(data) - at > part_bytes:
            cut = at + part_bytes
            while cut > at + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            low = max(at, cut - longest)
            for a, b, _ in self._special_ranges(data[low : cut + longest]):
                if low + a < cut < low + b:
                    cut = low + b
            borders.append(cut)
            at = cut
        return [*borders, len(data)] if borders[-1] < len(data) else borders

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, special ones included, as one array."""
        return self.token_bytes[ragged_index(self.token_start[ids], self.token_len[ids])]

    def text(self, ids: np.ndarray) -> bytes:
        """decode() as text: bytes that are no UTF-8 become the replacement character."""
        raw = self.decode(ids).tobytes()
        return raw.decode("utf-8", errors="replace").encode()


def tree_tokenizer(path: str) -> TreeTokenizer:
    """The tokenizer of a vocabulary file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = TreeTokenizer(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids): each text's token ids as little-endian int32 bytes.

    `vocabulary` is a tokenizers file that every executor has at that path. A text of more than
    `part_bytes` is encoded by several tasks. Null text is empty and has no tokens; special
    strings in a text become their ids; repeated rows give repeated rows, an empty table an empty
    result; a null id is an id like others; other columns are not read.
    """
    return _encode(docs, vocabulary, id_col, text_col, part_bytes, lambda bpe, ids: (ids.astype("<i4").tobytes(),), "ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text): the inverse of `encode_documents`; null ids decode to an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_tokenizer(vocabulary)
        for batch in batches:
            rows = [bpe.text(np.frombuffer(x or b"", dtype="<i4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids (decimal, joined by commas) and of what they decode to.

    Rows, nulls and long texts as in `encode_documents`; the ids of a short text never leave its task.
    """

    def digests(bpe: TreeTokenizer, ids: np.ndarray) -> tuple[str, str]:
        return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(bpe.text(ids)).hexdigest()

    return _encode(docs, vocabulary, id_col, text_col, part_bytes, digests, "ids_sha256 string, decoded_sha256 string")


def _encode(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, part_bytes: int, finish, columns: str) -> DataFrame:
    """(doc_id, n_tokens, what `finish` makes of the tokenizer and a document's ids)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_tokens long, {columns}"
    long_text = F.octet_length("text") > part_bytes

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_tokenizer(vocabulary)
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                ids, counts = bpe.encode_documents(block.data, block.offsets)
                ends = np.cumsum(counts)
                rows = [finish(bpe, ids[e - c : e]) for c, e in zip(counts.tolist(), ends.tolist())]
                yield _batch([batch.column(0).slice(block.first, len(block)), pa.array(counts, pa.int64())], rows, result)

    short = base.where(long_text.isNull() | ~long_text).mapInArrow(whole, result)

    # Equal rows are encoded once; parts are numbered within (id, digest of the text).
    long_rows = base.where(long_text).withColumn("name", F.sha2("text", 256))
    copies = long_rows.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
    once = long_rows.dropDuplicates(["doc_id", "name"])

    def cut_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_tokenizer(vocabulary)
        for batch in batches:
            for i in range(len(batch)):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8)
                borders = bpe.part_borders(data, part_bytes)
                n = len(borders) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array([batch.column(1)[i].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()),
                     pa.array([data[a:b].tobytes() for a, b in zip(borders, borders[1:])], pa.binary())],
                    ["doc_id", "name", "part", "data"],
                )

    part_columns = f"doc_id {kind}, name string, part int, data binary"
    parts = once.select("doc_id", "name", "text").mapInArrow(cut_parts, part_columns)

    def encode_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_tokenizer(vocabulary)
        for batch in batches:
            done = [bpe.encode_part(np.frombuffer(x.as_buffer(), dtype=np.uint8)) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([getattr(d, k).astype("<i4").tobytes() for d in done], pa.binary()) for k in ("starts", "counts", "ids"))],
                [*batch.schema.names, "starts", "counts", "ids"],
            )

    encoded = parts.repartition("doc_id", "name", "part").mapInArrow(encode_parts, f"{part_columns}, starts binary, counts binary, ids binary")

    def join_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_tokenizer(vocabulary)
        numbers = lambda x: np.frombuffer(x, dtype="<i4").astype(np.int64)
        name, open_part, done = None, None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if name is not None:
                ids = np.concatenate([*done, open_part.ids])
                yield _batch([pa.array([name[0]], id_type), pa.array([name[1]], pa.string()), pa.array([len(ids)], pa.int64())], [finish(bpe, ids)], joined_columns)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, digest, part, data, starts, counts, ids in zip(*(c.to_pylist() for c in batch.columns)):
                right = Encoded(np.frombuffer(data, dtype=np.uint8), numbers(starts), numbers(counts), numbers(ids))
                if name != (doc_id, digest):
                    yield from closed()
                    name, open_part, done = (doc_id, digest), right, []
                    continue
                # Only the last pieces can change: those before are done.
                keep = max(0, len(open_part.starts) - 2 * _OPEN_PIECES)
                first, at = int(open_part.counts[:keep].sum()), int(open_part.starts[keep])
                done.append(open_part.ids[:first])
                rest = Encoded(open_part.data[at:], open_part.starts[keep:] - at, open_part.counts[keep:], open_part.ids[first:])
                open_part = bpe.join_parts(rest, right)
        yield from closed()

    joined_columns = f"doc_id {kind}, name string, n_tokens long, {columns}"
    joined = encoded.repartition("doc_id", "name").sortWithinPartitions("doc_id", "name", "part").mapInArrow(join_all, joined_columns)
    again = joined.alias("j").join(copies.alias("c"), F.col("j.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("j.name") == F.col("c.name")))
    repeated = again.select("j.*", F.explode(F.array_repeat(F.lit(1), F.col("c.n").cast("int"))).alias("_")).drop("name", "_")
    return short.unionByName(repeated)


def _batch(first: list[pa.Array], rows: list[tuple], result: str) -> pa.RecordBatch:
    """A record batch of the arrays `first` and the columns of `rows`, named and typed as in `result`."""
    named = [c.strip().split(" ") for c in result.split(",")]
    kinds = {"string": pa.string(), "binary": pa.binary()}
    rest = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(named[len(first) :])]
    return pa.RecordBatch.from_arrays([*first, *rest], [name for name, _ in named])
