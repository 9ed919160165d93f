"""Byte-level BPE encoding and decoding.

Each pre-token is merged over a segment tree whose leaves hold the merge ranks of adjacent pairs. The root yields the
lowest rank, the walk down to it the leftmost pair of that rank; a merge changes three leaves, each in logarithmic
time, until the root holds no rank. The short pre-tokens of a slice of texts are merged together, one tree in each row
of an array; a long one has a tree of its own. Results of short pre-tokens are kept in a table of at most
``TABLE_BYTES``, and texts are worked on in slices, so a worker's memory is bounded whatever the texts hold (but for one
text and its ids).

Texts are handled row by row in Arrow batches: no shuffle, no state between rows. The encoder counts as not
deterministic for Spark's optimiser, which would otherwise repeat it for each column that is made from the ids; ids and
texts themselves are always the same. Null text encodes as no tokens, as does empty text; null ids decode to null.
Repeated rows are coded each; an empty table gives an empty result; columns with the names of outputs are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 30
# The same pattern with its classes written out for texts of Latin-1 characters alone, which the plain engine splits faster.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Bytes of the table of pre-tokens (a Python entry takes about ``ENTRY_BYTES`` besides its characters and ids), the longest
#: pre-token in it, characters of texts worked on together, and rows of trees worked on together.
TABLE_BYTES, ENTRY_BYTES, SHORT, SLICE_CHARS, TREE_ROWS = 24 << 20, 200, 32, 500_000, 16_384


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary(dict):
    """A vocabulary file's merges and tokens; as a mapping, the packed ids of pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.merged.append(vocab[a + b])
        self.first = [0] * 256
        for ch, b in alphabet.items():
            self.first[b] = vocab[ch]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[ch] for ch in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.any_pieces, self.latin_pieces = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.keys = np.array(sorted(self.rank), np.int64)
        self.key_ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int32)
        self.keys, self.key_ranks = np.append(self.keys, np.int64(1) << 62), np.append(self.key_ranks, np.int32(NO_RANK))
        self.merged_ids, self.first_ids = np.array(self.merged, np.int32), np.array(self.first, np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def __missing__(self, piece: str) -> bytes:
        """A pre-token that isn't in the table: a long one."""
        return np.array(self.merge([self.first[b] for b in piece.encode()]), "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any_pieces(text)
        return self.latin_pieces(text)

    def learn(self, pieces: set[str]) -> None:
        """Merge the short ones of ``pieces`` that the table lacks and put them there."""
        new = [p for p in pieces if p not in self]
        size = sum(map(len, new)) * 3 + len(new) * ENTRY_BYTES
        if self.held + size > TABLE_BYTES:
            self.clear()
            self.held, new = 0, list(pieces)
            size = sum(map(len, new)) * 3 + len(new) * ENTRY_BYTES
        self.held += size
        raw = [p.encode() for p in new]
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) <= SHORT:
                by_size.setdefault(max(1, len(b) - 2).bit_length(), []).append(i)
        for which in by_size.values():
            for at in range(0, len(which), TREE_ROWS):
                part = which[at : at + TREE_ROWS]
                for i, packed in zip(part, self.merge_all([raw[i] for i in part])):
                    self[new[i]] = packed

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; ids below zero have none."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.key_ranks[at], NO_RANK).astype(np.int32)

    def merge_all(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of short pre-tokens: a segment tree in each row, all of one size, worked on together."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        size = 1 << max(1, int(n.max()) - 1 - 1).bit_length() if n.max() > 2 else 2
        ids = np.full((len(raw), size + 2), -1, np.int32)  # a column more than pairs, and one that ends chains
        inside = np.arange(size + 2) < n[:, None]
        ids[inside] = self.first_ids[np.frombuffer(b"".join(raw), np.uint8)]
        tree = np.empty((len(raw), 2 * size), np.int32)
        tree[:, size:] = self.ranks(ids[:, :size].ravel(), ids[:, 1 : size + 1].ravel()).reshape(-1, size)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        end = size + 1
        after = np.minimum(np.arange(1, size + 3, dtype=np.int32), end)[None].repeat(len(raw), 0)
        before = np.arange(-1, size + 1, dtype=np.int32)[None].repeat(len(raw), 0)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            at = at + size
            tree[rows, at] = value
            level = size
            while level > 1:
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                level >>= 1

        rows = np.flatnonzero(tree[:, 1] < NO_RANK)
        while len(rows):
            low, at = tree[rows, 1], np.ones(len(rows), np.int64)
            level = 1
            while level < size:
                at *= 2
                at += tree[rows, at] != low
                level *= 2
            at -= size
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = self.merged_ids[low]
            ids[rows, gone] = -1
            after[rows, at] = then
            before[rows, then] = at
            leaf = gone < size
            put(rows[leaf], gone[leaf], NO_RANK)
            put(rows, at, self.ranks(ids[rows, at], ids[rows, then]))
            left = before[rows, at]
            has = left >= 0
            put(rows[has], left[has], self.ranks(ids[rows[has], left[has]], ids[rows[has], at[has]]))
            rows = rows[tree[rows, 1] < NO_RANK]
        live = ids >= 0
        packed, ends = ids[live].astype("<u4").tobytes(), (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge one pre-token's ids in place of rank order, leftmost first."""
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.rank.get, self.merged
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NO_RANK] * (2 * size)
        tree[size : size + n - 1] = [rank(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while (low := tree[1]) < NO_RANK:
            i = 1
            while i < size:
                i *= 2
                if tree[i] != low:
                    i += 1
            i -= size
            j = after[i]
            k = after[j]
            ids[i] = merged[low]
            after[i] = k
            if j < n - 1:
                put(j, NO_RANK)
            if k < n:
                before[k] = i
                put(i, rank(ids[i] << 32 | ids[k], NO_RANK))
            else:
                put(i, NO_RANK)
            if (p := before[i]) >= 0:
                put(p, rank(ids[p] << 32 | ids[i], NO_RANK))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Special tokens' strings become those tokens."""
        get, texts = self.__getitem__, iter(texts)
        for text in texts:
            parts, chars = [], 0  # of each text; a part is a list of pre-tokens or a special token's packed id
            while text is not None:
                if self.split is None or not any(s in text for s in self.special):
                    parts.append([self.pieces(text)])
                else:
                    parts.append([self.special[p].to_bytes(4, "little") if p in self.special else self.pieces(p) for p in self.split(text) if p])
                chars += len(text)
                text = next(texts, None) if chars < SLICE_CHARS else None
            seen: set[str] = set()
            for own in parts:
                for p in own:
                    if isinstance(p, list):
                        seen.update(p)
            self.learn(seen)
            for own in parts:
                yield b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in own)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_column(text: Column, path: str) -> Column:
    """Packed ids (binary, little-endian unsigned 32-bit) of a text column; null counts as empty."""

    @F.arrow_udf("binary")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        return pa.array(vocabulary(path).encode_all(t.as_py() or "" for t in texts), pa.binary())

    return bpe_encode.asNondeterministic()(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of packed ids; ill-formed UTF-8 decodes to replacement characters. Null gives null."""

    @F.arrow_udf("string")
    def bpe_decode(packed: pa.Array) -> pa.Array:
        decode = vocabulary(path).decode
        return pa.array([None if (b := p.as_py()) is None else decode(b) for p in packed], pa.string())

    return bpe_decode(ids)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with packed ids and their number. Columns that already have these names are replaced."""
    return df.withColumn(ids, encode_column(F.col(text), path)).withColumn(count, (F.octet_length(ids) / 4).cast("long"))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed ids."""
    return df.withColumn(out, decode_column(F.col(ids), path))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", out: str = "decoded") -> DataFrame:
    """As ``decode`` of ``encode``, in one pass through Python: a text goes there and its ids and their text come back."""

    @F.arrow_udf("ids binary, decoded string")
    def bpe_encode_decode(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        coded = list(v.encode_all(t.as_py() or "" for t in texts))
        return pa.StructArray.from_arrays([pa.array(coded, pa.binary()), pa.array(map(v.decode, coded), pa.string())], ["ids", "decoded"])

    both = df.withColumn("__coded", bpe_encode_decode.asNondeterministic()(F.col(text)))
    return both.withColumn(ids, F.col("__coded.ids")).withColumn(out, F.col("__coded.decoded")).withColumn(count, (F.octet_length(ids) / 4).cast("long")).drop("__coded")


def unpack(ids: str = "token_ids") -> Column:
    """Packed ids as ``array<int>``."""

    @F.arrow_udf("array<int>")
    def bpe_unpack(packed: pa.Array) -> pa.Array:
        return pa.array([None if (b := p.as_py()) is None else np.frombuffer(b, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))

    return bpe_unpack(F.col(ids))


def token_lists(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """As ``encode``, with the ids as ``array<int>`` straight from the encoder."""

    @F.arrow_udf("array<int>")
    def bpe_encode_lists(texts: pa.Array) -> pa.Array:
        packed = list(vocabulary(path).encode_all(t.as_py() or "" for t in texts))
        ends = np.cumsum([0, *(len(b) // 4 for b in packed)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return df.withColumn(ids, bpe_encode_lists.asNondeterministic()(F.col(text))).withColumn(count, F.size(ids).cast("long"))
