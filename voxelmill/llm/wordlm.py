"""Language-model scoring by cross-entropy difference over word n-grams.

Two models of order ``ORDER``, one smoothing and one vocabulary (the corpus's distinct words and an end mark) are counted
over the whole corpus: the background over every document, the target over the documents of a target table. Words stand
between ASCII whitespace; n-grams are known by hashes of ``HASH_BITS`` bits (among
10^10 n-grams of an order, one in a million shares its counts with another). Each order's estimate is mixed with the next lower one
(Dirichlet prior of weight ``PRIOR``), down to the uniform. A document's score is the mean over its tokens of the target's
loss less the background's: low scores are like the target. A document is rated by models that leave it out
(``leave_one_out``): its own n-grams are taken from the counts, so that targets aren't rated by what they were counted in.

Rows are dealt into hash buckets by id and text, so neither a null nor a repeated id gathers different texts; texts are
shuffled once, compressed. A bucket counts its distinct n-grams and sends them, sorted and packed, a row for each range
of hashes it has; a range adds up its buckets' counts and answers each bucket in the order it asked (beyond ``FAN`` ranges
by way of parties of buckets, see ``exchange``). The bucket counts its texts again and adds the answers. Nothing of the models goes to the driver; three totals go to all tasks.

Null and empty texts have one token, the end. Repeated rows count each; documents named more than once by the target
table count once in the target for each of their rows. Without any target document the target model is uniform. A null
doc_id is in no target. Input columns with the names of outputs are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.session import bucket_count

ORDER, PRIOR, START, END, SLICE_TOKENS, TABLE_WORDS, HASH_BITS, FAN = 3, 20.0, 1, 2, 500_000, 200_000, 54, 8192
ASKED, ANSWERED = "range int, bucket int, keys binary, n binary, n_target binary", "bucket int, range int, n binary, n_target binary, tokens long, tokens_target long, vocabulary long"


class _Words(dict):
    """Hashes of words, in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = h
        return h


def _fold(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context's hash and the word after it."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _key(h: np.ndarray, order: int) -> np.ndarray:
    return ((h >> np.uint64(62 - HASH_BITS) & ~np.uint64(3)) | np.uint64(order)).view(np.int64)


START_KEY, END_KEY = (int(_key(_fold(np.zeros(1, np.uint64), np.array([w], np.uint64)), 1)[0]) for w in (START, END))


def grams(texts: list[str | None], table: _Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each order over the texts one after the other (start marks, words, end mark), the place of each text's
    first token and its number of tokens. A key of order k is that of the k words that end at its place."""
    words = [(t or "").encode().split() for t in texts]
    size = np.array([len(w) + 1 for w in words], np.int64)
    marks = ORDER - 1
    at = np.cumsum(size + marks) - size
    raw = np.full(int(size.sum()) + marks * len(texts), START, np.uint64)
    for a, own in zip(at.tolist(), words):
        raw[a : a + len(own)] = np.fromiter(map(table.__getitem__, own), np.uint64, len(own))
        raw[a + len(own)] = END
    h, out = np.zeros(len(raw), np.uint64), []
    for order in range(1, ORDER + 1):
        h = _fold(np.concatenate([[np.uint64(0)], h[:-1]]) if order > 1 else h, raw)
        out.append(_key(h, order))
    return out, at, size


def _pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Compressed integers; ``rising`` ones by their steps. Equal bytes of all values lie together."""
    raw = np.diff(values, prepend=values[:1] * 0) if rising else values
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(packed: bytes, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8")[:, 0]
    return np.cumsum(values) if rising else values


def _packed_text(text):
    """Compressed text, for a shuffle."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=3)
        return pa.array([None if (t := x.as_py()) is None else z.compress(t.encode()) for x in texts], pa.binary())

    return pack(text)


class _Bucket:
    """A bucket's documents, read a slice at a time; marks tell which ids are targets."""

    def __init__(self, rows: pa.Table):
        marked = rows["mark"].to_numpy(zero_copy_only=False)
        self.docs = rows.filter(pa.array(~marked))
        chosen = set(rows["id"].filter(pa.array(marked)).to_pylist())
        self.target = np.array([i in chosen for i in self.docs["id"].to_pylist()], bool)

    def slices(self):
        """Texts, and which of them are targets, of about ``SLICE_TOKENS`` words of six bytes."""
        z, texts, first, size = zstandard.ZstdDecompressor(), [], 0, 0
        for k, b in enumerate(self.docs["text"]):
            texts.append(None if (raw := b.as_py()) is None else z.decompress(raw).decode())
            size += len(texts[-1] or "") // 6 + 1
            if size >= SLICE_TOKENS:
                yield texts, self.target[first : k + 1]
                texts, first, size = [], k + 1, 0
        if texts:
            yield texts, self.target[first:]

    def grams(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """As ``grams`` over all texts, read slice by slice."""
        table, parts, before = _Words(), [], 0
        for texts, _ in self.slices():
            keys, first, size = grams(texts, table)
            parts.append((keys, first + before, size))
            before += len(keys[0])
        if not parts:
            return [np.zeros(0, np.int64)] * ORDER, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return [np.concatenate([p[0][k] for p in parts]) for k in range(ORDER)], *(np.concatenate([p[k] for p in parts]) for k in (1, 2))


class _Tally:
    """Distinct keys of a bucket in their order, from one stable sort of the places that count.

    Places of one key lie together, and among them those of one document: ``own`` is how often it holds the key."""

    def __init__(self, bucket: _Bucket):
        keys, self.first, self.size = bucket.grams()
        length = self.size + ORDER - 1
        place = np.arange(int(length.sum())) - np.repeat(self.first - (ORDER - 1), length)
        # of the marks only the last is a context, counted once a text
        self.where = [np.flatnonzero(place >= (ORDER - 2 if order < ORDER else ORDER - 1)) for order in range(1, ORDER + 1)]
        document = np.repeat(np.arange(len(length), dtype=np.int32), length)
        all_keys = np.concatenate([k[w] for k, w in zip(keys, self.where)])
        documents = np.concatenate([document[w] for w in self.where])
        self.places = len(place)
        del keys, place
        self.order = np.argsort(all_keys, kind="stable")
        sorted_keys, documents = all_keys[self.order], documents[self.order]
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        at = np.flatnonzero(new)
        self.key = sorted_keys[at]
        self.n = np.diff(at, append=len(new))
        self.target = np.add.reduceat(bucket.target[documents].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        self.new, self.documents = new, documents

    def at_places(self, values: np.ndarray) -> list[np.ndarray]:
        """Values of the sorted places, by order of the key and place (0 where a place doesn't count)."""
        flat = np.empty(len(self.order))
        flat[self.order] = values
        out, a = [], 0
        for w in self.where:
            v = np.zeros(self.places)
            v[w] = flat[a : a + len(w)]
            out.append(v)
            a += len(w)
        return out

    def own(self) -> np.ndarray:
        new = self.new.copy()
        new[1:] |= self.documents[1:] != self.documents[:-1]
        n = np.diff(np.flatnonzero(new), append=len(new))
        return np.repeat(n, n)


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Number of each key's range; it rises with the key."""
    return (key >> 28) * ranges >> HASH_BITS + 2 - 28


def _messages(to: np.ndarray, sender: int, key: np.ndarray, n: np.ndarray, target: np.ndarray) -> pa.Table:
    """A row for each value of ``to``, which rises with the keys."""
    starts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
    rows = [(int(to[a]), sender, _pack(key[a:b], True), _pack(n[a:b]), _pack(target[a:b])) for a, b in zip(starts, [*starts[1:], len(to)])]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["range", "bucket", "keys", "n", "n_target"])


def _ask(ranges: int, width: int):
    def ask(rows: pa.Table) -> pa.Table:
        """A row for each ``width`` neighbouring ranges of keys in which the bucket has any."""
        tally = _Tally(_Bucket(rows))
        return _messages(_range_of(tally.key, ranges) // width, rows["bucket"][0].as_py(), tally.key, tally.n, tally.target)

    return ask


class _Met:
    """Messages that meet: their distinct keys with sums, and where each message's keys stand among them."""

    def __init__(self, asked: pa.Table):
        keys = [_unpack(b.as_py(), True) for b in asked["keys"]]
        self.own = [(_unpack(a.as_py()), _unpack(b.as_py())) for a, b in zip(asked["n"], asked["n_target"])]
        self.key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        self.n, self.target = (np.bincount(inverse, np.concatenate([o[k] for o in self.own]), len(self.key)).astype(np.int64) for k in (0, 1))
        self.places = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        self.senders, self.ranges = asked["bucket"].to_pylist(), asked["range"].to_pylist()

    def answers(self, n: np.ndarray, target: np.ndarray, totals: tuple[int, int, int]) -> pa.Table:
        """To each sender what others hold of its keys, of ``n`` and ``target`` in all; the totals stand in the first row."""
        rows = [(b, r, _pack(n[at] - a), _pack(target[at] - t), *(totals if not k else (0, 0, 0))) for k, (b, r, at, (a, t)) in enumerate(zip(self.senders, self.ranges, self.places, self.own))]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "range", "n", "n_target", "tokens", "tokens_target", "vocabulary"])


def _answer(asked: pa.Table) -> pa.Table:
    """What other senders of a range hold of each asked key, with the range's totals."""
    met = _Met(asked)
    word = ((met.key & 3) == 1) & (met.key != START_KEY)
    return met.answers(met.n, met.target, (int(met.n[word].sum()), int(met.target[word].sum()), int(word.sum())))


def _merge(ranges: int):
    def merge(asked: pa.Table) -> pa.Table:
        """What a party's buckets ask of neighbouring ranges, a row for each range."""
        met = _Met(asked)
        return _messages(_range_of(met.key, ranges), asked["at"][0].as_py(), met.key, met.n, met.target)

    return merge


def _relay(asked: pa.Table, answered: pa.Table) -> pa.Table:
    """Answers to a party, handed to its buckets."""
    met = _Met(asked)
    order = np.argsort(answered["range"].to_numpy())
    n, target = (np.concatenate([_unpack(answered[c][int(k)].as_py()) for k in order]) for c in ("n", "n_target"))
    return met.answers(met.n + n, met.target + target, tuple(int(answered[c].to_numpy().sum()) for c in ("tokens", "tokens_target", "vocabulary")))


def exchange(dealt: DataFrame, buckets: int) -> DataFrame:
    """What other buckets hold of each bucket's keys: rows of ``ANSWERED``, a bucket's in the order of ``range``.

    There are as many ranges as buckets, and a bucket sends at most ``FAN`` messages. More ranges than that are asked by
    parties of ``FAN`` buckets: a party adds up what its buckets ask of neighbouring ranges, asks each range once and hands the
    answers on. So messages grow with the buckets (with their square only beyond ``FAN`` squared, some hundred TB)."""
    width = -(-buckets // FAN)
    asked = dealt.groupBy("bucket").applyInArrow(_ask(buckets, width), ASKED)
    if width == 1:
        return asked.groupBy("range").applyInArrow(_answer, ANSWERED)
    party = asked.withColumn("at", (F.col("bucket") / FAN).cast("int") * FAN + F.col("range")).repartition("at")
    answered = party.groupBy("at").applyInArrow(_merge(buckets), ASKED).groupBy("range").applyInArrow(_answer, ANSWERED)
    return party.groupBy("at").cogroup(answered.groupBy("bucket")).applyInArrow(_relay, ANSWERED)


def losses(counts: list[np.ndarray], first: np.ndarray, size: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mean loss of each text in a model: ``counts`` are those of the key of each order at each place, ``total`` the
    model's tokens for each text."""
    token = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    p, whole = np.full(len(token), 1 / max(vocabulary, 1)), np.repeat(total, size).astype(np.float64)
    for order in range(1, ORDER + 1):
        before = whole if order == 1 else counts[order - 2][token - 1]
        p = (counts[order - 1][token] + PRIOR * p) / (before + PRIOR)
    return np.add.reduceat(-np.log(p), np.cumsum(size) - size) / size


def _rate(schema: T.StructType, names: tuple[str, ...], text: str, leave_one_out: bool):
    def rate(rows: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = _Bucket(rows)
        tally = _Tally(bucket)
        size, a, b = tally.size, np.zeros(0), np.zeros(0)
        if len(size):
            # answers come in the order of ranges, which is that of the keys
            order = np.argsort(answers["range"].to_numpy())
            tokens, tokens_target, vocabulary = (answers[c][0].as_py() for c in ("all_tokens", "all_tokens_target", "all_vocabulary"))
            which, chosen, own = np.cumsum(tally.new) - 1, bucket.target, tally.own() if leave_one_out else np.zeros(1, np.int64)
            gone = size if leave_one_out else np.zeros(len(size), np.int64)

            def mean(column: str, n: np.ndarray, mine: np.ndarray | int, total: np.ndarray) -> np.ndarray:
                n = n + np.concatenate([_unpack(answers[column][int(k)].as_py()) for k in order])
                return losses(tally.at_places(n[which] - own * mine), tally.first, size, total, vocabulary)

            a = mean("n_target", tally.target, chosen[tally.documents], tokens_target - chosen * gone)
            b = mean("n", tally.n, 1, tokens - gone)
        made = dict(zip(names, (pa.array(size, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(a - b, pa.float64()))))
        if text in schema.names:
            made[text] = pa.array([t for texts, _ in bucket.slices() for t in texts], pa.string())
        return pa.table({f.name: made[f.name] if f.name in made else bucket.docs[f"c_{k}"] for k, f in enumerate(schema)})

    return rate


def score(df: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", out: tuple[str, str, str, str] = ("n_tokens", "target_loss", "background_loss", "ce_difference"), leave_one_out: bool = True, keep_text: bool = True) -> DataFrame:
    """``df`` (with ``keep_text`` False, without its texts) with the number of tokens, both models' mean losses and their difference. ``targets`` has the doc_ids of target documents."""
    buckets = bucket_count(df)
    columns = [c for c in df.columns if c not in out and (keep_text or c != text)]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField(out[0], T.LongType()), *(T.StructField(c, T.DoubleType()) for c in out[1:])])
    number = F.col(doc_id).cast("string").alias("id")
    bucket = F.pmod(F.xxhash64(number, F.col(text)), F.lit(buckets)).cast("int").alias("bucket")
    rows = df.select(bucket, number, F.lit(False).alias("mark"), _packed_text(F.col(text)).alias("text"), *(F.col(c).alias(f"c_{k}") for k, c in enumerate(columns) if c != text))
    # targets' ids go to the buckets of their texts as marks, rows without a text
    chosen = targets.select(number).dropna().distinct()
    marks = df.select(bucket, number).join(chosen, "id", "left_semi").select("bucket", "id", F.lit(True).alias("mark"))
    dealt = rows.unionByName(marks, allowMissingColumns=True).repartition("bucket")
    answered = exchange(dealt, buckets).repartition("bucket")
    totals = answered.agg(*(F.sum(c).alias(f"all_{c}") for c in ("tokens", "tokens_target", "vocabulary")))
    told = answered.select("bucket", "range", "n", "n_target").crossJoin(F.broadcast(totals))  # one row
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_rate(schema, out, text, leave_one_out), schema)
