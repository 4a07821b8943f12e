"""Token ids in binary shards, with a minimal perfect hash index from document key to shard offset.

``write_tokens`` sorts the documents by key over range partitions and encodes them in the same task. A shard is a
range; its file holds blocks of raw little-endian unsigned 32-bit ids with the keys and lengths of their documents.
The index is split by key hash into buckets of bounded size. A bucket is one row: a minimal perfect hash by hash and
displace (a seed for each group of about two keys, a direct slot for groups of one) and, per slot, a fingerprint of
the key, the shard and the offsets. A lookup reads one bucket, one seed and one slot, whatever the number of keys.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import materialize, named, scratch, small, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids and documents of a block at most, unless one document has more ids.
BLOCK_IDS = 1 << 18
BLOCK_DOCS = 1 << 13
#: Keys of an index bucket on average, and of a displacement group.
BUCKET_KEYS = 4096
GROUP_KEYS = 2
#: Bytes of texts that are encoded at a time, about.
LOT_BYTES = 2 << 20
#: Words whose ids a worker keeps.
MEMO_WORDS = 400_000
#: Marks that the tokenizer cuts off the letter or digit before them.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Words may be encoded one by one where single spaces and line ends stand between other characters, and only characters
# whose classes no version of Unicode has changed. Other texts are encoded whole.
_RARE = re.compile(r"[^\x00-\x7f\xa1-ɏ]")
_WHOLE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")


def _by_words(text: str) -> bool:
    if not text or text[0] in " \n" or text[-1] in " \n" or "<|endoftext|>" in text:
        return False
    return not any(map(text.__contains__, _WHOLE)) and (text.isascii() or not _RARE.search(text))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without special tokens.

    A byte-level BPE of this kind never merges across a single space or line end, so the ids of a text are those of
    its words, each with the space or line end before it. Ids of words are kept; new words are encoded many at a time
    and cut where a token begins with the space or line end. Nor does it merge a letter or digit with a mark after it:
    a new word that ends in marks has the ids of the word without them and those of the marks. ``encode_batch`` of the
    tokenizers library gives the same ids, more slowly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token[0] in "ĠĊ"  # how the vocabulary spells a space and a line end
        self.memo: dict[str, bytes] = {}
        before, n = self.tokenizer.pre_tokenizer, len(_MARKS)
        cuts = [at for _, at in before.pre_tokenize_str(f"a{_MARKS} 1{_MARKS}")] if before else []
        self.cuts_marks = cuts == [(0, 1), (1, n + 1), (n + 1, n + 3), (n + 3, 2 * n + 3)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that each stand after a space, or after the line end they begin with."""
        spelled = [w if w[0] == "\n" else " " + w for w in words]
        learnt = {}
        for lines in (False, True):  # not mixed: a space before a line end would be another token
            some = [(w, x) for w, x in zip(words, spelled) if (x[0] == "\n") == lines]
            lots = [some[i : i + 64] for i in range(0, len(some), 64)]
            for lot, ids in zip(lots, self._ids(["".join(x for _, x in lot) for lot in lots])):
                cuts = np.flatnonzero(self.opens[ids])
                if len(cuts) != len(lot):  # cannot happen with the characters above; kept exact all the same
                    learnt.update((w, i.tobytes()) for (w, _), i in zip(lot, self._ids([x for _, x in lot])))
                    continue
                raw, ends = ids.tobytes(), [*cuts[1:].tolist(), len(ids)]
                learnt.update((w, raw[4 * a : 4 * b]) for (w, _), a, b in zip(lot, cuts.tolist(), ends))
        return learnt

    def _stem(self, word: str) -> str:
        """``word`` without the marks that it ends in, if a letter or digit is before them."""
        stem = word.rstrip(_MARKS)
        return stem if stem and self.cuts_marks and stem[-1].isalnum() else word

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as ``_learn`` has them."""
        memo = self.memo
        found = list(map(memo.get, words))
        new = [(i, word, self._stem(word)) for i, word in enumerate(words) if found[i] is None]
        known = {stem: memo.get(stem) if len(stem) < len(word) else None for _, word, stem in new}
        known.update(self._learn([stem for stem, ids in known.items() if ids is None]))
        marks = list({word[len(stem) :] for _, word, stem in new})
        marks = {m: ids.tobytes() for m, ids in zip(marks, self._ids(marks))}
        for i, word, stem in new:
            found[i] = known[stem] + marks[word[len(stem) :]]
        if len(memo) < MEMO_WORDS:
            memo.update(known)
            memo.update((word, found[i]) for i, word, _ in new)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        worded = [_by_words(t) for t in texts]
        spaced = pa.array([t.replace("\n", " \n") for t, w in zip(texts, worded) if w], pa.large_string())
        split = pc.split_pattern(spaced, " ")
        words, starts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        # The first word has nothing before it: it is encoded as the head of its text.
        heads = iter(pc.list_element(split, 0).to_pylist())
        heads = self._ids([next(heads) if w else text for text, w in zip(texts, worded)])
        at, distinct = words.indices.to_numpy().copy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        at[starts[:-1]] = len(distinct)
        ids = pa.array([*self._ids_of_words(distinct), b""], pa.large_binary()).take(pa.array(at))
        _, ends, raw = ids.buffers()
        raw, cuts = memoryview(raw or b""), np.frombuffer(ends, np.int64)[starts].tolist()
        rest = iter([raw[a:b] for a, b in zip(cuts, cuts[1:])])
        return [head.tobytes() + next(rest) if w else head.tobytes() for head, w in zip(heads, worded)]


def _encoder(path: str) -> Encoder:
    """One encoder per worker process; its memo serves all tasks of the process."""
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    kept = tokenizers.__dict__.setdefault("_encoders_of_this_process", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


@dataclass(frozen=True)
class TokenStore:
    """Written shards and their index."""

    spark: SparkSession
    root: str

    @property
    def shards(self) -> DataFrame:
        """``shard, block, keys, copies, firsts, lengths, ids``; ``firsts`` are id offsets in the shard."""
        return self.spark.read.parquet(f"{self.root}/shards")

    @property
    def index(self) -> DataFrame:
        """One row per bucket: ``bucket, seeds, prints, shards, blocks, firsts, starts, lengths, buckets`` (their number)."""
        return self.spark.read.parquet(f"{self.root}/index")


def _pack(path: str, end_id: int, key_type: pa.DataType | None):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        block, first, last, copy = 0, 0, object(), 0
        held: list[tuple] = []
        raw: list[bytes] = []
        size = 0

        def row():
            keys, copies, firsts, lengths = map(list, zip(*held))
            kind = key_type or pa.int64()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([keys], pa.list_(kind)),
                 pa.array([copies], pa.list_(pa.int64())), pa.array([firsts], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(raw)], pa.binary())],
                ["shard", "block", "keys", "copies", "firsts", "lengths", "ids"],
            )

        for batch in batches:
            keys = batch.column("_key").to_pylist()
            column = batch.column("_text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lots = np.unique(sizes // LOT_BYTES, return_index=True)[1].tolist()
            for at, to in zip(lots, [*lots[1:], len(keys)]):
                texts = [t or "" for t in column.slice(at, to - at).to_pylist()]
                for key, ids in zip(keys[at:to], encoder.encode(texts)):
                    copy = copy + 1 if key == last else 0
                    last, n = key, len(ids) // 4 + 1
                    held.append((key, copy, first, n))
                    raw += (ids, end)
                    first, size = first + n, size + n
                    if size >= BLOCK_IDS or len(held) >= BLOCK_DOCS:
                        yield row()
                        held, raw, size, block = [], [], 0, block + 1
        if held:
            yield row()

    return pack


def write_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    root: str | None = None,
) -> TokenStore:
    """Encode ``docs`` in ascending order of key (nulls last, then by text) and index every document.

    A null text is empty; every document ends with ``end_id``. A repeated key, null included, is told apart by a
    copy number from 0. Shards are the range partitions, so ``spark.sql.shuffle.partitions`` sets their size; a hot
    key is spread over several by text and row.
    """
    spark, root = docs.sparkSession, root or scratch(docs.sparkSession, "tokens")
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = docs.schema[key].dataType
    rows = docs.select(named(key).alias("_key"), named(text).alias("_text"))
    order = [F.col("_key").asc_nulls_last(), F.xxhash64("_text"), F.monotonically_increasing_id()]
    ranged = rows.select("_key", "_text", *[o.alias(f"_o{i}") for i, o in enumerate(order[1:])])
    order = [order[0], F.col("_o0"), F.col("_text"), F.col("_o1")]
    ranged = ranged.repartitionByRange(order[0], order[1], order[3]).sortWithinPartitions(*order)
    kind = key_type.simpleString()
    schema = (
        f"shard long, block long, keys array<{kind}>, copies array<long>, firsts array<long>, lengths array<long>, "
        "ids binary"
    )
    packed = ranged.select("_key", "_text").mapInArrow(
        _pack(tokenizer or tokenizer_path(), end_id, to_arrow_type(key_type)), schema
    )
    packed.write.option("compression", "zstd").parquet(f"{root}/shards")
    store = TokenStore(spark, root)
    _write_index(store)
    return store


def entries(store: TokenStore) -> DataFrame:
    """``key, copy, shard, block, first, start, length`` per document; ``start`` counts the ids of all before it."""
    per = store.shards.select("shard", "block", "keys", "copies", "firsts", "lengths")
    last = F.max_by(F.struct(F.element_at("keys", -1).alias("k"), F.element_at("copies", -1).alias("c")), "block")
    summary = per.groupBy("shard").agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"),
        F.min_by(F.struct(F.col("keys")[0].alias("k")), "block").alias("first"), last.alias("last"),
    )
    # One row per shard from here on: ids before it, and rows of its first key in the shards before it.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = summary.select("shard", "first", "last", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    base = materialize(base, "base")
    a, b = base.alias("a"), base.alias("b")
    spans = b.join(a, F.expr("b.first.k <=> a.last.k AND a.shard < b.shard")).groupBy("b.shard").agg(
        F.sum(F.col("a.last.c") + 1).alias("seen")
    )
    base = base.join(spans, "shard", "left").select("shard", "first", "base", F.coalesce("seen", F.lit(0)).alias("seen"))
    each = per.select("shard", "block", F.explode(F.arrays_zip("keys", "copies", "firsts", "lengths")).alias("e"))
    copy = F.col("e.copies") + F.when(F.expr("e.keys <=> first.k"), F.col("seen")).otherwise(0)
    return each.join(small(base), "shard").select(
        F.col("e.keys").alias("key"), copy.alias("copy"), "shard", "block", F.col("e.firsts").alias("first"),
        (F.col("base") + F.col("e.firsts")).alias("start"), F.col("e.lengths").alias("length"),
    )


def _hashes(df: DataFrame, buckets: int) -> DataFrame:
    """Two 64-bit hashes of ``(key, copy)`` and the index bucket."""
    key = [F.col("key").isNull(), F.col("key"), F.col("copy")]
    hashed = df.withColumn("h1", F.xxhash64(F.lit(1), *key)).withColumn("h2", F.xxhash64(F.lit(2), *key))
    return hashed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(buckets)))


def _mix(h1: np.ndarray, h2: np.ndarray, seed) -> np.ndarray:
    x = h1 ^ (h2 * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * np.asarray(seed, np.uint64)))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def build_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per group and the slot of every key; slots are 0 to n-1, each used once. Keys must be distinct."""
    n = len(h1)
    groups = -(-n // GROUP_KEYS)
    group = (h1 % np.uint64(groups)).astype(np.int64)
    sizes = np.bincount(group, minlength=groups)
    seeds, slots, taken = np.zeros(groups, np.int32), np.empty(n, np.int64), np.zeros(n, bool)
    for size in range(int(sizes.max(initial=0)), 1, -1):  # large groups while there is room
        keys, seed = np.flatnonzero(sizes[group] == size), 0
        keys = keys[np.argsort(group[keys], kind="stable")]
        while len(keys):  # one seed for all groups that have no place yet; the first to ask gets a slot
            spots = (_mix(h1[keys], h2[keys], seed) % np.uint64(n)).astype(np.int64)
            first = np.zeros(len(keys), bool)
            first[np.unique(spots, return_index=True)[1]] = True
            free = (first & ~taken[spots]).reshape(-1, size).all(axis=1)
            won = np.repeat(free, size)
            seeds[group[keys[won]]], slots[keys[won]], taken[spots[won]] = seed, spots[won], True
            keys, seed = keys[~won], seed + 1
    left, alone = np.flatnonzero(~taken), np.flatnonzero(sizes[group] == 1)
    seeds[group[alone]] = -1 - left  # a group of one names its slot
    slots[alone] = left
    return seeds, slots


def find_slots(h1: np.ndarray, h2: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[(h1 % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    spots = (_mix(h1, h2, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -1 - seed, spots)


def prints_of(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype("<u4")


_SLOTS = (("shards", "shard"), ("blocks", "block"), ("firsts", "first"), ("starts", "start"), ("lengths", "length"))


def _build(rows: pa.Table) -> pa.Table:
    get = lambda c: rows.column(c).to_numpy()
    h1, h2 = get("h1").view(np.uint64), get("h2").view(np.uint64)
    seeds, slots = build_hash(h1, h2)
    out = {"bucket": rows.column("bucket")[:1], "seeds": [seeds.astype("<i4").tobytes()]}
    for name, values in [("prints", prints_of(h2)), *((many, get(one)) for many, one in _SLOTS)]:
        placed = np.empty(len(h1), values.dtype.newbyteorder("<"))
        placed[slots] = values
        out[name] = [placed.tobytes()]
    return pa.table(out)


def _write_index(store: TokenStore) -> None:
    found = entries(store)
    total = store.shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))
    hashed = _hashes(found, buckets).drop("key", "copy")
    binary = ", ".join(f"{c} binary" for c in ("seeds", "prints", *(many for many, _ in _SLOTS)))
    index = hashed.groupBy("bucket").applyInArrow(_build, f"bucket long, {binary}")
    index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{store.root}/index")


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """``key, copy, shard, block, first, start, length`` of those ``(key, copy)`` whose slot has their fingerprint."""
    buckets = store.index.agg(F.max("buckets")).first()[0] or 1
    asked = _hashes(keys.select("key", "copy"), buckets)
    grouped = asked.groupBy("bucket").agg(F.collect_list(F.struct("key", "copy", "h1", "h2")).alias("asked"))
    kind = dict(keys.dtypes)["key"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ask = batch.column("asked")[i].values
                h1, h2 = (ask.field(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                raw = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)  # noqa: E731, B023
                prints = raw("prints", "<u4")
                slots = find_slots(h1, h2, raw("seeds", "<i4"), len(prints))
                hit = np.flatnonzero(prints[slots] == prints_of(h2))
                at = slots[hit]
                yield pa.RecordBatch.from_arrays(
                    [ask.field("key").take(pa.array(hit)), ask.field("copy").take(pa.array(hit)),
                     *(pa.array(raw(many, "<i8")[at]) for many, _ in _SLOTS)],
                    ["key", "copy", *(one for _, one in _SLOTS)],
                )

    schema = f"key {kind}, copy long, " + ", ".join(f"{one} long" for _, one in _SLOTS)
    return grouped.join(store.index, "bucket").drop("bucket", "buckets").mapInArrow(find, schema)


def fetch(store: TokenStore, keys: DataFrame) -> DataFrame:
    """``key, copy, ids`` (raw bytes) of the asked documents, cut out of the blocks that the index names."""
    found = materialize(lookup(store, keys), "found")
    base = "(first - firsts[0]) * 4"
    joined = small(found).join(store.shards.select("shard", "block", "firsts", "ids"), ["shard", "block"])
    return joined.select("key", "copy", F.expr(f"substring(ids, int({base} + 1), int(length * 4))").alias("ids"))


def stored(store: TokenStore) -> DataFrame:
    """``shard, first, length, crc32`` of every document's raw ids, read back from the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = memoryview(batch.column("ids")[i].as_buffer())
                firsts = batch.column("firsts")[i].values.to_numpy()
                lengths = batch.column("lengths")[i].values.to_numpy()
                begins = (4 * (firsts - firsts[0])).tolist()
                sums = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(begins, lengths.tolist())]
                shard = np.full(len(firsts), batch.column("shard")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(firsts), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["shard", "first", "length", "crc32"],
                )

    columns = store.shards.select("shard", "firsts", "lengths", "ids")
    return columns.mapInArrow(read, "shard long, first long, length long, crc32 long")


def read_all(store: TokenStore, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, copy, start, n_tokens, ids_crc32`` per document of ``docs``: found by index, checked against the shards."""
    counted = docs.groupBy(named(key).alias("key")).agg(F.count("*").alias("m"))
    keys = counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("copy"))
    found = lookup(store, keys).join(stored(store), ["shard", "first", "length"])
    return found.select("key", "copy", "start", F.col("length").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back through the index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = read_all(write_tokens(docs), docs)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
