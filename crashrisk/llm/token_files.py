"""Token ids of documents as raw payloads in shard files, with a minimal perfect hash index for keyed access.

Documents are put in key order by one range shuffle and tokenised behind it, so no
token travels. Each task writes its shards through Spark's committer into one Parquet
folder, a shard a row:

=============  =====================================================================
part, seq      the shard's place: task in key order, number within the task
n_docs, n_ids  documents and ids in the shard
n_null         documents without a key; they come first and are not indexed
width          bytes of an id (2 if the vocabulary allows, else 4)
ids            all ids, little-endian, document after document
offsets        where each document's ids begin, in ids, one more at the end (int64)
keys           the documents' keys (int64)
levels, bits   the minimal perfect hash: sizes of its levels, and their bits
prints         a 32-bit fingerprint per slot, to tell keys that are not there
records        the first document of each slot's key (uint32); equal keys stand together
=============  =====================================================================

The hash puts each key's bit into the first level where it is alone; a key's slot is the
number of bits before its own. Looking a key up costs a few probes, whatever the size.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.registry import query
from crashrisk.session import scratch_path

#: Ids of a shard (a longer document is a shard of its own), and bytes of text a task tokenises.
SHARD_IDS, TASK_BYTES = 1 << 21, 64 << 20
#: Pieces of words whose ids a worker remembers (some 50 bytes each).
MOST_WORDS = 2_000_000
#: The rule of a vocabulary file by which marks round a word are tokens of their own, a fixed value of its format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bits per key in each level of the hash.
GAMMA = 2.0

_COLUMNS = ("part int, seq int, n_docs long, n_ids long, n_null long, first_key long, last_key long, width int, "
            "ids binary, offsets binary, keys binary, levels binary, bits binary, prints binary, records binary")


class Words:
    """Ids of texts, piece by piece: no token spans white space, so each distinct piece is encoded once.

    A piece is a word. Where the vocabulary file lowers letters, words in ASCII are lowered
    first; where it parts letters and digits from marks by WORD_PATTERN, the marks round a
    word are pieces of their own. Pieces are told by 64-bit hashes: two out of a million
    meet by chance with a likelihood of 3e-8.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        rules = json.loads(self.tokenizer.to_str())
        normalizer, splitter = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
        kinds = [n["type"] for n in normalizer.get("normalizers", [normalizer]) if n]
        split = next(iter(splitter.get("pretokenizers", [splitter])), {})
        # bytes of the vocabulary's own tokens, which are looked for before all rules, are left as they are
        fixed = np.zeros(256, dtype=bool)
        fixed[list({byte for t in rules["added_tokens"] for byte in t["content"].encode() if not chr(byte).isalnum()})] = True
        by_marks = all(any(not c.isalnum() for c in t["content"]) for t in rules["added_tokens"])
        self.lowers = "Lowercase" in kinds and by_marks
        self.kept = fixed | (np.arange(256) >= 128)  # bytes of words that are not lowered
        self.letters = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
        self.marks = np.array([32 < i < 127 and i != 39 and not chr(i).isalnum() for i in range(256)]) & ~fixed
        if not by_marks or (split.get("pattern") or {}).get("Regex") != WORD_PATTERN:
            self.marks[:] = False
        self.clear()

    def clear(self) -> None:
        self.hashes, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # in order of the hashes
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # ids of piece n stand from ends[n] to ends[n + 1] in the pool

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces; ``hashes`` are theirs, in ascending order."""
        encoded = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        found = [e.ids for e in encoded]
        n = len(self.number)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = self.ends[n] + np.cumsum(sizes)
        while n + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.ends[n]:ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.ends[n + 1:n + 1 + len(pieces)] = ends
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.number = np.insert(self.number, place, np.arange(n, n + len(pieces)))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1 where it is new."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.number[place], -1)

    def _pieces(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the bytes, lowered where that changes no id; first byte of each piece and the byte after its last)."""
        if self.lowers:
            before = np.concatenate([[0], np.cumsum(self.kept[data])])
            as_is = before[end] > before[first]
            edge = np.zeros(len(data) + 1, dtype=np.int8)
            edge[first[as_is]] += 1
            edge[end[as_is]] -= 1
            data = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, data, ta.lower_ascii(data))
        if not self.marks.any() or not len(first):
            return data, first, end
        others = np.flatnonzero(~self.marks[data])
        low = others[np.searchsorted(others, first)]
        high = others[np.maximum(np.searchsorted(others, end) - 1, 0)] + 1
        inner = low < end
        inner[inner] = self.letters[data[low[inner]]] & self.letters[data[high[inner] - 1]]
        low, high = np.where(inner, low, first), np.where(inner, high, end)
        begins, ends = np.stack([first, low, high], 1).ravel(), np.stack([low, high, end], 1).ravel()
        filled = ends > begins
        return data, begins[filled], ends[filled]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each text closed by ``end_id``; where each text begins, one more at the end)."""
        data, starts = ta.joined(texts)
        data, first, end = self._pieces(data, *ta.word_bounds(data))
        kinds, at, of = np.unique(ta.range_hashes(ta.prefix_sums(data), first, end), return_index=True, return_inverse=True)
        if len(self.hashes) > MOST_WORDS:
            self.clear()
        number = self._find(kinds)
        new = np.flatnonzero(number < 0)
        if len(new):
            self.learn(kinds[new], [data[first[i]:end[i]].tobytes() for i in at[new]])
            number = self._find(kinds)
        of = number[of]
        begin, size = self.ends[of], self.ends[of + 1] - self.ends[of]
        word_ends = np.concatenate([[0], np.cumsum(size)])
        bounds = word_ends[ta.owner_bounds(first, starts)] + np.arange(len(texts) + 1)
        out = np.full(bounds[-1], end_id, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self.pool[np.repeat(begin - word_ends[:-1], size) + np.arange(word_ends[-1])]
        return out, bounds


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One tokenizer and memory of words per worker process and vocabulary file."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit integers: level sizes, bits, and a fingerprint per slot."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray, prints: np.ndarray):
        self.levels, self.bits, self.prints = levels, bits, prints
        self.begins = np.cumsum(levels) - levels
        # bits before each block of 64, so that a slot is one table entry and one count of bits away
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ta.mix(keys.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))

    @staticmethod
    def _print(hashes: np.ndarray) -> np.ndarray:
        return (ta.mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (ta.mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, bits = cls._hash(keys), [], []
        while len(left):
            size = -(-int(GAMMA * len(left) + 1) // 64) * 64
            place = cls._place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[place]]
        out = cls(np.array(levels, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        hashes = cls._hash(keys)
        out.prints = np.zeros(len(keys), dtype=np.uint32)
        out.prints[out._slots(hashes)] = cls._print(hashes)
        return out

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        slots = np.full(len(hashes), -1)
        open_ones = np.arange(len(hashes))
        for level, (size, begin) in enumerate(zip(self.levels, self.begins)):
            place = begin + self._place(hashes[open_ones], level, size)
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_ones[hit]] = (self.ranks[place >> 6] + below)[hit]
            open_ones = open_ones[~hit]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where the hash or the fingerprint says that it is not there.

        A key that was never indexed passes the fingerprint once in 2**32 times.
        """
        hashes = self._hash(np.ascontiguousarray(keys, dtype=np.int64))
        slots = self._slots(hashes)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == self._print(hashes)[known]
        return np.where(known, slots, -1)


def _shard(part: int, seq: int, keys: np.ndarray, n_null: int, ids: np.ndarray, offsets: np.ndarray, width: int) -> pa.RecordBatch:
    known = keys[n_null:]
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]])[:len(known)])
    index = PerfectHash.build(known[first])
    records = np.zeros(len(first), dtype=np.uint32)
    records[index.find(known[first])] = first + n_null
    low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    raw = [ids.astype(f"<u{width}"), offsets.astype("<i8"), keys.astype("<i8"), index.levels.astype("<i8"), index.bits, index.prints, records]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    numbers = zip((part, seq, len(keys), len(ids), n_null, low, high, width), (*[pa.int32()] * 2, *[pa.int64()] * 5, pa.int32()))
    return pa.record_batch([pa.array([v], t) for v, t in numbers] + [pa.array([x.tobytes()], pa.binary()) for x in raw], names=names)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    words, part, seq = words_of(path), TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, nulls, ids = (np.concatenate(x) for x in list(zip(*held))[:3])
        sizes = np.concatenate([h[3] for h in held])
        held.clear()
        return _shard(part, seq, keys, int(nulls.sum()), ids, np.concatenate([[0], np.cumsum(sizes)]), words.width)

    for batch in batches:
        for first, last, texts in ta.slices(batch.column(1)):
            keys = batch.column(0).slice(first, last - first)
            nulls = keys.is_null().to_numpy(zero_copy_only=False)
            ids, bounds = words.encode(texts, end_id)
            held.append((pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), nulls, ids, np.diff(bounds)))
            if sum(len(h[2]) for h in held) >= SHARD_IDS:
                yield flush()
                seq += 1
    if held:
        yield flush()


def write_token_files(df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Tokenise every whole text of ``df`` and write shards in ascending key order under ``path``.

    Keys are integers; rows without a key come first, rows with the same key stand together
    in the order of their texts' hashes. A null or empty text is ``end_id`` alone. An empty
    table makes no shard. ``vocabulary`` is a file every executor has; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    # the last two put rows with one key on several tasks, too
    order = ["key", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("key", "text", order[1].alias("tie"), order[2].alias("salt"))
    rows = rows.repartitionByRange(parts, "key", "tie", "salt").sortWithinPartitions("key", "tie", "salt")
    rows.select("key", "text").mapInArrow(partial(_tokenise, path=vocabulary, end_id=end_id), _COLUMNS).write.parquet(path)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            for name, kind in (("ids", f"<u{row['width']}"), ("offsets", "<i8"), ("keys", "<i8"), ("levels", "<i8"),
                               ("bits", np.uint64), ("prints", np.uint32), ("records", np.uint32)):
                row[name] = np.frombuffer(row[name], kind)
            yield row


def _records(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``keys``, record) of all documents of the shard with one of the distinct keys, by the index."""
    slots = PerfectHash(shard["levels"], shard["bits"], shard["prints"]).find(keys)
    hit = np.flatnonzero(slots >= 0)
    first = np.sort(shard["records"]).astype(np.int64)
    begin = shard["records"][slots[hit]].astype(np.int64)
    end = np.append(first[1:], shard["n_docs"])[np.searchsorted(first, begin)]
    return np.repeat(hit, end - begin), np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange((end - begin).sum())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        nulls = np.arange(shard["n_null"])
        keys = np.unique(shard["keys"][shard["n_null"]:])
        _, records = _records(shard, keys)
        records = np.concatenate([nulls, np.sort(records)])
        offsets = shard["offsets"]
        crc = [zlib.crc32(shard["ids"][offsets[r]:offsets[r + 1]].astype("<u4").tobytes()) for r in records]
        yield pa.record_batch(
            [pa.array(shard["keys"][records], mask=records < shard["n_null"]), pa.array(offsets[records] + shard["begin"]),
             pa.array(offsets[records + 1] - offsets[records]), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])


def _fetched(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        places, records = _records(shard, keys)
        ids = [shard["ids"][shard["offsets"][r]:shard["offsets"][r + 1]].astype(np.int32) for r in records]
        yield pa.record_batch([pa.array(keys[places]), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])


def document_summaries(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read from the files by their index.

    ``start`` counts the ids of all documents before it.
    """
    shards = spark.read.schema(_COLUMNS).parquet(path)
    # one number per task and per shard; documents are not brought together
    tasks = shards.groupBy("part").agg(F.sum("n_ids").alias("size"))
    tasks = tasks.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    places = shards.select("part", "seq", "n_ids").join(tasks, "part").select(
        "part", "seq", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("begin"))
    return (shards.drop("first_key", "last_key").join(places, ["part", "seq"])
            .mapInArrow(_summaries, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key))


def fetch_documents(spark: SparkSession, path: str, keys: Iterable[int], key: str = "doc_id") -> DataFrame:
    """(key, ids) of the documents with one of ``keys``, a list the caller holds; shards out of their range are not read."""
    wanted = np.unique(np.fromiter(keys, np.int64))
    low, high = (int(wanted[0]), int(wanted[-1])) if len(wanted) else (0, -1)
    shards = spark.read.schema(_COLUMNS).parquet(path).where(f"last_key >= {low} AND first_key <= {high}").drop("first_key", "last_key")
    return shards.mapInArrow(partial(_fetched, keys=wanted), "key long, ids array<int>").withColumnRenamed("key", key)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_file())
    return document_summaries(spark, path)
