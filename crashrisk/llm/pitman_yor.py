"""Language-model scores by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

The restaurants of the model are the words that stand before a word, and all of them have
one parent, the restaurant without context, whose own parent is uniform over the V words
seen in training and one more for all others. Each text's end is a word, and also the
context of the first word of the next text. Customers are the training tokens. The tables
of a context restaurant are customers of its parent. A sweep draws the tables of every
(context, word) given the parent's probabilities, then those of every word in the parent
given the tables below; all draws of a level are made side by side, with the tables of a
restaurant's other dishes as the sweep found them. Predictive probabilities are averaged
over the samples behind the burn-in, restaurant by restaurant (a context's average uses
its parent's average), so each of them sums to one over the V + 1 words.

Texts are cut into blocks of tokens, once. A block tells its distinct words and word pairs,
as 64-bit hashes, to the bucket they belong to, and gets back what is known of them, so
the shuffles carry distinct pairs of a block and no tokens. Pairs belong to a bucket by
their second word; a word that many pairs end with has its pairs dealt over several
buckets by their first word. A pair seen once has one table whatever happens, so only
pairs seen again are seated, and words are told only what those change. Each message
list is grouped by its receiver; blocks and buckets have a bounded size and their number
follows the corpus. Every step is written to the shared folder, tables that are done with
are removed, and draws are seeded by sweep and bucket, so a lost task comes out the same.

Defined cases: a null text is empty and has its end only. A row without a key is scored
but not trained on. Repeated rows are rows of their own. Without any training row all
tokens are unknown and the model is uniform over one word. An empty table gives an empty
result. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.components import discard, stored
from crashrisk.llm.registry import query
from crashrisk.llm.seating import reseat

#: Tokens of a block (a longer text is a block of its own), and tokens whose pairs a bucket holds.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 20, 2 << 20
#: A word with a larger share of the tokens than this has its pairs dealt over several buckets.
HOT_SHARE = 1 / 1000

#: What blocks and buckets tell each other: receiver, kind, sender, arrays, and numbers to be added up.
_LETTER = "to long, kind string, sender long, blobs array<binary>, sums array<double>"
_SCHEMA = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("sender", pa.int64()), ("blobs", pa.list_(pa.binary())),
                     ("sums", pa.list_(pa.float64()))])
_END = np.uint64(0)


def _pack(a: np.ndarray) -> bytes:
    """Hashes as they are; counts in as few bytes each as the largest needs and floats in four, compressed. The first byte names the type."""
    if a.dtype == np.uint64:
        return b"Q" + a.tobytes()
    if a.dtype.kind == "f":
        code = "f"
    else:
        most = int(a.max()) if len(a) else 0
        code = "B" if most < 1 << 8 else "H" if most < 1 << 16 else "i" if most < 1 << 31 else "q"
    raw = a.astype(np.dtype(code).newbyteorder("<"))
    return code.encode() + raw.nbytes.to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    code = chr(blob[0])
    if code == "Q":
        return np.frombuffer(blob, dtype="<u8", offset=1)
    raw = pa.decompress(memoryview(blob)[9:], int.from_bytes(blob[1:9], "little"), codec="zstd")
    return np.frombuffer(raw, dtype=np.dtype(code).newbyteorder("<")).astype(np.float64 if code == "f" else np.int32 if code == "i" else np.int64)


def _letters(rows: list[tuple]) -> pa.Table:
    rows = [(to, kind, sender, [_pack(a) for a in arrays], sums) for to, kind, sender, arrays, sums in rows]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)] if rows else [pa.array([], t) for t in _SCHEMA.types],
                                schema=_SCHEMA)


def _opened(table: pa.Table) -> dict[str, list[tuple[int, list[np.ndarray]]]]:
    """(sender, arrays) by kind, in the order of the senders."""
    out: dict[str, list] = {}
    columns = (table.column(c).to_pylist() for c in ("kind", "sender", "blobs"))
    for kind, sender, blobs in sorted(zip(*columns), key=lambda r: r[:2]):
        out.setdefault(kind, []).append((sender, [_unpack(b) for b in blobs]))
    return out


def _exchange(letters: DataFrame, buckets: int, answer: Callable[[int, dict], list[tuple]]) -> DataFrame:
    """Bring each receiver's letters together and let it answer with letters of its own."""
    def receive(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return _letters(answer(key[0].as_py(), _opened(table)))
        finally:
            ta.give_back()
    return letters.repartition(buckets, "to").groupBy("to").applyInArrow(receive, _LETTER)


def _home(words: np.ndarray, buckets: int) -> np.ndarray:
    return (ta.mix(words + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int64)


def _split(names: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, its run) of a sorted array of values."""
    kinds, first = np.unique(values, return_index=True)
    for kind, a, b in zip(kinds, first, np.append(first[1:], len(names))):
        yield int(kind), slice(int(a), int(b))


class _Block:
    """Distinct words and word pairs of a block, and where they belong."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray, buckets: int,
                 hot: np.ndarray, parts: np.ndarray):
        n = len(words)
        self.words, self.tokens, self.lengths = words, tokens, lengths
        trains = np.repeat(held == 0, lengths)
        self.n_words = np.bincount(tokens, weights=trains, minlength=n).astype(np.int64)
        before = np.empty_like(tokens)
        before[0], before[1:] = np.searchsorted(words, _END), tokens[:-1]  # what ends a text begins the next
        pairs, self.pair_of = np.unique(tokens * np.int64(n) + before, return_inverse=True)
        self.n_pairs = np.bincount(self.pair_of, weights=trains, minlength=len(pairs)).astype(np.int64)
        self.second, self.first = pairs // n, pairs % n
        self.home = _home(words, buckets)
        bucket = self.home[self.second]
        at = np.minimum(np.searchsorted(hot, words), max(0, len(hot) - 1))
        spread = np.where(hot[at] == words, parts[at], 1) if len(hot) else np.ones(n, dtype=np.int64)
        wide = np.flatnonzero(spread[self.second] > 1)
        shift = ta.mix(words[self.first[wide]] + np.uint64(0x632BE59BD9B4E019)) % spread[self.second[wide]].astype(np.uint64)
        bucket[wide] = (bucket[wide] + shift.astype(np.int64)) % buckets
        self.bucket = bucket
        self.word_order, self.pair_order = np.argsort(self.home, kind="stable"), np.argsort(bucket, kind="stable")

    def asks(self, block: int) -> list[tuple]:
        """One letter to each bucket: its words with their counts, and its pairs as runs of a word."""
        words = {b: self.word_order[s] for b, s in _split(self.word_order, self.home[self.word_order])}
        pairs = {b: self.pair_order[s] for b, s in _split(self.pair_order, self.bucket[self.pair_order])}
        nothing, out = np.zeros(0, dtype=np.int64), []
        for b in sorted(words.keys() | pairs.keys()):
            of, which = pairs.get(b, nothing), words.get(b, nothing)
            heads = np.union1d(which, self.second[of])
            counts = np.where(self.home[heads] == b, self.n_words[heads], 0)
            sizes = np.bincount(np.searchsorted(heads, self.second[of]), minlength=len(heads))
            out.append((b, "ask", block, [self.words[heads], counts, sizes, self.words[self.first[of]], self.n_pairs[of]], None))
        return out


def _blocks_of(batches: Iterator[pa.RecordBatch], kind: pa.DataType, block_tokens: int, hot_share: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, held) as block letters with the keys of their texts and their frequent words."""
    part, seq, held_rows = TaskContext.get().partitionId(), 0, []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        hashes, lengths, held = (np.concatenate([r[i] for r in held_rows]) for i in (0, 1, 2))
        keys = pa.concat_arrays([r[3] for r in held_rows])
        held_rows.clear()
        size = 0
        words, tokens = np.unique(hashes, return_inverse=True)
        del hashes
        counts = np.bincount(tokens)
        frequent = np.flatnonzero(counts >= len(tokens) * hot_share / 2)
        row = _letters([((part << 32) + seq, "block", 0, [words, tokens, lengths, held], [float(len(tokens))])]).to_batches()[0]
        more = [pa.array([keys.to_pylist()], pa.list_(kind)), pa.array([words[frequent].view(np.int64).tolist()], pa.list_(pa.int64())),
                pa.array([counts[frequent].tolist()], pa.list_(pa.int64()))]
        return pa.record_batch([*row.columns, *more], names=[*row.schema.names, "keys", "frequent", "counts"])

    for batch in batches:
        for first, last, texts in ta.slices(batch.column(1)):
            data, starts = ta.joined(texts)
            data = ta.lower_ascii(data)
            begin, end = ta.word_bounds(data)
            lengths = np.diff(ta.owner_bounds(begin, starts)) + 1
            hashes = np.full(int(lengths.sum()), _END)
            inside = np.ones(len(hashes), dtype=bool)
            inside[np.cumsum(lengths) - 1] = False
            hashes[inside] = np.maximum(ta.range_hashes(ta.prefix_sums(data), begin, end), np.uint64(1))
            rows = batch.slice(first, last - first)
            held_rows.append((hashes, lengths, rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64), rows.column(0)))
            size += len(hashes)
            if size >= block_tokens:
                yield flush()
                seq += 1
                ta.give_back()
    if held_rows:
        yield flush()


def _joined(parts: list[np.ndarray], dtype=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def _shelve(bucket: int, letters: dict, buckets: int) -> list[tuple]:
    """Add up what the blocks ask for: words, pairs that need seating, who asked for them, and names to be told of.

    Pairs seen twice or more in training are seated; those seen once count for the blocks
    in which they are held out. All other pairs are known to the one block that has them.
    """
    asks = letters["ask"]
    senders = [s for s, _ in asks]
    heads, n_heads, sizes, first, n_pairs = (_joined([a[i] for _, a in asks], np.uint64 if i in (0, 3) else np.int64) for i in range(5))
    second = np.repeat(heads, sizes)
    head_ends, pair_ends = np.cumsum([len(a[0]) for _, a in asks]), np.cumsum([len(a[3]) for _, a in asks])

    here = _home(heads, buckets) == bucket
    words, word_of = np.unique(heads[here], return_inverse=True)
    n_words = np.bincount(word_of, weights=n_heads[here], minlength=len(words)).astype(np.int64)
    _, one, pair_of, askers = np.unique(ta.mix(second * np.uint64(0x9E3779B97F4A7C15) + ta.mix(first)), return_index=True, return_inverse=True,
                                        return_counts=True)
    seen = np.bincount(pair_of, weights=n_pairs, minlength=len(one)).astype(np.int64)
    again = np.flatnonzero(seen > 1)
    known = np.concatenate([again, np.flatnonzero((seen == 1) & (askers > 1))])
    dish = np.full(len(one), -1)
    dish[known] = np.arange(len(known))

    names = np.unique(np.concatenate([first[one[again]], second[one[again]]]))
    homes = _home(names, buckets)
    names = names[np.lexsort((names, homes))]
    homes = np.sort(homes)
    place = np.argsort(names)
    find = lambda w: place[np.searchsorted(names, w, sorter=place)]
    context, word, c = find(first[one[again]]), find(second[one[again]]), seen[again]
    out = [(bucket, "words", bucket, [words, n_words],
            [float(n_words.sum()), float((n_words > 0).sum()), float((seen == 1).sum()), float((seen == 2).sum())]),
           (bucket, "seats", bucket, [context, word, c, np.ones(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)], None)]
    saved = [np.bincount(x, weights=c - 1, minlength=len(names)).astype(np.int64) for x in (context, word)]
    out += [(home, "names", bucket, [names[s], saved[0][s], saved[1][s]], None) for home, s in _split(names, homes)]
    where = np.cumsum(here) - 1  # place of each head among those at home
    for i, sender in enumerate(senders):
        a, b = head_ends[i] - len(asks[i][1][0]), head_ends[i]
        p, q = pair_ends[i] - len(asks[i][1][3]), pair_ends[i]
        told = np.flatnonzero(dish[pair_of[p:q]] >= 0)
        out.append((bucket, "subs", sender, [word_of[where[a:b][here[a:b]]], told, dish[pair_of[p:q][told]]], None))
    return out


def _told(links: list, tables: np.ndarray, served: np.ndarray, root: np.ndarray, home: int) -> list[tuple]:
    return [(sender, "reply", home, [tables[at], served[at], root[at]], None) for sender, (at,) in links]


def _root_sums(served: np.ndarray, root: np.ndarray) -> list[float]:
    return [float(served.sum()), float(root.sum()), float((served == 1).sum()), float((served == 2).sum())]


def _first_home(bucket: int, letters: dict) -> list[tuple]:
    """Words with the tables below them while every dish has one table, and who is to be told of them."""
    (_, (words, n_words)), = letters["words"]
    links = [(sender, (np.searchsorted(words, a[0]),)) for sender, a in letters.get("names", [])]
    saved, lost = _saved(len(words), links, {s: a[1:] for s, a in letters.get("names", [])})
    served = n_words - lost
    root = np.minimum(served, 1)
    zero = np.zeros(len(words))
    return [(bucket, "home", bucket, [n_words, served, root, zero, zero], _root_sums(served, root)),
            *((bucket, "links", sender, [at], None) for sender, (at,) in links), *_told(links, n_words - saved, served, root, bucket)]


def _saved(n: int, links: list, moves: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Customers without a table of their own, by context and by word."""
    saved, lost = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for sender, (at,) in links:
        saved[at] += moves[sender][0]  # names of a sender are distinct
        lost[at] += moves[sender][1]
    return saved, lost


@dataclass(frozen=True)
class _Facts:
    """Numbers about the whole model: words and tokens seen in training, settings, and what the restaurant without context holds."""

    n_words: int
    customers_seen: float
    thetas: tuple[float, float]
    discounts: tuple[float, float]
    customers: float
    tables: float
    seed: int

    def with_root(self, customers: float, tables: float) -> _Facts:
        return replace(self, customers=customers, tables=tables)

    def rng(self, bucket: int, sweep: int, level: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64([self.seed, bucket, sweep, level]))

    def predictive(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words in the restaurant without context."""
        d, theta = self.discounts[0], self.thetas[0]
        return (customers - d * tables + (theta + d * self.tables) / (self.n_words + 1)) / (theta + self.customers)


def _seat(bucket: int, letters: dict, facts: _Facts, sweep: int, sample: bool) -> list[tuple]:
    """Draw the tables of all pairs seen again, given what their words' homes say."""
    (_, (context, word, c, t, drawn)), = letters["seats"]
    replies = letters.get("reply", [])
    tables, served, root = (_joined([a[i] for _, a in replies]) for i in range(3))
    p, d = facts.predictive(served, root), facts.discounts[1]
    t = reseat(c, facts.thetas[1] + d * (tables[context] - t), p[word], d, facts.rng(bucket, sweep, 1))
    saved = [np.bincount(x, weights=c - t, minlength=len(tables)).astype(np.int64) for x in (context, word)]
    out = [(bucket, "seats", bucket, [context, word, c, t, drawn + t * sample], None)]
    end = 0
    for home, a in replies:
        part = slice(end, end + len(a[0]))
        end = part.stop
        out.append((home, "moves", bucket, [saved[0][part], saved[1][part]], None))
    return out


def _at_home(bucket: int, letters: dict, facts: _Facts, sweep: int, burn_in: int) -> list[tuple]:
    """Draw the tables of all words in the restaurant without context, given the tables below, and tell who needs them."""
    (_, (n_words, served, root, p_sum, a_sum)), = letters["home"]
    if sweep > burn_in:  # the totals of the sweep before are known by now
        p_sum = p_sum + facts.predictive(served, root)
    links = letters.get("links", [])
    saved, lost = _saved(len(n_words), links, dict(letters.get("moves", [])))
    tables, served = n_words - saved, n_words - lost
    d, theta = facts.discounts[0], facts.thetas[0]
    root = reseat(served, theta + d * (facts.tables - root), np.full(len(served), 1 / (facts.n_words + 1)), d, facts.rng(bucket, sweep, 0))
    if sweep >= burn_in:
        a_sum = a_sum + facts.thetas[1] + facts.discounts[1] * tables
    return [(bucket, "home", bucket, [n_words, served, root, p_sum, a_sum], _root_sums(served, root)), *_told(links, tables, served, root, bucket)]


def _value(bucket: int, letters: dict, facts: _Facts, samples: int) -> list[tuple]:
    """What each block is told in the end: of its words the count, the average probability and share left to the parent, of its pairs the rest."""
    (_, (n_words, served, root, p_sum, a_sum)), = letters["home"]
    (_, (_, _, c, _, drawn)), = letters["seats"]
    p, a, d = (p_sum + facts.predictive(served, root)) / samples, a_sum / samples, facts.discounts[1]
    out = []
    for block, (words, told, dish) in letters["subs"]:
        value = np.full(len(dish), 1 - d)
        seated = dish < len(c)
        value[seated] = c[dish[seated]] - d * drawn[dish[seated]] / samples
        out.append((block, "values", bucket, [n_words[words], p[words], a[words], told, value], None))
    return out


def _scored(table: pa.Table, arranged: Callable[..., _Block], facts: _Facts, kind: pa.DataType) -> pa.Table:
    """Scores of a block's texts."""
    letters = _opened(table)
    keys = next(k for k in table.column("keys").to_pylist() if k is not None)
    (_, (words, tokens, lengths, held)), = letters["block"]
    block = arranged(words, tokens, lengths, held)
    of_bucket = {s: a for s, a in letters["values"]}
    c, p, a = (np.zeros(len(words)) for _ in range(3))
    value = np.where(block.n_pairs > 0, 1 - facts.discounts[1], 0.0)
    for b, s in _split(block.word_order, block.home[block.word_order]):
        which = block.word_order[s]
        c[which], p[which], a[which] = of_bucket[b][:3]
    for b, s in _split(block.pair_order, block.bucket[block.pair_order]):
        told, new = of_bucket[b][3:]
        value[block.pair_order[s][told]] = new
    first, second = block.first, block.second
    log = np.log10((value + a[first] * p[second]) / (facts.thetas[1] + c[first]))[block.pair_of]
    base = np.log10((c + 1) / (facts.customers_seen + facts.n_words + 1))[tokens]
    begins = np.cumsum(lengths) - lengths
    total = lambda x: np.add.reduceat(x, begins)
    columns = [pa.array(keys, kind), pa.array(held != 0), pa.array(lengths), pa.array(total((c > 0)[tokens].astype(np.int64))),
               pa.array(np.full(len(lengths), int(facts.customers_seen))), pa.array(total(base)), pa.array(total(log))]
    return pa.table(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _sums(letters: DataFrame, kind: str, n: int) -> list[float]:
    row = letters.where(F.col("kind") == kind).agg(*(F.sum(F.get("sums", F.lit(i))) for i in range(n))).first()
    return [x or 0.0 for x in row]


def _discount(once: float, twice: float) -> float:
    """The usual estimate from the dishes that occur once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.9)) if once else 0.5


def pitman_yor_scores(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", thetas: tuple[float, float] = (1.0, 1.0),
                      burn_in: int = 3, samples: int = 3, seed: int = 1, block_tokens: int = BLOCK_TOKENS,
                      bucket_tokens: int = BUCKET_TOKENS, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per row of ``df``: its key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows where ``held_out`` is false train the model. score is the log10 probability of the
    text's words and its end, the average over ``samples`` sweeps after ``burn_in``. Unknown
    words have the probability of one more word. base_score is that of add-one counts.
    ``thetas``: concentrations of the restaurant without context and of those with one;
    the discounts are estimated from the dishes that occur once and twice. The sizes of
    blocks and buckets change which draws are made, not the law they are drawn from.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.coalesce(held_out, F.lit(True)) | F.col(key).isNull()).alias("held"))
    name = rows.schema["key"].dataType.simpleString()
    kind = rows.limit(0).select("key").toArrow().schema.field(0).type
    blocks = stored(rows.mapInArrow(lambda b: _blocks_of(b, kind, block_tokens, hot_share), f"{_LETTER}, keys array<{name}>, frequent array<long>, counts array<long>"), "blocks")
    size = blocks.agg(F.sum(F.get("sums", F.lit(0))), F.count("*")).first()
    tokens, n_blocks = size[0] or 0.0, max(1, size[1])
    buckets = max(16, -(-int(tokens) // bucket_tokens))
    frequent = (blocks.select(F.explode(F.arrays_zip("frequent", "counts")).alias("w")).groupBy("w.frequent").agg(F.sum("w.counts").alias("n"))
                .where(F.col("n") >= tokens * hot_share).orderBy("frequent").collect())  # 1 / hot_share rows at most
    hot = np.array([r["frequent"] for r in frequent], dtype=np.int64).view(np.uint64)
    parts = np.array([min(buckets, -(-int(r["n"]) * buckets // int(tokens))) for r in frequent], dtype=np.int64)
    order = np.argsort(hot)
    hot, parts = hot[order], parts[order]
    arranged = lambda *block: _Block(*block, buckets, hot, parts)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _letters(arranged(*map(_unpack, blobs)).asks(to)).to_batches()
                ta.give_back()

    shelves = stored(_exchange(blocks.select("to", "blobs").mapInArrow(asks, _LETTER), buckets, lambda b, m: _shelve(b, m, buckets)), "shelves", "kind")
    of = lambda frame, *kinds: frame.where(F.col("kind").isin(*kinds)).select("to", "kind", "sender", "blobs", "sums")
    seen, n_words, once, twice = _sums(shelves, "words", 4)
    first = homes = stored(_exchange(of(shelves, "words", "names"), buckets, _first_home), "homes", "kind")
    customers, tables, root_once, root_twice = _sums(homes, "home", 4)
    facts = _Facts(int(n_words), seen, thetas, (_discount(root_once, root_twice), _discount(once, twice)), customers, tables, seed)
    seats = shelves
    for sweep in range(burn_in + samples):
        now, state = facts, sweep >= burn_in
        moved = stored(_exchange(of(seats, "seats").unionByName(of(homes, "reply")), buckets,
                                 lambda b, m, now=now, sweep=sweep, state=state: _seat(b, m, now, sweep, state)), "seats", "kind")
        back = stored(_exchange(of(homes, "home").unionByName(of(first, "links")).unionByName(of(moved, "moves")), buckets,
                                lambda b, m, now=now, sweep=sweep: _at_home(b, m, now, sweep, burn_in)), "homes", "kind")
        discard(*(t for t, kept in ((seats, shelves), (homes, first)) if t is not kept))
        seats, homes = moved, back
        facts = facts.with_root(*_sums(homes, "home", 2))
    values = stored(_exchange(of(homes, "home").unionByName(of(seats, "seats")).unionByName(of(shelves, "subs")), buckets,
                              lambda b, m: _value(b, m, facts, samples)), "values")
    discard(shelves, *{id(t): t for t in (first, homes, seats) if t is not shelves}.values())

    def scored(block: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return _scored(table, arranged, facts, kind)
        finally:
            ta.give_back()

    told = blocks.select("to", "kind", "sender", "blobs", "keys").unionByName(
        values.select("to", "kind", "sender", "blobs", F.lit(None).cast(f"array<{name}>").alias("keys")))
    out = told.repartition(n_blocks, "to").groupBy("to").applyInArrow(
        scored, f"key {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


@query("op13_pitman_yor")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pitman_yor_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
