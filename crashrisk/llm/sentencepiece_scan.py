"""SentencePiece encoding by a max-plus scan, and decoding.

A text is cut into the pieces of a vocabulary with the greatest sum of scores (the unigram
rule): the best score up to each character is a max-plus recurrence over the pieces that
end there. Of equal sums the one with the longest last piece counts, then the longest
before it, and so on.

*Ordinary* documents are encoded where they are. No piece holds a space mark after another
character, so every word stands alone and each distinct word is cut once per worker.

*Giant* documents are split at fixed places into chunks, which other tasks work on. The
state at a chunk's border is how many of its characters the last piece before it already
covers. A chunk yields the matrix of best scores from each state at its begin to each
state at its end; matrices are combined associatively (max-plus products, a prefix scan)
into the best scores at every border, and then every chunk is traced back by itself: first
from each possible end to the begin it leads to, which again compose, then from its true
end to its pieces. The result is that of the undivided document, whatever the chunks.

The scores are integers, so sums do not depend on their order. Models trained as unigram
keep their log probabilities (in thousandths); a vocabulary of merges has ranks instead,
and a piece of rank r is scored as the r-th of a Zipf distribution, -log(r + 2).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.components import stored
from crashrisk.llm.registry import query
from crashrisk.llm.token_files import vocabulary_file

#: Characters from which a document is giant, and of its chunks.
GIANT, CHUNK = 1 << 16, 1 << 13
#: Words whose ids a worker remembers.
MOST_WORDS = 400_000
MARK = "▁"
_MARK = MARK.encode()
NEVER = -(1 << 60)
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Vocabulary:
    """Pieces, their scores and the memory of encoded words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, scores = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = all(float(s).is_integer() for s in scores[plain])  # ranks of merges, not log probabilities
        if ranked:
            order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-scores[i] if scores[i] > -1e8 else i, i)))}
            value = {i: int(round(-1000 * np.log(order[i] + 2))) for i in plain}
        else:
            value = {i: int(round(1000 * scores[i])) for i in plain}
        self.pieces = {pieces[i]: (i, value[i]) for i in plain}
        self.unknown_score = min(value.values()) - 10_000
        self.longest = max(map(len, self.pieces))
        self.reach: dict[str, int] = {}  # the longest piece with these first two characters
        for piece in self.pieces:
            self.reach[piece[:2]] = max(self.reach.get(piece[:2], 0), len(piece))
        # the pieces of each length in bytes: a first look by 16 bits of the hash, then sorted hashes
        self.by_length: dict[int, tuple] = {}
        by_size: dict[int, list[str]] = {}
        for piece in self.pieces:
            by_size.setdefault(len(piece.encode()), []).append(piece)
        for length, same in sorted(by_size.items()):
            data = np.frombuffer("".join(same).encode(), np.uint8)
            at = np.arange(len(same)) * length
            hashes = ta.range_hashes(ta.prefix_sums(data), at, at + length)
            order, maybe = np.argsort(hashes), np.zeros(1 << 16, dtype=bool)
            maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
            found = [self.pieces[same[i]] for i in order]
            self.by_length[length] = (maybe, hashes[order], np.array([i for i, _ in found]), np.array([v for _, v in found]))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces with a space mark inside are not supported")
        self.unknown = model.unk_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(model.is_byte(i) for i in self.byte_ids)
        # the bytes each piece stands for
        shown = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else
                 bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_ends = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    # --- the recurrence -------------------------------------------------------

    def forward(self, text: str, n: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """(best score, start of the last piece) at each place, for pieces that start in the first ``n`` characters.

        ``entry`` holds the scores at the first places; ``text`` may go on behind ``n`` for pieces that cross.
        """
        size = len(text)
        best, back = entry + [NEVER] * (size + 1 - len(entry)), [-1] * (size + 1)
        pieces, reach, unknown = self.pieces, self.reach, self.unknown_score
        for i in range(n):
            here = best[i]
            if here <= NEVER:
                continue
            if text[i] not in pieces and here + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + unknown, i
            for j in range(i + 1, min(i + max(1, reach.get(text[i:i + 2], 1)), size) + 1):
                found = pieces.get(text[i:j])
                if found is not None and here + found[1] > best[j]:
                    best[j], back[j] = here + found[1], i
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """(place where the path enters, ids) of the best path that ends at ``end``."""
        ids: list[int] = []
        while back[end] >= 0:
            piece = text[back[end]:end]
            found = self.pieces.get(piece)
            if found is not None:
                ids.append(found[0])
            elif self.has_bytes:
                ids.extend(self.byte_ids[b] for b in reversed(piece.encode("utf-8", "replace")))
            else:
                ids.append(self.unknown)
            end = back[end]
        return end, ids[::-1]

    # --- ordinary documents ---------------------------------------------------

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            self._remember(words[at:at + 20_000])

    def _remember(self, words: list[bytes]) -> None:
        ids, sizes = self.cut([_MARK + w for w in words])
        n = len(self.number)
        ends = (self.ends[n] if n else 0) + np.cumsum(sizes)
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[ends[0] - sizes[0]:ends[-1]] = ids
        self.ends[n + 1:n + 1 + len(words)] = ends
        self.number.update(zip(words, range(n, n + len(words))))

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has): the recurrence over many words at once, place by place."""
        blob = b"".join(words)
        try:
            blob.decode()
        except UnicodeDecodeError:
            words = [w.decode("utf-8", "replace").encode() for w in words]
            blob = b"".join(words)
        data, size = np.frombuffer(blob, np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        word_end = np.cumsum(size)
        begin = word_end - size
        inside = np.arange(len(data)) - np.repeat(begin, size)  # each byte's place in its word
        left = np.repeat(size, size) - inside  # bytes to the word's end
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        sums = ta.prefix_sums(data)
        edges = []  # (first byte, bytes, id, score) of all pieces found in the words
        for length, (maybe, hashes, ids, scores) in self.by_length.items():
            at = heads[left[heads] >= length]
            if len(at):
                found = ta.range_hashes(sums, at, at + length)
                likely = maybe[(found & np.uint64(0xFFFF)).astype(np.int64)]
                at, found = at[likely], found[likely]
                place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                hit = hashes[place] == found
                edges.append((at[hit], np.full(hit.sum(), length), ids[place[hit]], scores[place[hit]]))
        # characters that are no piece by themselves
        width = np.diff(np.append(heads, len(data)))
        single = np.zeros(len(data), dtype=bool)
        for at, length, _, _ in edges:
            next_head = at + width[np.searchsorted(heads, at)]
            single[at[next_head == at + length]] = True
        lone = ~single[heads]
        edges.append((heads[lone], width[lone], np.full(lone.sum(), -1), np.full(lone.sum(), self.unknown_score)))
        at, length, ids, scores = (np.concatenate(x).astype(np.int64) for x in zip(*edges))

        # best[p + word number] is the best score up to byte p of the word; a word of n bytes has n + 1 places
        shift = np.repeat(np.arange(len(words)), size)
        best = np.full(len(data) + len(words), NEVER, dtype=np.int64)
        first = begin + np.arange(len(words))
        best[first] = 0
        back, piece = np.zeros(len(best), dtype=np.int64), np.zeros(len(best), dtype=np.int64)
        source = at + shift[at]
        target = source + length
        order = np.argsort(inside[at], kind="stable")
        cuts = np.searchsorted(inside[at][order], np.arange(int(size.max(initial=0)) + 1))
        for a, b in zip(cuts, cuts[1:]):  # all pieces that begin at the same place of their words: no two end at one place
            part = order[a:b]
            score = best[source[part]] + scores[part]
            part = part[(best[source[part]] > NEVER) & (score > best[target[part]])]
            best[target[part]] = best[source[part]] + scores[part]
            back[target[part]], piece[target[part]] = source[part], ids[part]

        # back from all ends at once
        steps, place, word = [], first + size, np.arange(len(words))
        while len(word):
            open_ones = place > first[word]
            place, word = place[open_ones], word[open_ones]
            if len(word):
                steps.append((word, back[place], place, piece[place]))
                place = back[place]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, source, target, ids = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((source, word))
        word, source, target, ids = word[order], source[order], target[order], ids[order]
        unknown = ids < 0
        count = np.where(unknown & self.has_bytes, target - source, 1)
        out = np.repeat(np.where(unknown, self.unknown, ids), count).astype(np.int32)
        if self.has_bytes and unknown.any():
            spread = np.repeat(unknown, count)
            where = np.repeat(source - word, count) + np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
            out[spread] = np.array(self.byte_ids, dtype=np.int32)[data[where[spread]]]
        return out, np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's begin; one more at the end)."""
        words = [_words(t) for t in texts]
        flat = [w for text in words for w in text]
        if len(self.number) > MOST_WORDS:
            self.clear()
        of = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(of < 0)
        if len(new):
            self.learn(list({flat[i] for i in new}))
            of[new] = [self.number[flat[i]] for i in new]
        begin, size = self.ends[of], self.ends[of + 1] - self.ends[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])]
        return self.pool[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids; the space that encoding puts first is taken off again."""
        begin, size = self.shown_ends[ids], self.shown_ends[ids + 1] - self.shown_ends[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.shown[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        return [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(ends[bounds[:-1]], ends[bounds[1:]])]

    # --- chunks of giant documents --------------------------------------------

    def border(self, text: str, n: int, last: bool) -> np.ndarray:
        """The matrix of a chunk: best score from each begin state to each end state."""
        states = self.longest
        out = np.full((states, states), NEVER, dtype=np.int64)
        cut = _first_cut(text, n)
        tail, tail_at = None, None
        if cut is not None:
            # behind a word's begin nothing depends on the state before it
            tail, _ = self.forward(text[cut:], n - cut, [0])
            tail_at = cut
        for a in range(min(states, n + 1 if last else n)):
            if cut is not None:
                if a > cut:
                    continue
                head, _ = self.forward(text[:cut], cut, [NEVER] * a + [0])
                scores = [head[cut] + s if head[cut] > NEVER and s > NEVER else NEVER for s in tail[n - tail_at:]]
            else:
                scores = self.forward(text, n, [NEVER] * a + [0])[0][n:]
            out[a, :len(scores)] = scores[:states]
        if last:
            out[:, 1:] = NEVER
        return out


def _first_cut(text: str, n: int) -> int | None:
    """The first place from 1 on where a word begins (a mark after another character)."""
    at = 1
    while (at := text.find(MARK, at)) >= 0 and at < n:
        if text[at - 1] != MARK:
            return at
        at += 1
    return None


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices; associative, so chunks may be joined in any grouping."""
    return np.maximum(NEVER, (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2))


def _prefixes(matrices: np.ndarray) -> np.ndarray:
    """Products of all matrices up to each one, by doubling steps."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step], out[step:])
        step *= 2
    return out


def _words(text: bytes) -> list[bytes]:
    """The words of a text without the mark each begins with."""
    if not text:
        return []
    if b"  " not in text and text[0] != 32 and _MARK not in text:
        return text.split(b" ")
    marked = (_MARK + text.replace(b" ", _MARK)).decode("utf-8", "replace")
    return [s.encode()[len(_MARK):] for s in _SEGMENT.findall(marked)]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One vocabulary and memory of words per worker process and model file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _ids_array(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, keep: int) -> Iterator[pa.RecordBatch]:
    words = vocabulary_of(path)
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(keep)):
            yield pa.record_batch([*(batch.column(i).slice(first, last - first) for i in range(keep)), _ids_array(*words.encode(texts))],
                                  names=[*batch.schema.names[:keep], "ids"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int, ahead: int) -> Iterator[pa.RecordBatch]:
    """(row_key, chunk, n, last, text): the chunks of marked texts, each with the characters a piece may reach behind it.

    """
    for batch in batches:
        for row_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = MARK + text.replace(" ", MARK)
            places = range(0, len(text), size)
            for k in range(0, len(places), 64):
                part = places[k:k + 64]
                yield pa.record_batch(
                    [pa.array([row_key] * len(part)), pa.array(range(k, k + len(part)), pa.int32()),
                     pa.array([min(size, len(text) - p) for p in part], pa.int32()), pa.array([p + size >= len(text) for p in part]),
                     pa.array([text[p:p + size + ahead] for p in part])], names=["row_key", "chunk", "n", "last", "text"])


def _borders(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = vocabulary_of(path)
    for batch in batches:
        matrices = [words.border(t, n, last).tobytes() for n, last, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(matrices, pa.binary())], names=["row_key", "chunk", "matrix"])


def _entries(rows: pd.DataFrame, states: int) -> pd.DataFrame:
    """Best scores at the begin of every chunk of one document."""
    rows = rows.sort_values("chunk")
    matrices = np.stack([np.frombuffer(m, np.int64).reshape(states, states) for m in rows["matrix"]])
    begin = np.full((1, states), NEVER, dtype=np.int64)
    begin[0, 0] = 0
    scores = np.concatenate([begin, _prefixes(matrices)[:-1, 0]])
    return pd.DataFrame({"row_key": rows["row_key"], "chunk": rows["chunk"], "scores": [s.tobytes() for s in scores]})


def _leads(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """For each end state of a chunk the begin state its best path comes from."""
    words = vocabulary_of(path)
    for batch in batches:
        out = []
        for n, text, scores in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5))):
            best, back = words.forward(text, n, np.frombuffer(scores, np.int64).tolist()[:len(text) + 1])
            lead = np.full(words.longest, -1, np.int8)
            for b in range(min(words.longest, len(text) - n + 1)):
                if best[n + b] > NEVER:
                    lead[b] = words.trace(text, back, n + b)[0]
            out.append(lead.tobytes())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row_key", "chunk", "lead"])


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """The end state of every chunk of one document, from its last chunk back."""
    rows = rows.sort_values("chunk")
    exits, state = [], 0
    for lead in reversed(rows["lead"].tolist()):
        exits.append(state)
        state = int(np.frombuffer(lead, np.int8)[state])
    return pd.DataFrame({"row_key": rows["row_key"], "chunk": rows["chunk"], "exit": exits[::-1]})


def _traced(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = vocabulary_of(path)
    for batch in batches:
        out = []
        for n, text, scores, end in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5, 6))):
            _, back = words.forward(text, n, np.frombuffer(scores, np.int64).tolist()[:len(text) + 1])
            out.append(words.trace(text, back, n + end)[1])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["row_key", "chunk", "ids"])


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(key, ids) of every row of ``df``.

    ``vocabulary`` is a SentencePiece model file that every executor has. A null or empty
    text has no ids. Repeated rows are encoded alike; other columns are not read. Texts of
    more than ``giant`` characters go through chunks of ``chunk`` characters.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))
    short = rows.where(~is_giant).mapInArrow(partial(_encoded, path=vocabulary, keep=1), f"key {kind}, ids array<int>")
    long_rows = rows.where(is_giant).withColumn("row_key", F.xxhash64("key", "text"))
    states = vocabulary_of(vocabulary).longest
    if chunk < states:
        raise ValueError(f"a chunk must hold the longest piece, {states} characters")
    parts = long_rows.select("row_key", "text").dropDuplicates(["row_key"]).mapInArrow(
        partial(_chunks, size=chunk, ahead=states - 1), "row_key long, chunk int, n int, last boolean, text string")
    parts = stored(parts.repartition("row_key", "chunk"), "chunks")
    if parts.isEmpty():
        return short.withColumnRenamed("key", key)
    matrices = parts.mapInArrow(partial(_borders, path=vocabulary), "row_key long, chunk int, matrix binary")
    entries = matrices.groupBy("row_key").applyInPandas(partial(_entries, states=states), "row_key long, chunk int, scores binary")
    parts = stored(parts.join(entries, ["row_key", "chunk"]).select("row_key", "chunk", "n", "last", "text", "scores"), "chunks")
    leads = parts.mapInArrow(partial(_leads, path=vocabulary), "row_key long, chunk int, lead binary")
    exits = leads.groupBy("row_key").applyInPandas(_exits, "row_key long, chunk int, exit int")
    traced = parts.join(exits, ["row_key", "chunk"]).select("row_key", "chunk", "n", "last", "text", "scores", "exit").mapInArrow(
        partial(_traced, path=vocabulary), "row_key long, chunk int, ids array<int>")
    whole = traced.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = long_rows.select("key", "row_key").join(whole, "row_key").select("key", F.flatten("parts.ids").alias("ids"))
    return short.unionByName(whole).withColumnRenamed("key", key)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, keep: int) -> Iterator[pa.RecordBatch]:
    words = vocabulary_of(path)
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            ids = part.column(keep)
            sizes = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = words.decode(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.record_batch([*part.columns[:keep], pa.array(texts, pa.string())], names=[*part.schema.names[:keep], "text"])


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of ids; null or no ids give an empty text. Bytes that are no UTF-8 become U+FFFD."""
    kind = df.select(key).schema.fields[0].dataType.simpleString()
    return df.select(key, ids).mapInArrow(partial(_decoded, path=vocabulary, keep=1), f"`{key}` {kind}, text string")


@query("op3_sentencepiece_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_file("piece_bpe_32k.model")
    ids = stored(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), "piece-ids")
    # the ids read back, with the length and checksum of the text they decode to
    back = ids.withColumn("n_tokens", F.size("ids").cast("long")).mapInArrow(
        partial(_checked, path=path), "doc_id long, n_tokens long, ids array<int>, n_chars long, text_crc32 long")
    return back


def _checked(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        plain = batch.select(["doc_id", "ids"])
        texts = [t for part in _decoded(iter([plain]), path, 1) for t in part.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"), pa.array(list(map(len, texts)), pa.int64()),
             pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())],
            names=["doc_id", "n_tokens", "ids", "n_chars", "text_crc32"])
