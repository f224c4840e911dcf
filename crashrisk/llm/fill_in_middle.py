"""Fill-in-middle transformation, with cuts taken from a compressed set of line boundaries.

The offsets at which a line of the text begins or ends form a set in the manner of
Roaring bitmaps: the high bits of an offset name a container, and a container holds the
low 16 bits as a sorted array, a bitmap or runs, whichever is smallest. Cumulative
cardinalities over the containers find the one with the k-th boundary, and a select
inside it gives the offset, so both cuts of a text cost two searches whatever its length.

Texts are cut one by one: no shuffle, no state, and a lost executor costs its running
tasks only. Defined cases: a null or empty text is plain with n = 0 and an empty output;
a text that holds a marker is plain. Repeated rows give equal results each on its own; a
null key is written as nothing where it is hashed. Bytes that are no UTF-8 are carried
through. An empty table gives an empty result. Columns other than the key and the
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.registry import query

#: Marks before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Values up to which a container without runs is an array; beyond, it is a bitmap of 2**16 bits.
ARRAY_MOST = 4096


class ArrayContainer:
    """Low halves in ascending order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each low half, with the bits set before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, dtype=bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        set_bits = np.flatnonzero(np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little"))
        return word * 64 + int(set_bits[k - self.before[word]])


class RunContainer:
    """First values of runs of neighbouring low halves, with the values held before each run."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.starts, self.before = low[first].astype(np.uint16), first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def _container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three: 4 bytes a run, 2 a value, or 8 kB of bits."""
    runs = 1 + int((np.diff(low) != 1).sum())
    if 2 + 4 * runs < min(2 * len(low), 8192):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A sorted set of offsets, as containers of 2**16 neighbouring offsets with cumulative cardinalities."""

    def __init__(self, values: np.ndarray):
        self.names, first = np.unique(values >> 16, return_index=True)
        ends = np.append(first[1:], len(values))
        self.containers = [_container(values[a:b] & 0xFFFF) for a, b in zip(first, ends)]
        self.before, self.size = first, len(values)

    def select(self, k: int) -> int:
        """The k-th offset in ascending order, counted from 0."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.names[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def boundaries(text: bytes) -> BoundarySet:
    """Code point offsets where a unit ``[^\\n]*\\n|[^\\n]+`` begins or ends, 0 and the text's length included."""
    data = np.frombuffer(text, dtype=np.uint8)
    points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and including each byte
    ends = points[data == 10]
    values = np.concatenate([[0], ends, points[-1:]]).astype(np.int64)
    return BoundarySet(values[:-1] if len(values) > 2 and values[-1] == values[-2] else values)


def restore(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text behind an output; no piece holds a marker, so the first find of each is the one that was put there."""
    if form == "plain":
        return output
    before, suffix, middle = markers
    if form == "psm":
        head, rest = output[len(before):].split(suffix, 1)
        tail, body = rest.split(middle, 1)
    else:
        tail, rest = output[len(suffix):].split(before, 1)
        head, body = rest.split(middle, 1)
    return head + body + tail


def _cut(text: bytes, key: object, seed: int, fim_percent: int, spm_percent: int, markers: tuple[str, str, str]) -> tuple:
    """(n, form, prefix length, middle length, output) of one text."""
    if not text:
        return 0, "plain", None, None, text
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))
    held = boundaries(text)
    n = held.size - 1
    if h3 % 100 >= fim_percent or any(m.encode() in text for m in markers):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = held.select(first), held.select(second)
    points = text.decode("utf-8", "surrogateescape")
    before, suffix, middle = markers
    form = "spm" if h4 % 100 < spm_percent else "psm"
    parts = (before, points[:a], suffix, points[b:]) if form == "psm" else (suffix, points[b:], before, points[:a])
    return n, form, a, b - a, "".join((*parts, middle, points[a:b])).encode("utf-8", "surrogateescape")


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())  # a view, as old texts need not be valid


def _cuts(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(1)):
            keys = batch.column(0).slice(first, last - first)
            rows = [_cut(t, k, **options) for t, k in zip(texts, keys.to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                                   _strings(list(output))], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
                   markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row per row of ``df``: its key, n units, the form (plain, psm or spm), prefix_chars, middle_chars and the output text.

    The cuts and the form follow from the SHA-256 of ``seed`` and the key alone, so they are
    the same on every run. Of all texts ``fim_percent`` % are cut, and of these
    ``spm_percent`` % get the suffix first. A text that holds a marker stays plain.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    cut = partial(_cuts, seed=seed, fim_percent=fim_percent, spm_percent=spm_percent, markers=markers)
    out = rows.mapInArrow(cut, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def _restored(batches: Iterator[pa.RecordBatch], markers: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        output, form = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
        for first, last, texts in ta.slices(output):
            back = [restore(t.decode("utf-8", "surrogateescape"), f, markers).encode("utf-8", "surrogateescape")
                    for t, f in zip(texts, form.slice(first, last - first).to_pylist())]
            rest = batch.slice(first, last - first)
            yield pa.record_batch([*rest.columns, _strings(back)], names=[*batch.schema.names, "restored"])


def restore_texts(df: DataFrame, form: str = "form", output: str = "output", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """The rows of a result of ``fill_in_middle`` with the text taken back from form and output alone, as ``restored``."""
    others = [c for c in df.columns if c not in (form, output)]
    rows = df.select(*others, form, output)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", restored string"
    return rows.mapInArrow(partial(_restored, markers=markers), schema)


@query("op11_fill_in_middle")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore_texts(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))
