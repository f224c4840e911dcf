"""Quality rules by repetition coverage.

For several n-gram lengths the share of a text's word characters that lie inside
repeated n-grams is measured with rolling hashes, and the share inside repeated
lines. A text fails when a share is above its limit, or when the base rules fail.
Texts are judged one by one: no shuffle, no state, and a lost executor costs its
running tasks only.

Defined cases: a null or empty text has no words and fails the base rule. Repeated
rows are judged each on its own. An empty table gives an empty result. Columns other
than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crashrisk.llm import textarrays as ta
from crashrisk.llm.registry import query

#: Largest share of word characters inside n-grams seen before in the text, by n (published Gopher limits).
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside all copies of the most frequent n-gram.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_CHARS_LIMIT = 0.20
#: The top n-gram rules judge texts in which it stands at least so many times, and all texts of so many words; in
#: shorter ones an n-gram that stands there just twice has a large share.
TOP_LEAST_TIMES, TOP_LEAST_WORDS = 3, 100

SHARES = ([f"dup_{n}" for n in DUPLICATE_LIMITS] + [f"top_{n}" for n in TOP_LIMITS] + ["dup_line_chars"])
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its value, is there an equal value before it), by one sort; -1 where the value occurs once."""
    number, before = np.full(len(values), -1, dtype=np.int64), np.zeros(len(values), dtype=bool)
    if len(values) > 1:
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        before[order[1:]] = same
        again = np.zeros(len(values), dtype=bool)
        again[1:] = same
        again[:-1] |= same
        group = np.cumsum(~np.concatenate([[False], same]))
        number[order] = np.where(again, group, -1)
    return number, before


def _covered(at: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Words inside any of the windows of ``width`` words that start at ``at``."""
    opened = np.bincount(at, minlength=n_words + 1) - np.bincount(at + width, minlength=n_words + 1)[:n_words + 1]
    return np.cumsum(opened[:n_words]) > 0


def _most_frequent(number: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Members of the most frequent repeated value of each text; of ties, the value that occurs first."""
    held = np.flatnonzero(number >= 0)
    if not len(held):
        return held
    kinds, first, counts = np.unique(number[held], return_index=True, return_counts=True)
    texts = owner[held[first]]
    order = np.lexsort((first, -counts, texts))
    best = order[np.concatenate([[True], texts[order[1:]] != texts[order[:-1]]])]
    return held[np.isin(number[held], kinds[best])]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts and shares of every text, as one array per column, and how often its top n-grams stand there (``n_top_``)."""
    n_texts = len(texts)
    data, starts = ta.joined(texts)
    first, end = ta.word_bounds(data)
    n = len(first)
    sums = ta.prefix_sums(data)
    hashes = ta.range_hashes(sums, first, end)
    bounds = ta.owner_bounds(first, starts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n_texts), n_words)
    # a code point is any byte that does not continue another
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[first]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    per_text = partial(np.bincount, minlength=n_texts)
    word_chars = per_text(owner, weights=chars)
    share = lambda inside: per_text(owner[inside], weights=chars[inside]) / np.maximum(word_chars, 1)
    salt = ta.mix(np.arange(1, n_texts + 1, dtype=np.uint64))  # equal grams of two texts must not meet

    out = {"n_words": n_words, "word_chars": word_chars.astype(np.int64),
           "n_symbols": symbols[starts[1:]] - symbols[starts[:-1]],
           "n_dup_lines": np.zeros(n_texts, np.int64), "n_repeat_words": np.zeros(n_texts, np.int64)}
    out |= {c: np.zeros(n_texts) for c in SHARES}

    feeds = np.flatnonzero(data == 10)  # each text's last line ends with the feed put after the text
    kinds, line_of = np.unique(np.searchsorted(feeds, first), return_inverse=True)
    if n:
        line_starts = np.concatenate([[0], feeds[:-1] + 1])[kinds]
        line_owner = np.searchsorted(starts, line_starts, side="right") - 1
        _, again = _repeats(ta.range_hashes(sums, line_starts, feeds[kinds]) ^ salt[line_owner])
        out["n_dup_lines"] = per_text(line_owner[again])
        out["dup_line_chars"] = share(again[line_of])

    possible = np.ones(n, dtype=bool)  # a longer gram repeats only where the two shorter ones inside it do
    for width in range(2, 11):
        at = np.flatnonzero(possible[:max(0, n - width + 1)])
        at = at[owner[at] == owner[at + width - 1]] if len(at) else at
        grams = ta.window_hashes(hashes, width)[at] ^ salt[owner[at]]
        number, before = _repeats(grams)
        if width in TOP_LIMITS:
            top = at[_most_frequent(number, owner[at])]
            out[f"top_{width}"] = share(_covered(top, width, n))
            out[f"n_top_{width}"] = per_text(owner[top])
        if width in DUPLICATE_LIMITS:
            out[f"dup_{width}"] = share(_covered(at[before], width, n))
        repeated = at[number >= 0]
        if width == 5:
            out["n_repeat_words"] = per_text(owner[_covered(repeated, 5, n)])
        possible = np.zeros(n, dtype=bool)
        possible[repeated] = True
        possible[:-1] &= possible[1:]
        possible[-1:] = False
    return out


def verdict(figures: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the base rules fail, the text is kept)."""
    n_words = figures["n_words"]
    failed = (n_words < 10) | (100 * figures["n_repeat_words"] > 20 * n_words)
    kept = ~failed & (figures["dup_line_chars"] <= LINE_CHARS_LIMIT)
    for n, limit in DUPLICATE_LIMITS.items():
        kept &= figures[f"dup_{n}"] <= limit
    for n, limit in TOP_LIMITS.items():
        kept &= (figures[f"top_{n}"] <= limit) | (figures[f"n_top_{n}"] < TOP_LEAST_TIMES) & (n_words < TOP_LEAST_WORDS)
    return failed, kept


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(1)):
            figures = measure(texts)
            yield pa.record_batch(
                [batch.column(0).slice(first, last - first)] + [pa.array(figures[c], pa.int64()) for c in _COUNTS]
                + [pa.array(flags) for flags in verdict(figures)] + [pa.array(figures[c], pa.float64()) for c in SHARES],
                names=[key, *_COUNTS, "base_failed", "kept", *SHARES])


def repetition_rules(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, the counts, the shares of repeated text and the verdict ``kept``."""
    fields = df.select(key).schema.fields[0].dataType.simpleString()
    schema = (f"`{key}` {fields}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, kept boolean, "
              + ", ".join(f"{c} double" for c in SHARES))
    return df.select(key, text).mapInArrow(partial(_batches, key=key), schema)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
