"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary is counted with DataFrame functions. Blocked Bloom filters (one 64-bit word a key) are
sharded by word length; a large length is split further by hash. A pass takes as many shards as fit
``FILTER_BYTES``, broadcasts them and probes every edit that leads into them, so what is broadcast has
a fixed size and a larger vocabulary takes more passes. Hashes are polynomial, so that an edit costs
one step, vectorised with numpy. Of two words the one with the smaller letter generates the
replacement and the longer one the deletion: each pair comes up once. Positives are joined with the
vocabulary, which removes the false ones. Forms are followed level by level from the roots down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from peakloom.llm.common import ascii_lower, stored

LETTERS = "a-zÀ-ÿ"
SLIP = 97
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 5, 3, 2
#: Filter bits a key, bits set by a key, and the bytes of all filters of one pass.
BITS_PER_KEY, PROBES, FILTER_BYTES = 32, 6, 16 << 20
#: Lengths from here on share filters.
LONG = 48
#: Edits that are hashed at once.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[{LETTERS}]+"), F.lit(0))


def slipped(doc: Column, run: Column, every: int = SLIP) -> Column:
    """The run without one letter where ``every`` divides the checksum of document and run, else the run."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of whole texts, counted over all documents."""
    runs = docs.select(F.col(id_col).alias("doc"), F.explode(words_of(F.col(text_col))).alias("run")).filter(F.char_length("run") >= min_letters)
    words = runs.select(slipped(F.col("doc"), F.col("run")).alias("word")).filter(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# --- hashes and filters ---------------------------------------------------------------------


def _class(length: int) -> int:
    """The filter family of a word length; there are at most 2 * LONG."""
    return length if length < LONG else LONG + length % LONG


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(length, BASE)]).cumprod(dtype=np.uint64)


class Shard(NamedTuple):
    """A filter: ``blocks`` words from ``offset`` for hashes of one class whose part is ``part`` of ``parts``."""

    part: int
    parts: int
    offset: int
    blocks: int


Layout = dict[int, list[Shard]]


def plan_passes(counts: dict[int, int], filter_bytes: int = FILTER_BYTES) -> list[Layout]:
    """Filters for the key counts of all classes, dealt to passes of at most ``filter_bytes`` each."""
    most = max(1, filter_bytes // 8)
    passes, used = [{}], 0
    for cls, n in sorted(counts.items()):
        blocks = -(-n * BITS_PER_KEY // 64)
        parts = -(-blocks // most)
        each = -(-blocks // parts)
        for part in range(parts):
            if used + each > most:
                passes.append({})
                used = 0
            passes[-1].setdefault(cls, []).append(Shard(part, parts, used, each))
            used += each
    return [p for p in passes if p]


def _places(h: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(belongs to the shard, block, bits to be set) of polynomial hashes."""
    z = _mixed(h)
    inside = np.ones(len(z), bool) if shard.parts == 1 else (z & np.uint64(0xFFFF)) % np.uint64(shard.parts) == shard.part
    block = (((z >> np.uint64(32)) * np.uint64(shard.blocks)) >> np.uint64(32)).astype(np.int64) + shard.offset
    y = _mixed(z + BASE)
    bits = np.zeros(len(z), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((y >> np.uint64(6 * i)) & np.uint64(63))
    return inside, block, bits


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, code points as a matrix) for the words of a batch."""
    texts = np.array(words.to_pylist(), dtype=object)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(texts[rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
        yield int(length), rows, codes.astype(np.uint64)


def _filter_rows(layout: Layout):
    """mapInArrow: (block, bits) of the words whose shard is in the layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in _by_length(batch.column(0)):
                h = (codes * _powers(length)[:-1]).sum(axis=1, dtype=np.uint64)
                for shard in layout.get(_class(length), ()):
                    inside, block, bits = _places(h, shard)
                    yield pa.RecordBatch.from_pydict({"block": pa.array(block[inside]), "bits": pa.array(bits[inside].view(np.int64))})

    return run


def build_filter(vocab: DataFrame, layout: Layout) -> np.ndarray:
    """The filters of one pass, put together on the driver: their size is bounded by the layout."""
    n = max(s.offset + s.blocks for shards in layout.values() for s in shards)
    rows = vocab.select("word").mapInArrow(_filter_rows(layout), "block long, bits long")
    found = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n, np.int64)
    out[found.column("block").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(change of length, hashes, word, position, letter) of the edits of words of one length, in chunks.

    Replacements by a larger letter (change 0) and deletions of the first letter of a run (change -1).
    """
    m, length = codes.shape
    power = _powers(length)
    terms = codes * power[:-1]
    before = np.concatenate([np.zeros((m, 1), np.uint64), terms.cumsum(axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    first = np.ones((m, length), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    word, at = np.nonzero(first)
    for s in range(0, len(word), CHUNK):
        w, i = word[s : s + CHUNK], at[s : s + CHUNK]
        yield -1, before[w, i] + (whole[w, 0] - before[w, i + 1]) * INVERSE, w, i, np.zeros(len(w), np.uint64)
    step = max(1, CHUNK // len(alphabet))
    flat = codes.ravel()
    for s in range(0, m * length, step):
        spots = np.arange(s, min(s + step, m * length))
        spot, letter = np.nonzero(alphabet[None, :] > flat[spots, None])
        w, i, c = spots[spot] // length, spots[spot] % length, alphabet[letter]
        yield 0, whole[w, 0] + (c - codes[w, i]) * power[i], w, i, c


def _spelled(codes: np.ndarray, change: int, w: np.ndarray, i: np.ndarray, c: np.ndarray) -> list[str]:
    """The edited words."""
    rows = codes[w].astype(np.uint32)
    length = rows.shape[1] + change
    if change:
        keep = np.arange(rows.shape[1])[None, :] != i[:, None]
        rows = rows[keep].reshape(len(w), length)
    else:
        rows[np.arange(len(w)), i] = c
    text = np.ascontiguousarray(rows).tobytes().decode("utf-32-le")
    return [text[k : k + length] for k in range(0, len(text), length)]


def _positives(layout: Layout, filters, alphabet: np.ndarray, min_letters: int):
    """mapInArrow: (near, word, n) for every edit that its filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = filters.value
        for batch in batches:
            for length, rows, codes in _by_length(batch.column(0)):
                words, counts = batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))
                for change, h, w, i, c in _edits(codes, alphabet):
                    if length + change < min_letters:
                        continue
                    for shard in layout.get(_class(length + change), ()):
                        inside, block, bits = _places(h, shard)
                        hit = np.flatnonzero(inside & ((bits_of[block] & bits) == bits))
                        if len(hit):
                            near = _spelled(codes, change, w[hit], i[hit], c[hit])
                            at = pa.array(w[hit])
                            yield pa.RecordBatch.from_pydict({"near": pa.array(near, pa.string()), "word": words.take(at), "n": counts.take(at)})

    return run


# --- pairs, forms and roots -------------------------------------------------------------------


def near_pairs(vocab: DataFrame, filter_bytes: int = FILTER_BYTES, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n, near, near_n): every pair of words of a stored vocabulary that are one edit apart, once."""
    spark = vocab.sparkSession
    length = F.char_length("word")
    cls = F.when(length < LONG, length).otherwise(length % LONG + LONG)
    counts = {r[0]: r[1] for r in vocab.groupBy(cls.alias("cls")).agg(F.count(F.lit(1))).collect()}
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    # letters come from the pattern, so there are at most 90
    alphabet = np.array(sorted(ord(r[0]) for r in letters.collect()), np.uint64)
    found = []
    for layout in plan_passes(counts, filter_bytes):
        filters = spark.sparkContext.broadcast(build_filter(vocab, layout))
        positives = vocab.mapInArrow(_positives(layout, filters, alphabet, min_letters), "near string, word string, n long")
        found.append(stored(positives.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"), "near-pairs"))
        filters.unpersist()
    empty = spark.createDataFrame([], "near string, word string, n long, near_n long")
    return reduce(DataFrame.unionByName, found, empty).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, root) of every word, from (word, form): level by level from the words without a form.

    A form has at least twice the count, so there are no cycles and at most log2 of the largest count
    levels. A word has a bounded number of near words, so no join key is hot.
    """
    level = stored(vocab.join(forms.select("word"), "word", "left_anti").select("word", F.col("word").alias("root")), "roots")
    levels = [level]
    while not level.isEmpty():
        above = level.select(F.col("word").alias("form"), "root")
        level = stored(forms.join(above, "form").select("word", "root"), "roots")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def spelling_forms(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    ratio: int = FORM_RATIO, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``min_letters`` or more with ``min_count`` occurrences.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word with
    most occurrences (ties: first in code-point order) if that has at least ``ratio`` times its own (``ratio``
    > 1); ``root`` follows the forms to the last. Null texts have no words, a null id counts as empty, repeated
    rows count each, words of any length are compared whole; no words give no rows. Other columns are not read.
    """
    vocab = stored(vocabulary(docs, id_col, text_col, min_letters, min_count), "vocabulary")
    pairs = near_pairs(vocab, filter_bytes, min_letters)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = -F.col("best.less") >= F.col("n") * ratio
    linked = stored(best.select("word", "n_near", F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(linked.filter("form is not null").select("word", "form"), vocab.select("word"))
    joined = vocab.join(linked, "word", "left").join(last, "word")
    return joined.select("word", "form", "root", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
