"""Packing token pieces into sequences of fixed capacity.

Pattern packing by non-negative least squares: patterns of up to three documents fill
a sequence; how often each is used is fitted to the histogram of lengths, rounded down,
and what is left over is packed by best fit into the gaps and into new sequences.
The plan is made from the histogram alone, which has at most `capacity` entries; the
pieces themselves are numbered within their length and joined to the plan.
"""

from __future__ import annotations

import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import chunks_for, documents, number_rows, salted, ship, slices, stash

CAPACITY = 4096
END_ID = 1
#: Patterns are enumerated over lengths rounded up to multiples of capacity / GRID.
GRID = 128
#: Bytes of a worker's table of parts of words; a full one goes, and starts again with what the next batch has.
CACHED_BYTES = 8 << 20
#: Parts of words that are given to the vocabulary as one text.
LINE = 256


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after another, and where each begins and the last ends."""
    _, at, data = strings.buffers()
    bounds = np.frombuffer(at, np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _of_pairs(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each byte what `table` says of it and of the one before."""
    pairs = data.astype(np.uint16)
    pairs[1:] |= data[:-1].astype(np.uint16) << 8
    return table[pairs]


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place, and at the end."""
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `ids` of these places and sizes, one after another, and where each begins and the last ends."""
    bounds = _before(sizes)
    kind = np.int32 if max(bounds[-1], len(ids)) < 2**31 else np.int64
    places = np.repeat((starts - bounds[:-1]).astype(kind), sizes)
    places += np.arange(bounds[-1], dtype=kind)
    return ids[places], bounds


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what stands on both sides of it, so a
    text's ids are those of its words, one after another. Words of ASCII characters and of
    Latin letters up to U+023F need no normalizing but lower case and fall apart into runs of
    letters, runs of other marks, and single digits: these parts are encoded many at a time,
    by the vocabulary alone, where each ends with its only token that is a word's end. Other
    words, those with apostrophes, combining marks or the vocabulary's own marks among them,
    are encoded whole by the tokenizer. Parts and whole words are kept in a table.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        # the vocabulary's character for each byte
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(b) for b in range(256)]
        for c in map(chr, range(0x800)):
            for b, letter in zip(c.encode(), as_bytes.pre_tokenize_str(c)[0][0], strict=True):
                letters[b] = letter
        letters[0x20] = " "
        self.letters = "".join(letters)
        # by the byte before and the byte: whether a part begins there, and whether the word is for the tokenizer
        kind = np.array([1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)])
        self.begins = ((kind[:, None] != kind) | (kind == 2)).ravel()
        odd = np.zeros((256, 256), bool)
        odd[:, [b for b in range(256) if b <= 0x20 or b in b"'\x7f\xc2" or b >= 0xC9 or not {letters[b], letters[b] + "</w>"} <= vocabulary.keys()]] = True
        for before, b in map(str.encode, ("<|", "×", "÷", "İ", "Ⱥ", "Ⱦ")):  # no letters, or of another length in lower case
            odd[before, b] = True
        self.odd = odd.ravel()
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.bounds = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Words are split and numbered by Arrow; each that a batch has is encoded once, and its ids are gathered by place."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        words = split.flatten().dictionary_encode()
        ids, starts, sizes = self._of_words(words.dictionary.cast(pa.string()))
        at = words.indices.to_numpy()
        ids, bounds = _gathered(ids, starts[at], sizes[at])
        data = ids.tobytes()
        ends = (bounds[split.offsets.to_numpy()] * 4).tolist()
        return list(map(data.__getitem__, map(slice, ends[:-1], ends[1:])))

    def _is_odd(self, words: pa.Array) -> np.ndarray:
        data, bounds = _bytes(words)
        return np.diff(_before(_of_pairs(data, self.odd))[bounds]) > 0

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each word start and how many they are."""
        odd = self._is_odd(words)
        data, bounds = _bytes(pc.utf8_lower(words.filter(pa.array(~odd))))
        begins = _of_pairs(data, self.begins)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        whole = words.filter(pa.array(odd))
        plain = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        parts = pa.concat_arrays([plain, whole]).dictionary_encode()
        at = self._places(parts.dictionary)[parts.indices.to_numpy()]
        ids, ends = _gathered(self.ids, self.bounds[at], self.bounds[at + 1] - self.bounds[at])
        ends = ends[np.concatenate((_before(begins)[bounds], np.arange(len(plain) + 1, len(parts) + 1)))]
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        order = np.argsort(odd, kind="stable")
        starts[order], sizes[order] = ends[:-1], np.diff(ends)
        return ids, starts, sizes

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each part stands in the table; new ones are learnt."""
        if self.known.nbytes + self.ids.nbytes + self.bounds.nbytes > CACHED_BYTES:
            self._forget()
        found = pc.index_in(parts, self.known)
        places, new = pc.fill_null(found, -1).to_numpy().astype(np.int64), found.is_null()
        if found.null_count:
            places[places < 0] = len(self.known) + self._learn(parts.filter(new))
        return places

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Adds the parts to the table, and says how many of them stand before each there."""
        odd = self._is_odd(new)
        plain, whole = new.filter(pa.array(~odd)), new.filter(pa.array(odd))
        lines = pa.ListArray.from_arrays(pa.array([*range(0, len(plain), LINE), len(plain)], pa.int32()), plain)
        lines = pc.binary_join(lines, " ").cast(pa.binary()).to_pylist()
        made = self._ids([charmap_decode(x, "strict", self.letters)[0] for x in lines], self.words)
        own = self._ids(whole.to_pylist(), self.tokenizer)
        ids = np.concatenate([np.zeros(0, "<u4"), *made])
        ends = np.concatenate((np.flatnonzero(self.ends[ids]) + 1, len(ids) + np.cumsum([len(x) for x in own], dtype=np.int64)))
        if len(ends) != len(new):
            raise ValueError("a part of a word has no token that ends it")
        self.known = pa.concat_arrays([self.known, plain, whole])
        self.bounds = np.concatenate((self.bounds, len(self.ids) + ends))
        self.ids = np.concatenate([self.ids, ids, *own])
        places = np.empty(len(new), np.int64)
        places[np.argsort(odd, kind="stable")] = np.arange(len(new))
        return places

    def _ids(self, texts: list[str], tokenizer: object) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every row's tokens: key, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A row's tokens are those of its whole text (null: empty), then the end id; rows of
    more than `capacity` tokens are cut, so every row gives at least one piece.
    """
    ship(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = _encoder(path), np.array([END_ID], "<u4").tobytes(), capacity * 4
        for batch in slices(batches):
            out, ids = [], []
            for doc, data in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                data = memoryview(data + end)
                for piece, at in enumerate(range(0, len(data), width)):
                    own = data[at : at + width]
                    out.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names, types = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = f"{key} long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(cut, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set: free variables are solved for, and those that fall below 0 are set back."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds):
        if free.all() or gradient[~free].max() <= tolerance:
            break
        free[np.argmax(np.where(free, -np.inf, gradient))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x, gradient = s, a.T @ (b - a @ s)
    return x


def patterns(grid: int) -> list[tuple[int, ...]]:
    """Descending lengths of one to three documents that fill the grid."""
    two = [(i, grid - i) for i in range(grid - 1, (grid - 1) // 2, -1)]
    three = [(i, j, grid - i - j) for i in range(grid - 2, 0, -1) for j in range(min(i, grid - i - 1), 0, -1) if j >= grid - i - j]
    return [(grid,), *two, *three]


def _take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """n documents off the runs [length, count] of a bin, longest first."""
    out = []
    while n:
        length, left = runs[-1]
        k = min(left, n)
        out.append((length, k))
        n -= k
        runs[-1][1] -= k
        if runs[-1][1] == 0:
            runs.pop()
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Groups (count, lengths): so many sequences that hold documents of these lengths.

    Its work depends on the number of distinct lengths, not on that of the documents.
    """
    unit = -(-capacity // GRID)
    bins: dict[int, list[list[int]]] = {}
    for length in sorted(histogram):
        if histogram[length]:
            bins.setdefault(-(-length // unit), []).append([length, histogram[length]])
    left = np.zeros(GRID + 1, np.int64)
    for b, runs in bins.items():
        left[b] = sum(n for _, n in runs)
    shapes = [p for p in patterns(capacity // unit) if all(left[b] for b in p)]
    groups: list[tuple[int, list[int]]] = []
    if shapes:
        a = np.zeros((GRID + 1, len(shapes)))
        for j, p in enumerate(shapes):
            for b in p:
                a[b, j] += 1
        weight = np.arange(GRID + 1) / GRID  # a long document left over costs more
        fitted = nnls(a * weight[:, None], left * weight)
        for j in np.argsort(-fitted, kind="stable"):
            used = a[:, j] > 0
            n = int(min(np.floor(fitted[j]), (left[used] // a[used, j]).min()))
            if n <= 0:
                continue
            slots = [_take(bins[b], n) for b in shapes[j]]
            left -= n * a[:, j].astype(np.int64)
            ends = sorted({e for s in slots for e in np.cumsum([k for _, k in s]).tolist()})
            at, cursor, used_up = 0, [0] * len(slots), [0] * len(slots)
            for e in ends:
                k = e - at
                groups.append((k, [s[cursor[i]][0] for i, s in enumerate(slots)]))
                for i, s in enumerate(slots):
                    used_up[i] += k
                    if used_up[i] == s[cursor[i]][1]:
                        cursor[i], used_up[i] = cursor[i] + 1, 0
                at = e
    rest = sorted(((length, n) for runs in bins.values() for length, n in runs), reverse=True)
    return _best_fit(groups, rest, capacity)


def _best_fit(groups: list[tuple[int, list[int]]], rest: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Packs what is left, longest first, into the smallest gap that takes it, or else into new sequences."""
    by_gap: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)

    def put(n: int, lengths: list[int]) -> None:
        gap = capacity - sum(lengths)
        by_gap[gap].append((n, lengths))
        filled[gap] = True

    for n, lengths in groups:
        put(n, lengths)
    for length, n in rest:
        while n:
            gap = length + int(np.argmax(filled[length:]))
            if not filled[gap]:
                each = capacity // length
                if n >= each:
                    put(n // each, [length] * each)
                if n % each:
                    put(1, [length] * (n % each))
                n = 0
                continue
            count, lengths = by_gap[gap].pop()
            filled[gap] = bool(by_gap[gap])
            each = min(gap // length, max(1, n // count))
            k = min(count, n // each)
            if count > k:
                put(count - k, lengths)
            put(k, lengths + [length] * each)
            n -= k * each
    return [x for own in by_gap for x in own]


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to `pieces`, which have lengths from 1 to `capacity`.

    The histogram of lengths goes to the driver (`capacity` rows at most) and the plan
    comes back as a table whose size depends on `capacity` alone. Pieces are numbered
    within their length, in chunks, so that a length that many share is no single task's;
    equal numbers in `order` get places of their own. An empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rows, base, ranks = [], 0, dict.fromkeys(histogram, 0)
    for n, lengths in plan(histogram, capacity):
        at = 0
        for x in lengths:
            rows.append((x, ranks[x], ranks[x] + n, base, at))
            ranks[x] += n
            at += x
        base += n
    names = ["length", "low", "high", "base", "offset"]
    slots = pd.DataFrame(np.array(rows, np.int64).reshape(-1, 5), columns=names)
    own = slots.groupby("length").agg(n=("high", "max"), k=("low", "size"))
    width = (-(-own.n // own.k)).clip(lower=1)
    # each interval of numbers stands in every cell that it meets, so that a piece finds it by equality
    wide = slots["length"].map(width)
    first, last = slots.low // wide, (slots.high - 1) // wide
    times = (last - first + 1).astype(int)
    cells = slots.loc[slots.index.repeat(times)].reset_index(drop=True)
    cells["cell"] = (first.repeat(times).to_numpy() + np.arange(len(cells)) - (times.cumsum() - times).repeat(times).to_numpy()) if len(cells) else []
    fields = ["length", "cell", "low", "high", "base", "offset"]
    to_spark = lambda frame, columns: spark.createDataFrame(pa.table({c: pa.array(frame[c].to_numpy(np.int64)) for c in columns}))
    widths = to_spark(width.rename("width").reset_index(), ["length", "width"]).withColumnRenamed("length", "__length")
    table = to_spark(cells, fields).withColumnsRenamed({"length": "__length", "low": "__low", "high": "__high", "base": "__base", "cell": "__cell"})
    chunks = chunks_for(sum(histogram.values()), 20_000)
    pieces = pieces.drop("offset", "sequence_id").withColumn("__length", F.col(length).cast("long"))
    ranked = number_rows(pieces, ["__length"], salted(chunks, *[F.col(c) for c in order]), [F.col(c) for c in order], "__rank")
    placed = ranked.join(widths, "__length").withColumn("__cell", F.floor(F.col("__rank") / F.col("width")))
    placed = placed.join(table, ["__length", "__cell"]).where("__rank >= __low and __rank < __high")
    placed = placed.withColumn("sequence_id", F.col("__base") + F.col("__rank") - F.col("__low"))
    return placed.drop("__length", "__cell", "__rank", "__low", "__high", "__base", "width")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    pieces = stash(token_pieces(documents(spark, sf_dir), default_tokenizer()), "pieces")
    packed = pack(pieces, ["doc_id", "piece"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
