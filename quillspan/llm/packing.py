"""Best-fit packing: pattern packing by non-negative least squares, then best fit for the residual.

Documents are tokenised and cut in one pass.  Lengths are interchangeable, so
the plan is made from the histogram of piece lengths alone (at most ``limit``
bins, whatever the corpus): the lengths are binned by quantiles of their tokens,
patterns of one or two bins that fill a sequence are fitted to the histogram by
non-negative least squares, their repeat counts rounded down, and all other
pieces placed best-fit, longest first, into what is left.  Where best fit alone
needs fewer sequences, its plan is taken.  Spark then gives every piece its rank
among the pieces of its length and looks its place up in the plan.
"""

from __future__ import annotations

import bisect
import math
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import vectext as V
from quillspan.llm.tables import cut

LIMIT = 4096
END_ID = 1
#: Bins of lengths that patterns are enumerated over, and the documents of a pattern's first bin at most; its second bin fills it up.
BINS = 32
PATTERN_DOCS = 6
#: Shares of the fitted repeats that are tried, the largest that costs no sequence wins: best fit needs pieces of all lengths for the rest.
SHARES = (1.0, 0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)
#: Distinct words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Bytes of text that are split at once.
SLICE_BYTES = 6 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Classes of Latin-1 characters in the tokenizer's own split (fixed by its file): blank, letter, number, other.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[*range(9, 14), 0x20, 0x85, 0xA0]] = 0
_CLASS[[*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
_TOKENIZERS: dict[str, _Words] = {}


class _Words:
    """A tokenizer with the ids of the words it has met, kept end to end."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        last = self.tokenizer.pre_tokenizer[1]
        #: The byte-level letters of each Latin-1 character.
        self.letters = {c: "".join(t for t, _ in last.pre_tokenize_str(chr(c))) for c in range(0x100)}
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = array("I")
        self.begin = array("q", [0])

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def latin(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts: split with numpy, each distinct word encoded once."""
        data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        starts, ends = _split(buf)
        _, one, inverse = np.unique(V.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > CACHE_WORDS:
            self.clear()
        where = np.empty(len(one), dtype=np.int64)
        place, begin, ids, model, letters = self.place, self.begin, self.ids, self.model, self.letters
        for i, (a, b) in enumerate(zip(starts[one].tolist(), ends[one].tolist())):
            word = data[a:b]
            at = place.get(word)
            if at is None:
                at = place[word] = len(begin) - 1
                ids.extend([t.id for t in model.tokenize(word.decode("latin-1").translate(letters))])
                begin.append(len(ids))
            where[i] = at
        offsets = np.array(begin)
        word = where[inverse.reshape(-1)]
        counts = offsets[word + 1] - offsets[word]
        after = np.cumsum(counts)
        flat = np.array(ids, dtype="<u4")[np.arange(after[-1] if len(after) else 0) + np.repeat(offsets[word] - after + counts, counts)]
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        bounds = 4 * np.concatenate([[0], after])[first]
        out = flat.tobytes()
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _split(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words in lower-cased Latin-1: English endings, letter runs, single numbers, runs of the rest."""
    kind = _CLASS[buf]
    edge = np.ones(len(buf), dtype=bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # An apostrophe that begins a word takes a following s, t, m, d, re, ve or ll.
    at = np.flatnonzero((buf == 0x27) & edge)
    if len(at):
        padded = np.concatenate([buf, np.zeros(2, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        three = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        for found, size in ((at[short], 2), (at[three], 3)):
            edge[found + 1] = False
            edge[found + size] = True
    marks = np.append(np.flatnonzero(edge), len(buf))
    solid = kind[marks[:-1]] != 0
    return marks[:-1][solid], marks[1:][solid]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit.

    A word's ids do not depend on its neighbours, so each is encoded once and
    kept.  Latin-1 texts without special tokens are split here as the tokenizer
    splits them; all others go to the whole tokenizer.
    """
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Words(path)
    known = _TOKENIZERS[path]
    out: list[bytes] = [b""] * len(texts)
    plain: list[int] = []
    latin: list[bytes] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        try:
            if "<|" in text:
                raise ValueError
            latin.append(text.lower().encode("latin-1"))
            plain.append(i)
        except ValueError:  # also what cannot be encoded
            out[i] = known.whole(text)
    if latin:
        for i, ids in zip(plain, known.latin(latin)):
            out[i] = ids
    return out


def _cut_pieces(path: str, limit: int, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text", SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_bytes(batch.column("text").to_pylist(), path)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises |a x - b| (Lawson and Hanson's active set)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    gram, atb = a.T @ a, a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0.0)))
    for _ in range(3 * a.shape[0] + n):
        w = np.where(free, -np.inf, atb - gram @ x)
        j = int(np.argmax(w))
        if w[j] <= tiny:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                x = s
                break
            low = free & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            drop = free & (x <= 1e-12)
            free[drop] = False
            x[drop] = 0
            if not free.any():
                break
    return x


def patterns(tops: list[int], limit: int, most: int) -> list[dict[int, int]]:
    """How many pieces of which bins fill a sequence: up to ``most`` of one bin, then of another as many as fit; ``tops`` are the bins' longest."""
    out = {tuple([(i, limit // n)]) for i, n in enumerate(tops)}
    for i, n in enumerate(tops):
        for k in range(1, min(most, limit // n) + 1):
            for j, m in enumerate(tops):
                rest = (limit - k * n) // m
                if j != i and rest:
                    out.add(tuple(sorted([(i, k), (j, rest)])))
    return [dict(x) for x in sorted(out)]


def quantile_bins(histogram: dict[int, int], bins: int) -> list[list[int]]:
    """The lengths, ascending, in up to ``bins`` runs of about equal token counts."""
    lengths = sorted(histogram)
    tokens = np.cumsum([n * histogram[n] for n in lengths])
    at = np.minimum((tokens - 1) * bins // max(1, tokens[-1]), bins - 1) if lengths else []
    out: dict[int, list[int]] = defaultdict(list)
    for n, k in zip(lengths, at):
        out[int(k)].append(n)
    return [out[k] for k in sorted(out)]


class _Open:
    """Sequences with room, by the room: [lengths, how many]."""

    def __init__(self, limit: int):
        self.limit = limit
        self.groups: dict[int, list[list]] = defaultdict(list)

    def put(self, lengths: tuple[int, ...], count: int) -> None:
        self.groups[self.limit - sum(lengths)].append([lengths, count])

    def best_fit(self, left: dict[int, int]) -> None:
        """Places all that is left, longest first, where it leaves the least room."""
        for n in sorted((n for n, c in left.items() if c), reverse=True):
            c = left[n]
            while c:
                room = min((r for r in self.groups if r >= n), default=None)
                if room is None:
                    each = self.limit // n
                    if c // each:
                        self.put((n,) * each, c // each)
                    if c % each:
                        self.put((n,) * (c % each), 1)
                    break
                group = self.groups[room][-1]
                times = min(room // n, max(1, c // group[1]))
                used = min(group[1], c // times)
                group[1] -= used
                if not group[1]:
                    self.groups[room].pop()
                    if not self.groups[room]:
                        del self.groups[room]
                self.put(group[0] + (n,) * times, used)
                c -= used * times

    def sequences(self) -> list[tuple[tuple[int, ...], int]]:
        return [(tuple(lengths), count) for groups in self.groups.values() for lengths, count in groups]


def fit_patterns(left: dict[int, int], open_: _Open, limit: int, bins: int, most: int, share: float) -> int:
    """Moves what a share of the fitted patterns places, sequences without room, from ``left`` to ``open_``; how many pieces that is."""
    held = quantile_bins(left, bins)
    bin_of = {n: i for i, lengths in enumerate(held) for n in lengths}
    lengths = sorted(left)
    shapes = patterns([b[-1] for b in held], limit, most)
    if not shapes:
        return 0
    a = np.zeros((len(held), len(shapes)))
    for j, shape in enumerate(shapes):
        for i, k in shape.items():
            a[i, j] = k
    b = np.array([sum(left[n] for n in x) for x in held], dtype=float)
    # A bin counts by its tokens, as what is missed of short pieces fills gaps later.
    weight = np.array([float(x[-1]) for x in held]) / limit
    x = nnls(a * weight[:, None], b * weight)
    placed = 0
    for j in np.argsort(-x):
        repeats = int(share * x[j] + 1e-9)
        while repeats > 0:
            # The longest that are left of each bin, as often as the rarest of them allows.
            want: dict[int, int] = defaultdict(int)
            for i, k in shapes[j].items():
                for n in reversed(held[i]):
                    take = min(k, left[n])
                    if take:
                        want[n] += take
                        k -= take
                    if not k:
                        break
                if k:
                    want.clear()
                    break
            if not want:
                break
            # The bins' longest stand for all of a bin: what shorter pieces leave open is filled, longest first.
            room = limit - sum(n * k for n, k in want.items())
            at = bisect.bisect_right(lengths, room)
            while at:
                n = lengths[at - 1]
                if left[n] > want.get(n, 0):
                    want[n] += 1
                    room -= n
                    at = min(at, bisect.bisect_right(lengths, room))
                else:
                    at -= 1
            if room:
                break
            times = min([repeats, *(left[n] // k for n, k in want.items())])
            for n, k in want.items():
                left[n] -= times * k
                if not left[n]:
                    lengths.remove(n)
                    held[bin_of[n]].remove(n)
            open_.put(tuple(n for n, k in want.items() for _ in range(k)), times)
            placed += times * sum(want.values())
            repeats -= times
    return placed


def plan(histogram: dict[int, int], limit: int = LIMIT, bins: int = BINS, most: int = PATTERN_DOCS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (piece lengths in order, how many such sequences); uses up the histogram exactly.

    Best fit alone is the last of the plans; of those with fewest sequences the
    one with the largest share of patterns is taken.
    """
    counts = {n: c for n, c in histogram.items() if c}
    plans = []
    for share in (*SHARES, 0.0):
        left, open_ = dict(counts), _Open(limit)
        if share:
            fit_patterns(left, open_, limit, bins, most, share)
        open_.best_fit(left)
        plans.append(open_.sequences())
    return min(plans, key=lambda sequences: sum(count for _, count in sequences))


def _lookup(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), the first sequence's number and the offset there, for each slot of the plan."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, count in sequences:
        at = 0
        for n in lengths:
            rows.append(((n << 44) + taken[n], base - taken[n], at))
            taken[n] += count
            at += n
        base += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).columns
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(base[at] + rank), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Reads only ``doc_id`` and ``text``.  A null or empty text is the end id
    alone.  Repeated rows are packed each; a null ``doc_id`` stays null.  An
    empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(texts.mapInArrow(_cut_pieces(tokenizer_path, limit, end_id), _PIECES), "pieces")
    spark = docs.sparkSession
    # At most ``limit`` rows, however large the corpus.
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    shared = spark.sparkContext.broadcast(_lookup(plan(histogram, limit)))
    # Ranks within a length: numbered within buckets, so that no length is one task's, and shifted by the buckets before.
    buckets = math.isqrt(sum(histogram.values())) + 1
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("length", "bucket").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("r", F.row_number().over(within) - 1).join(shift.drop("count"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(_place(shared), f"{_PIECES}, sequence_id long, offset long")
