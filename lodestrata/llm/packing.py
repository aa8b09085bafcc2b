"""Best-fit packing (operator 3): pattern packing by non-negative least squares.

Tokenised pieces are counted in a histogram of lengths (at most 2048 entries, whatever the
input). Few-piece patterns that fill a sequence are enumerated over the lengths present, repeat
counts are fitted to the histogram by NNLS (cyclic coordinate descent) and rounded to the nearest
within what is there; the patterns are fitted again to what is left, up to four times, and the last
residual counts are packed best-fit decreasing, with equal bins held as one group with a multiplicity. Ranks within a length, salted so that no length meets in one task,
then tell each piece its sequence and offset.

Cases. Null or empty text: the closing id 0 alone. Repeated rows are packed as often as they
occur; a null doc_id stays null. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import back, cleared, cut, doc_ids

CAPACITY, TOKENIZER, RANKS, SALTS, FITS = 2048, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 64, 4
_CACHE_LIMIT = 400_000
#: A space before another blank or the end: there the cut before a space does not hold.
_UNSAFE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Ids of a byte-level BPE, with a bounded cache of space-led words.

    Without a path of its own it is the public vocabulary of 50,257 ids, whose ranks are read by a faster
    library; texts with a special token's string, and other vocabularies, go to ``tokenizers``. The
    word splitting always cuts before a single space that a non-space follows, so such units
    encode alike alone and in context; texts with other blanks after a space are encoded whole.
    """

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER)), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if path is None:
            with open(public_tokenizers.path(RANKS), "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            self.lengths[list(ranks.values())] = [len(token) for token in ranks]
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes new units in one call; a unit's ids are those whose bytes lie within its own."""
        if self.fast is None or not words:
            self.known.update((w, self._whole(" " + w)) for w in words)
            return
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum(self.lengths[ids])
        units = np.cumsum([len(w.encode()) + 1 for w in words])
        last = np.searchsorted(ends, units)
        if not (ends[last] == units).all():
            raise ValueError("a unit's end lies within a token")
        at, data = 0, ids.tobytes()
        for w, end in zip(words, (4 * (last + 1)).tolist(), strict=True):
            self.known[w] = data[at:end]
            at = end

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            split = [None if _UNSAFE.search(t) or any(s in t for s in self.special) else t.split(" ") for t in part]
            if len(self.known) > _CACHE_LIMIT:
                self.known.clear()
            known = self.known
            self._learn([w for w in {w for u in split if u for w in u[1:]} if w not in known])
            for text, units in zip(part, split, strict=True):
                if units is None:
                    yield self._whole(text)
                else:
                    yield b"".join([self._whole(units[0]) if units[0] else b"", *[known[w] for w in units[1:]]])


@lru_cache(1)
def encoder(path: str | None) -> Encoder:
    """One for each Python worker, so that its cache outlives a task; other operators' tasks clear it."""
    return Encoder(path)


cleared.append(encoder.cache_clear)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with keep_ids its ids too."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encode([t or "" for t in batch["text"]]), strict=True):
                ids += b"\0\0\0\0"
                n, start = len(ids) // 4, 0
                end = (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    own = ids[4 * start : 4 * end]
                    rows.append((doc, piece, start, end - start, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if keep_ids else [])))
                    start, end, piece = end, end + capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    made = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return back(doc_ids(docs, "text").mapInPandas(cut_up, made))


def patterns(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Patterns of up to four lengths that fill a sequence, or nearly so where none fits exactly."""
    present, found = sorted(lengths), set()

    def largest(most: int) -> int | None:
        i = bisect_left(present, most + 1)
        return present[i - 1] if i else None

    for a in present:
        if a == capacity:
            found.add((a,))
            continue
        for parts in (2, 3, 4):
            chosen, room = [a], capacity - a
            for left in range(parts - 1, 0, -1):
                b = largest(room // left if left > 1 else room)
                if b is None:
                    break
                chosen.append(b)
                room -= b
            found.add(tuple(sorted(chosen, reverse=True)))
        for share in (3, 5, 7):  # uneven splits of what is left
            b = largest((capacity - a) * share // 8)
            c = largest(capacity - a - b) if b else None
            if b and c:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(p for p in found if capacity - sum(p) <= capacity // 256)


def nnls(found: list[tuple[int, ...]], target: dict[int, int], sweeps: int = 40) -> list[float]:
    """Repeat counts >= 0 under which the patterns come nearest to the histogram."""
    left = {k: float(v) for k, v in target.items()}
    x, uses = [0.0] * len(found), [sorted((k, p.count(k)) for k in set(p)) for p in found]
    for _ in range(sweeps):
        for i, use in enumerate(uses):
            step = sum(left[k] * c for k, c in use) / sum(c * c for _, c in use)
            new = max(0.0, x[i] + step)
            if new != x[i]:
                for k, c in use:
                    left[k] -= (new - x[i]) * c
                x[i] = new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): where the ranks of each length go."""
    left = dict(histogram)
    bins: list[tuple[tuple[int, ...], int]] = []
    for _ in range(FITS):
        target = {k: n for k, n in left.items() if n}
        found, before = patterns(list(target), capacity), len(bins)
        for x, p in sorted(zip(nnls(found, target), found, strict=True), reverse=True):
            n = min([int(x + 0.5), *(left[k] // p.count(k) for k in set(p))])
            if n > 0:
                bins.append((p, n))
                for k in p:
                    left[k] -= n
        if len(bins) == before:
            break
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []
    for k in sorted(left, reverse=True):
        n = left[k]
        while n > 0:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                per = min(capacity // k, n)
                times, filled = n // per, (k,) * per
                n -= times * per
                room = capacity - per * k
            else:
                room = rooms[i]
                old, have = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
                per = min(room // k, n)
                times = min(have, n // per)
                if have > times:
                    if not open_[room]:
                        insort(rooms, room)
                    open_[room].append((old, have - times))
                n -= times * per
                filled, room = old + (k,) * per, room - per * k
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((filled, times))
    bins += [b for room in sorted(open_) for b in open_[room]]
    out, used, sequence = [], defaultdict(int), 0
    for p, n in bins:
        offset = 0
        for k in p:
            out.append((k, used[k], n, sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with keep_ids its ids before the last two, of
    which ``sequences`` makes whole sequences."""
    parts = cut(pieces(docs, tokenizer, capacity, keep_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))), "pieces")
    sizes = sorted((r["length"], r["salt"], r["count"]) for r in parts.groupBy("length", "salt").count().collect())  # capacity x SALTS rows at most
    histogram, first = defaultdict(int), {}
    for length, salt, n in sizes:
        first[(length, salt)] = histogram[length]
        histogram[length] += n
    slots = defaultdict(list)
    for length, rank, n, sequence, offset in plan(histogram, capacity):
        slots[length].append((rank, sequence, offset))
    table = {k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast((first, table))  # bounded by the capacity

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, table = shared.value
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, (length, salt, rn) in enumerate(zip(batch["length"], batch["salt"], batch["rn"], strict=True)):
                rank = first[(length, salt)] + rn - 1
                ranks, sequences, offsets = table[length]
                j = int(np.searchsorted(ranks, rank, "right")) - 1
                sequence[i], offset[i] = sequences[j] + rank - ranks[j], offsets[j]
            yield batch.drop(columns=["salt", "rn"]).assign(sequence_id=sequence, offset=offset)

    # row_number per (length, salt): the salt splits a length that a third of all pieces share.
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("rn", F.row_number().over(w)).withColumn("doc_id", F.col("doc_id").cast("string"))
    return back(ranked.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long".replace("ids_crc32 long", "ids_crc32 long, ids array<int>" if keep_ids else "ids_crc32 long")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each at most ``capacity`` ids of pieces in order of their places."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda p: p["ids"])).alias("ids"))
