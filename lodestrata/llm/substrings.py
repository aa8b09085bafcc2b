"""Substring dedup (operator 7): repeated-phrase automata.

1. Hashes of all 13-word windows go, packed in binary blocks, to hash buckets. A task first settles what
   recurs among its own documents: of these a window goes out once, with the least doc_id, so a passage
   that a third of all documents share adds one entry a block and not one a document. A bucket tells
   which windows start in several documents, the least doc_id (the source) and who repeats it.
2. One pass over the documents in groups cuts the recurring runs out of the sources' texts, as
   words, for the groups that repeat them; documents that repeat nothing are final here.
3. Each group is a shard: its passages are compiled to one Aho-Corasick automaton over word ids and its
   repeating documents are streamed through it. Every window of 13 words holds one of the 7-word blocks that
   begin at each seventh word of a passage, so these blocks are the automaton's keys; where one occurs, the
   run of equal words around it is followed and counts from 13 words on. A block that a shard
   has at more than eight places is replaced by the whole windows around it. Words are compared, so this confirms the
   hashes; words under a run with a smaller source are removed.

Buckets and groups grow in number with the bytes of text; nothing goes to the driver but two sums.

Cases. Null text: no words. Fewer than 13 words: nothing removed. Rows that repeat a doc_id are
one document to each other. Null doc_id sorts before all others. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, mix, not_blank, rolling, tidied, word_hashes

WINDOW, STRIDE, PLACES = 13, 7, 8
#: Bytes of text of a group, of a bucket's windows and of a task's block, windows of a task's block, and groups of a window above which all groups get its passage.
GROUP_BYTES, BUCKET_BYTES, BLOCK_BYTES, FLUSH, MANY = 4 << 20, 12 << 20, 12 << 20, 800_000, 64
_NULL, _ALL = -(1 << 62), -1


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(groups)).astype(np.int64)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)


def _blocks(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, each column's part) for each distinct key, in order."""
    order = np.argsort(key, kind="stable")
    key, columns = key[order], [c[order] for c in columns]
    at = _starts(key)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield (int(key[a]), *[c[a:b] for c in columns])


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc and h in order of h and doc, where each window begins, and which entries repeat a window of a smaller doc."""
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    at = _starts(h)
    return doc, h, at[:-1], doc != np.repeat(doc[at[:-1]], np.diff(at))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """What is known of a window: its bucket, and six bytes above."""
    return (h // np.uint64(buckets) % np.uint64(1 << 48)) * np.uint64(buckets) + h % np.uint64(buckets)


_PACKED = "bucket long, ids binary, counts binary, hashes binary, often binary, groups binary, again binary"


def _windows(buckets: int, groups: int):
    def packed(ids: list[int], parts: list[np.ndarray]) -> pd.DataFrame:
        doc, h, at, repeats = _repeats(np.repeat(np.array(ids, np.int64), [len(p) for p in parts]), np.concatenate(parts))
        often, to = _pairs(h[repeats], _group(doc[repeats], groups))
        # A window whose repeaters are in many groups goes to all of them.
        ends = _starts(often)
        wide = np.repeat(np.diff(ends) > MANY, np.diff(ends))
        often, to = _pairs(often, np.where(wide, _ALL, to))
        again = np.unique(doc[repeats])
        doc, h = doc[at], h[at]
        rows = {b: [b, b"", b"", b"", b"", b"", b""] for b in range(buckets)}
        # The bucket has the low bits, 8 at least, and six bytes the ones above: 56 bits at 0.5 GB, 64 from 800 GB on. Two
        # recurring windows that share them (0.003 pairs expected at 0.5 GB) could only leave the later one's 13 words in.
        for b, d, own in _blocks((h % np.uint64(buckets)).astype(np.int64), doc, h):
            order = np.argsort(d, kind="stable")
            ends = _starts(d[order])
            rest = np.ascontiguousarray((own[order] // np.uint64(buckets)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
            rows[b][1:4] = np.diff(d[order][ends[:-1]], prepend=0).tobytes(), np.diff(ends).astype(np.uint32).tobytes(), rest.tobytes()
        for b, x, t in _blocks((often % np.uint64(buckets)).astype(np.int64), often, to):
            rows[b][4:6] = (x // np.uint64(buckets) % np.uint64(1 << 48)).tobytes(), t.tobytes()
        for b, d in _blocks(_group(again, buckets), again):
            rows[b][6] = d.tobytes()
        return pd.DataFrame([r for r in rows.values() if any(r[1:])], columns=["bucket", "ids", "counts", "hashes", "often", "groups", "again"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, size = [], [], 0
        for batch in batches:
            for doc, words in zip(batch["doc_id"], word_hashes(batch["text"], not_blank()), strict=True):
                if len(words) >= WINDOW:
                    ids.append(doc)
                    parts.append(np.unique(rolling(words, WINDOW)))
                    size += len(parts[-1])
                    if size >= FLUSH:
                        yield packed(ids, parts)
                        ids, parts, size = [], [], 0
        if ids:
            yield packed(ids, parts)

    return run


def _recurring(groups: int, buckets: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        docs, hashes = [], []
        for ids, counts, h in zip(block["ids"], block["counts"], block["hashes"], strict=True):
            full = np.zeros((len(h) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
            docs.append(np.repeat(np.cumsum(np.frombuffer(ids, np.int64)), np.frombuffer(counts, np.uint32)))
            hashes.append(full.view("<u8").ravel())
        doc, h, at, repeats = _repeats(np.concatenate(docs), np.concatenate(hashes))
        often, to, again = (np.frombuffer(b"".join(block[c]), t) for c, t in (("often", np.uint64), ("groups", np.int64), ("again", np.int64)))
        kind, least = h[at], doc[at]
        source = np.concatenate([least[np.searchsorted(kind, h[repeats])], least[np.searchsorted(kind, often)]])
        out = []
        s, t = _pairs(source, np.concatenate([_group(doc[repeats], groups), to]))
        for g, a, b in _blocks(_group(s, groups), s, t):
            out.append((g, "to", a.tobytes(), b.tobytes()))
        many = np.isin(kind, np.concatenate([h[repeats], often]))
        kind = kind * np.uint64(buckets) + np.uint64(block["bucket"].iloc[0])
        for g, a, b in _blocks(_group(least[many], groups), least[many], kind[many]):
            out.append((g, "source", a.tobytes(), b.tobytes()))
        again = np.unique(np.concatenate([doc[repeats], again]))
        for g, a in _blocks(_group(again, groups), again):
            out.append((g, "again", a.tobytes(), b""))
        return pd.DataFrame(out, columns=["g", "kind", "a", "b"])

    return run


def _words(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes split at 0x20 and 0x09 to 0x0D and nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_FINAL = "kind string, t long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, mark long"


def _cut_out(groups: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by group, packed rows (rank 0) before documents (rank 1)."""
        group, press = None, zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for g, rank, kind, a, b in batch.itertuples(index=False):
                if g != group:
                    group, again, to, sources = g, set(), defaultdict(set), defaultdict(list)
                if rank == 0:
                    ids = np.frombuffer(a, np.int64)
                    if kind == "again":
                        again.update(ids.tolist())
                    elif kind == "to":
                        for s, t in zip(ids.tolist(), np.frombuffer(b, np.int64).tolist(), strict=True):
                            to[s].add(t)
                    else:
                        for s, part in _blocks(ids, np.frombuffer(b, np.uint64)):
                            sources[s].append(part)
                    continue
                data, at = press.decompress(b), 0
                for doc, mark, size in np.frombuffer(a, np.int64).reshape(3, -1).T.tolist():
                    text = None if size < 0 else data[at : at + size].decode("utf-8", "surrogatepass")
                    at += max(size, 0)
                    words = _words(text)
                    if doc in sources and len(words) >= WINDOW:
                        h = rolling(next(word_hashes([text], not_blank())), WINDOW)
                        hit = np.isin(_short(h, buckets), np.concatenate(sources[doc]))
                        edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                        for i, j in zip(edge[::2], edge[1::2], strict=True):
                            passage = b" ".join(words[i : j + WINDOW - 1]).decode("utf-8", "surrogatepass")
                            out += [("a", t, doc, None, None, None, passage, 0) for t in (range(groups) if _ALL in to[doc] else sorted(to[doc]))]
                    if doc in again:
                        out.append(("b", g, doc, None, None, None, text, mark))
                    else:
                        out.append(("final", g, doc, len(words), 0, _digest(words), text, mark))
            yield pd.DataFrame(out, columns=["kind", "t", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "mark"]).astype({"n_words": "Int64", "n_removed": "Int64"})

    return run


class Shard:
    """The passages of a group, and the automaton over them.

    A word is spelled in a fixed number of letters, 32 for each place: the automaton looks through a state's
    successors one by one, so a state must not have one for each word. The places' letters differ, so no occurrence begins within a word.
    """

    def __init__(self) -> None:
        self.known, self.passages, self.machine, self.width = {}, [], None, 0

    def spell(self, ids: list[int]) -> tuple[int, ...]:
        place = np.arange(self.width)
        return tuple(((np.array(ids, np.int64)[:, None] >> (5 * place)) % 32 + 32 * place).ravel().tolist())

    def add(self, doc: int, words: list[bytes]) -> None:
        known = self.known
        self.passages.append((doc, [known.setdefault(w, len(known) + 1) for w in words]))

    def compile(self) -> None:
        self.width = width = -(-len(self.known).bit_length() // 5)
        places, windows, letters = defaultdict(list), {}, [self.spell(ids) for _, ids in self.passages]
        for i, spelled in enumerate(letters):
            for a in range(0, len(spelled) // width - STRIDE + 1, STRIDE):
                places[spelled[a * width : (a + STRIDE) * width]].append((i, a))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, found in places.items():
            if len(found) <= PLACES:
                self.machine.add_word(block, found)
                continue
            for i, a in found:
                doc, ids = self.passages[i]
                for at in range(max(0, a + STRIDE - WINDOW), min(a, len(ids) - WINDOW) + 1):
                    window = letters[i][at * width : (at + WINDOW) * width]
                    windows[window] = min(doc, windows.get(window, doc))
        for window, doc in windows.items():
            self.machine.add_word(window, doc)
        self.machine.make_automaton()
        self.passages = [(doc, np.array(ids, np.int64), ids) for doc, ids in self.passages]

    def removed(self, doc: int, words: list[bytes]) -> np.ndarray:
        """Which words are in a run of 13 or more that a passage of a smaller doc has."""
        if self.machine is None and self.passages:
            self.compile()
        gone = np.zeros(len(words) + 1, np.int64)
        if self.machine is None or len(words) < WINDOW:
            return gone[:-1] > 0
        ids = list(map(self.known.get, words, repeat(0)))
        own, reach, need = np.array(ids, np.int64), {}, WINDOW - STRIDE
        for end, found in self.machine.iter(self.spell(ids)):
            end //= self.width
            if not isinstance(found, list):
                if found < doc:
                    gone[end - WINDOW + 1] += 1
                    gone[end + 1] -= 1
                continue
            x = end - STRIDE + 1
            for i, a in found:
                source, passage, listed = self.passages[i]
                if source >= doc or reach.get((i, x - a), -1) > x:
                    continue
                # Most blocks stand alone: a few words on either side tell.
                left = right = 0
                most = min(need, x, a)
                while left < most and ids[x - left - 1] == listed[a - left - 1]:
                    left += 1
                most = min(need - left, len(ids) - end - 1, len(listed) - a - STRIDE)
                while right < most and ids[end + right + 1] == listed[a + STRIDE + right]:
                    right += 1
                if left + right < need:
                    continue
                back, on = min(x, a), min(len(own) - x, len(passage) - a)
                off = np.flatnonzero(own[x - back : x] != passage[a - back : a])
                first = x - back + (off[-1] + 1 if len(off) else 0)
                off = np.flatnonzero(own[x : x + on] != passage[a : a + on])
                last = x + (off[0] if len(off) else on)
                reach[(i, x - a)] = last
                gone[first] += 1
                gone[last] -= 1
        return np.cumsum(gone)[:-1] > 0


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by shard, passages ("a") before documents ("b")."""
    now, shard = None, None
    for batch in batches:
        out = []
        for kind, t, doc, text, mark in zip(batch["kind"], batch["t"], batch["doc_id"], batch["text"], batch["mark"], strict=True):
            if t != now:
                now, shard = t, Shard()
            words = _words(text)
            if kind == "a":
                shard.add(doc, words)
                continue
            removed = shard.removed(doc, words)
            kept = [w for w, r in zip(words, removed.tolist(), strict=True) if not r]
            out.append(("final", t, doc, len(words), int(removed.sum()), _digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if removed.any() else text, mark))
        yield pd.DataFrame(out, columns=["kind", "t", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "mark"])


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and with keep_text the text that stays
    (unchanged where nothing is removed, else the kept words joined by one space) and mark, xxhash64 of the text in docs."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    arrow_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = (max(16, 1 << (size // n).bit_length()) for n in (GROUP_BYTES, BUCKET_BYTES))
    buckets, tasks = max(256, buckets), max(16, groups // 4)
    packed = docs.mapInPandas(tidied(_windows(buckets, groups)), _PACKED)
    found = cut(packed.repartition(max(16, buckets // 4), "bucket").groupBy("bucket").applyInPandas(_recurring(groups, buckets), "g long, kind string, a binary, b binary"), "recurring")

    def travel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts by group, each group's of a task's block as one compressed row: their vocabulary is shared."""
        press, held, size = zstandard.ZstdCompressor(9), [], 0

        def packed() -> pd.DataFrame:
            doc, mark = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
            rows = []
            for g, at in _blocks(_group(doc, groups), np.arange(len(held))):
                texts = [held[i][2] for i in at]
                sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
                rows.append((g, 1, "", np.stack([doc[at], mark[at], sizes]).tobytes(), press.compress(b"".join(t or b"" for t in texts))))
            return pd.DataFrame(rows, columns=["g", "rank", "kind", "a", "b"])

        for batch in batches:
            for doc, text, mark in zip(batch["doc_id"], batch["text"], batch["mark"], strict=True):
                held.append((doc, mark, None if text is None else text.encode("utf-8", "surrogatepass")))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield packed()
                    held, size = [], 0
        yield packed()

    schema = "g long, rank int, kind string, a binary, b binary"
    rows = found.select("g", F.lit(0).alias("rank"), "kind", "a", "b").unionByName(docs.mapInPandas(tidied(travel), schema))
    done = rows.repartition(tasks, "g").sortWithinPartitions("g", "rank").mapInPandas(tidied(_cut_out(groups, buckets)), _FINAL)
    if not keep_text:
        done = done.withColumn("text", F.when(F.col("kind") != "final", F.col("text")))
    done = cut(done, "cut")
    shards = done.where("kind <> 'final'").repartition(tasks, "t").sortWithinPartitions("t", "kind", "doc_id").mapInPandas(tidied(_locate), _FINAL)
    columns = [F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["text", "mark"] if keep_text else [])]
    return done.where("kind = 'final'").unionByName(shards).select(*columns)
