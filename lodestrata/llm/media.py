"""Media columns (operator 9): content-defined payload chunking.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, become the samples of
an 8-bit mono WAV file. A rolling gear hash cuts the file into chunks. Spark joins on the digests find the
chunks that several files have; of these one file gives its chunk to the store and the others keep the digest in their ordered
lists. A file puts its chunks in order, its own and the store's, verifies its digest and reads the
samples back. Files whose chunks are all their own are rebuilt where their pack arrives, so
bytes cross the network once, and only shared chunks again.

Cases. Null text is empty: 192 spaces. Equal texts share one chunk list. Repeated rows keep their
rows. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut

UNIT, RATE, LEAST, MOST, BITS = 192, 8000, 1024, 16384, 12
_GEAR = np.random.Generator(np.random.PCG64(20240502)).integers(0, 1 << 32, 256, np.uint32)


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (UNIT - len(data) if not data else -len(data) % UNIT)


def store_media(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def read_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; a cut depends on the 32 bytes before it alone, within LEAST and MOST bytes."""
    h = _GEAR[np.frombuffer(data, np.uint8)].copy()
    with np.errstate(over="ignore"):
        for s in (1, 2, 4, 8, 16):
            low = h.copy()
            h[s:] += low[:-s] << np.uint32(s) if len(h) > s else 0
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    ends, at, i = [], 0, 0
    while at < len(data):
        while i < len(marks) and marks[i] < at + LEAST:
            i += 1
        end = min(marks[i] if i < len(marks) else len(data), at + MOST, len(data))
        ends.append(end)
        at = end
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def feature(samples: bytes) -> str:
    """Length, mean, root mean square and zero crossings of the samples, and a 16-bin histogram."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    centred = x - 128
    bins = np.bincount(x >> 4, minlength=16)
    crossings = int((np.signbit(centred[1:]) != np.signbit(centred[:-1])).sum())
    return ":".join([str(len(x)), f"{x.mean():.4f}", f"{np.sqrt((centred**2).mean()):.4f}", str(crossings), ",".join(map(str, bins))])


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ordered digests of each distinct text."""
    seen = set()
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            if key not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                rows += [(key, i, hashlib.sha256(c).digest()) for i, c in enumerate(chunks(store_media(payload(text))))]
        yield pd.DataFrame(rows, columns=["key", "seq", "digest"])


def _packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each distinct text's chunks, compressed as one pack, with their ends and the file's digest."""
    press, seen = zstandard.ZstdCompressor(9), set()
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            if key not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                media = store_media(payload(text))
                rows.append((key, 1, hashlib.sha256(media).digest(), cuts(media), press.compress(media)))
        yield pd.DataFrame(rows, columns=["key", "rank", "digest", "ends", "data"])


_STORED = "kind string, key binary, seq int, digest binary, data binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"
_MADE = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]


def rebuild(parts: list[bytes], whole: bytes) -> tuple:
    """The file of an ordered chunk list, verified, and what its samples give."""
    media = b"".join(parts)
    if hashlib.sha256(media).digest() != whole:
        raise ValueError("the chunks of a file don't give its digest")
    back = read_media(media)
    return len(back), hashlib.sha256(back).digest(), zlib.crc32(back[-16:]), len(media), feature(back)


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by key, its shared chunks (rank 0) before its packs (rank 1).

    A file that owns all its chunks is rebuilt here. A chunk that other files have too goes to the store; a
    file that needs another's chunks leaves its own under its list and waits for them.
    """
    press, pull, now, done = zstandard.ZstdCompressor(9), zstandard.ZstdDecompressor(), None, False
    for batch in batches:
        rows = []
        for key, rank, seq, own, digest, ends, data in batch.itertuples(index=False):
            if key != now:
                now, shared, done = key, {}, False
            if rank == 0:
                shared[int(seq)] = (own, digest)
                continue
            if done:  # the same text from another task
                continue
            done, media = True, pull.decompress(data)
            parts = [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            given = set()
            for i, (mine, name) in shared.items():
                if mine and name not in given:
                    given.add(name)
                    rows.append(("chunk", None, None, name, press.compress(parts[i]), *[None] * 5))
            if all(mine for mine, _ in shared.values()):
                rows.append(("made", key, None, digest, None, *rebuild(parts, digest)))
                continue
            rows.append(("list", key, len(parts), digest, None, *[None] * 5))
            for i, p in enumerate(parts):
                mine, name = shared.get(i, (True, None))
                rows.append(("own", key, i, None, press.compress(p), *[None] * 5) if mine else ("need", key, i, name, None, *[None] * 5))
        out = pd.DataFrame(rows, columns=["kind", "key", "seq", "digest", "data", *_MADE])
        yield out.astype({c: "Int64" for c in ("seq", "payload_bytes", "tail_crc32", "media_bytes")})


def _join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by key and seq; a file's list (seq -1, its digest) comes first, then its chunks in order."""
    pull, key, whole, parts = zstandard.ZstdDecompressor(), None, None, []
    for batch in batches:
        rows = []
        for k, seq, digest, data in zip(batch["key"], batch["seq"], batch["digest"], batch["data"], strict=True):
            if seq < 0:
                if key is not None:
                    rows.append((key, whole, *rebuild(parts, whole)))
                key, whole, parts = k, digest, []
            else:
                parts.append(pull.decompress(data))
        yield pd.DataFrame(rows, columns=["key", "digest", *_MADE])
    if key is not None:
        yield pd.DataFrame([(key, whole, *rebuild(parts, whole))], columns=["key", "digest", *_MADE])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"), "text")


def chunk_lists(docs: DataFrame) -> DataFrame:
    """key, seq, digest of the chunks that several texts have, and whether the text is the one that gives it to the store."""
    lists = cut(keyed(docs).select("key", "text").mapInPandas(_lists, "key binary, seq int, digest binary"), "lists")
    owners = lists.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("last")).where("owner <> last")
    return lists.join(owners, "digest").select("key", "seq", (F.col("key") == F.col("owner")).alias("own"), "digest").distinct()


def chunked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, store): key, seq, digest of every distinct text's file, in whole ordered lists; and digest, data of every distinct chunk, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(9)
        for batch in batches:
            rows = [(key, i, hashlib.sha256(c).digest(), press.compress(c)) for key, text in dict(zip(batch["key"], batch["text"], strict=True)).items() for i, c in enumerate(chunks(store_media(payload(text))))]
            yield pd.DataFrame(rows, columns=["key", "seq", "digest", "data"])

    parts = cut(keyed(docs).select("key", "text").mapInPandas(run, "key binary, seq int, digest binary, data binary"), "chunks")
    # A digest that many files have is reduced to one row within each task before it is shuffled.
    return parts.select("key", "seq", "digest").distinct(), parts.groupBy("digest").agg(F.first("data").alias("data"))


def files(lists: DataFrame, store: DataFrame) -> DataFrame:
    """key, media, media_sha256: the files, put together of their chunks in order; each chunk is held against its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pull, now, parts = zstandard.ZstdDecompressor(), None, []

        def whole() -> tuple:
            media = b"".join(parts)
            return now, media, hashlib.sha256(media).hexdigest()

        for batch in batches:
            rows = []
            for key, digest, data in zip(batch["key"], batch["digest"], batch["data"], strict=True):
                if key != now:
                    rows += [whole()] if now is not None else []
                    now, parts = key, []
                parts.append(pull.decompress(data))
                if hashlib.sha256(parts[-1]).digest() != digest:
                    raise ValueError("a chunk does not give its digest")
            yield pd.DataFrame(rows, columns=["key", "media", "media_sha256"])
        if now is not None:
            yield pd.DataFrame([whole()], columns=["key", "media", "media_sha256"])

    dealt = lists.join(store, "digest").repartition("key").sortWithinPartitions("key", "seq")
    return dealt.select("key", "digest", "data").mapInPandas(run, "key binary, media binary, media_sha256 string")


def media_features(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, and what the rebuilt file gives."""
    arrow_batches(docs.sparkSession)
    shared = chunk_lists(docs).select("key", F.lit(0).alias("rank"), "seq", "own", "digest", F.lit(None).cast("array<int>").alias("ends"), F.lit(None).cast("binary").alias("data"))
    packs = keyed(docs).select("key", "text").mapInPandas(_packs, "key binary, rank int, digest binary, ends array<int>, data binary")
    packs = packs.select("key", "rank", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("boolean").alias("own"), "digest", "ends", "data")
    stored = shared.unionByName(packs).repartition("key").sortWithinPartitions("key", "rank").mapInPandas(_store, _STORED)
    stored = cut(stored, "store")
    need = stored.where("kind = 'need'").select("key", "seq", "digest")
    store = stored.where("kind = 'chunk'").select("digest", "data")
    got = need.join(store, "digest").select("key", "seq", F.lit(None).cast("binary").alias("digest"), "data")
    heads = stored.where("kind in ('list', 'own')").select("key", F.when(F.col("kind") == "list", F.lit(-1)).otherwise(F.col("seq")).alias("seq"), "digest", "data")
    schema = "key binary, digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"
    late = got.unionByName(heads).repartition("key").sortWithinPartitions("key", "seq").mapInPandas(_join, schema)
    built = stored.where("kind = 'made'").select("key", "digest", *_MADE).unionByName(late)
    own = keyed(docs).select("doc_id", "key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return own.join(built, "key").select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_sha256")).alias("payload_sha256"), "tail_crc32", "media_bytes", F.lower(F.hex("digest")).alias("media_sha256"), "feature"
    )
