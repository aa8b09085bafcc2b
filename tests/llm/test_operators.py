"""Each operator against brute force on a small fixture with nulls, empty and repeated rows, long texts and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import fingerprints, language, licenses, media, mixing, near_duplicates, packing, quality, substrings, toxicity
from lodestrata.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string, size long"
BLANK = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    vocabulary = [word() for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [t + " " + passage + " tail" for t in texts[:6]]
    texts += texts[:4] + [texts[5] + " end"]
    texts += [None, "", "  \n ", "12 34", "Under the MIT License\x0bApache License, Version 2.0 cc by-nc", "é" * 500, "a  b   c\n\n d <|endoftext|> x", " ".join(vocabulary * 20)]
    rows = [(i, t, ("de", "en", None)[i % 3], (None, "s1", "s2", "s0")[i % 4], len(t or ""), "x", "y", 9) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(50)] + [(None, None, None)], "doc_id long, quality int, toxic int")


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def test_near_duplicates(docs, rows, empty):
    sets, parent = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in sets}
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] for r in near_duplicates.keep_one(docs.unionByName(docs)).collect()) == sorted({find(i) for i in sets})


def test_components_of_a_path(spark):
    n = 40
    got = components(spark.range(1, n).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))).distinct().collect()
    assert {r["node"]: r["component"] for r in got} == dict.fromkeys(range(n), 0)


def test_language(spark, empty):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    made = [(i, " ".join("".join(rng.choice(letters[g]) for _ in range(4)) for _ in range(8)), g) for i, g in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame([*made, (500, None, "aa"), (501, "12 .", "bb"), (502, "abab", None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where(~language.is_held_out()))
    scored, name = language.identify(docs, model)
    got = {r["doc_id"]: r for r in scored.select("doc_id", f"{name}.*").collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in made) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und"
    assert language.identify(empty, language.fit(empty))[0].count() == 0


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        got[r["doc_id"]].append(r)
    for r in rows:
        ids, at = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(got[r[0]], key=lambda p: p["piece"]):
            assert p["start"] == at and zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
            assert p["piece"] == 0 or p["length"] == 2048
            at += p["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for p in (p for ps in got.values() for p in ps):
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack(empty).count() == 0


def test_quality(spark, docs, rows, empty):
    got = quality.select(docs, labels(spark), share=0.5).collect()
    assert len(got) == len(rows) and sum(r["selected"] for r in got) == len(rows) // 2
    assert min(r["key"] for r in got if r["selected"]) >= max(r["key"] for r in got if not r["selected"])
    assert quality.select(empty, labels(spark)).count() == 0


def test_fingerprints(docs, rows, empty):
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs).collect()}
    order = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for j, i in enumerate(order):
        t, m = text[i], len(text[i]) // 3
        other = t[: len(t) - m] + text[order[(j + 1) % len(order)]][:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
    assert got[0]["fingerprint"] == got[66]["fingerprint"] and len({r["fingerprint"] for r in got.values()}) > 50
    assert fingerprints.with_next(empty).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    made = [(i, " ".join([rng.choice(plain) for _ in range(60)] + ["vile", "awful"] * (i % 4 == 0) * (1 + i % 3)), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([*[m[:2] for m in made], (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(m[0], m[2]) for m in made[:200]], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in made[200:]) >= 190
    assert got[900]["severity"] == got[901]["severity"] == 0.0
    assert toxicity.grade(empty, None).count() == 0


def test_substrings(docs, rows, empty):
    words, first = {r[0]: re.findall(BLANK, r[1] or "") for r in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substrings.remove_repeats(empty).count() == 0


def test_licenses(docs, rows, empty):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    hit = next(r for r in got.values() if r["n_base"])
    assert (hit["n_base"], hit["first_word"], hit["last_word"], hit["base_labels"]) == (3, 0, 9, "apache-2,cc-by-nc,mit") and hit["n_words"] == 12
    assert licenses.scan(empty).count() == 0


def test_media(docs, rows, empty):
    got = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        data = raw + b" " * (192 if not raw else -len(raw) % 192)
        x = got[r[0]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert b"".join(media.chunks(bytes(range(256)) * 400)) == bytes(range(256)) * 400
    assert media.media_features(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target, most = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(docs).count() > 0 and mixing.apply_mix(docs).columns == docs.columns


def test_near_duplicates_counts_every_link(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    links = [sum(a != b and len(a & b) >= 0.8 * len(a | b) for b in sets) for a in sets]
    assert min(links) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for members in (near_duplicates.MEMBERS, 16):  # 16: a bucket of several blocks
        monkeypatch.setattr(near_duplicates, "MEMBERS", members)
        got = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()}
        assert got == {i: (0, n) for i, n in enumerate(links)}


def test_fingerprints_of_few_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 4)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(12)))) for i in range(0, 1200, 3)]
    found = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert 2 * spark.sparkContext.defaultParallelism - 2 <= len(held) <= 2 * spark.sparkContext.defaultParallelism and max(held) < 2 * len(rows) / len(held)
    texts = [t for _, t in rows[::-1]]
    want = [fingerprints.edited(t, other) for t, other in zip(texts, texts[1:] + texts[:1], strict=True)]
    marks, changed = (list(fingerprints.fingerprints(x)) for x in (texts, want))
    near = [fingerprints.likeness(a, b) for a, b in zip(marks, marks[1:] + marks[:1], strict=True)]
    got = [(r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in sorted(found.collect(), key=lambda r: -r["doc_id"])]
    assert got == [(hashlib.sha256(o.encode()).hexdigest(), fingerprints.as_text(a), fingerprints.as_text(b), x) for o, a, b, x in zip(want, marks, changed, near, strict=True)]


def test_fingerprints_of_long_unrelated_texts():
    pair = [" ".join(f"{side}{k}" for k in range(100_000)) for side in "ab"]
    a, b = fingerprints.fingerprints(pair)
    assert fingerprints.likeness(a, b) <= 2 / fingerprints.SAMPLES


def test_fingerprints_against_exact_similarity():
    rng, off = random.Random(4), []
    for size in (20, 300, 3000):
        for k in range(20):
            base = [rng.randrange(size) for _ in range(3 * size)]
            other = base[: len(base) * k // 20] + [rng.randrange(size, 2 * size) for _ in range(len(base) - len(base) * k // 20)]
            counts = [collections.Counter(zip(x, x[1:])) for x in (base, other)]  # noqa: B905
            exact = (counts[0] & counts[1]).total() / (counts[0] | counts[1]).total()
            a, b = fingerprints.fingerprints(" ".join(map(str, x)) for x in (base, other))
            off.append(fingerprints.likeness(a, b) - exact)
    off = np.array(off)
    assert abs(off.mean()) < 0.025 and (off**2).mean() ** 0.5 < 0.08 and abs(off).max() < 0.25


def test_stages_keep_null_and_repeated_doc_ids(spark):
    import corpus_pipeline

    rng = random.Random(6)
    fresh = lambda n=40: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    same, passage = fresh(), fresh(20)
    clean = [(None, fresh()), (None, fresh()), (7, fresh()), (7, fresh()), (8, fresh())]
    # The copies: of doc_id 3 and null, of nulls alone, of doc_ids 9 and 7; and what has no words.
    nulls, nine = fresh(), fresh()
    rows = [*clean, (None, same), (3, same), (None, nulls), (None, nulls), (9, nine), (7, nine), (None, ""), (None, ""), (None, None), (4, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "s", j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, source string, at int")
    order = lambda rows: sorted(rows, key=str)
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert order((r["doc_id"], r["text"]) for r in kept.collect()) == order([*clean, (3, same), (None, nulls), (7, nine), (None, ""), (None, ""), (None, None), (4, None), (4, "")])

    rows = [*clean, (None, passage + " null"), (7, passage + " seven"), (7, passage + " again"), (7, passage + " again"), (9, passage), (None, None)]
    docs = spark.createDataFrame([(i, t, "s", j, 0) for j, (i, t) in enumerate(rows)], "doc_id long, text string, source string, at int, n_chars long")
    got = corpus_pipeline.substring_dedup(spark, docs, "").collect()
    wanted = [*clean, (None, passage + " null"), (7, "seven"), (7, "again"), (7, "again")]
    assert [(r["at"], r["doc_id"], r["text"], r["n_chars"]) for r in sorted(got, key=lambda r: r["at"])] == [(j, i, t, len(t)) for j, (i, t) in enumerate(wanted)]

    docs = docs.where("at < 9")
    languages = docs.withColumn("lang", F.lit("aa"))
    assert language.kept(languages, language.fit(languages)).count() == 9 and language.kept(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).count() == 9
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    tokens = packing.pack(docs.withColumn("doc_id", F.col("at").cast("long"))).agg(F.sum("length")).first()[0]
    assert {r["doc_id"] for r in packed} == {None, 7, 8} and sum(r["n"] for r in packed) == tokens
    mixed = {r["row"]: r for r in mixing.mix(docs).collect()}
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert len(mixed) == 8 and mixing.apply_mix(docs).count() == copies


def test_toxicity_of_texts_that_share_an_opening(spark):
    rng, opening = random.Random(5), " ".join(f"licence{k}" for k in range(12))
    plain = [f"w{i}" for i in range(200)]
    made = [(i, " ".join([opening] + [rng.choice(plain) for _ in range(60)] + ["vile", "awful"] * (i % 4 == 0) * (1 + i % 3)), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(m[0], m[2]) for m in made[:200]], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in made[200:]) >= 190


def test_components_write_few_files(spark):
    """However many shuffle partitions there are, a few edges are no file a partition; groups stay right."""
    from lodestrata.llm import common

    written, cut = [], common.cut
    edges = spark.range(1, 60).select((F.col("id") - 1).alias("a"), F.col("id").alias("b")).where("b % 20 <> 0")
    common.cut = lambda df, kind="table": written.append(df.rdd.getNumPartitions()) or cut(df, kind)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["node"], r["component"]) for r in common.components(edges).collect()}
    finally:
        common.cut = cut
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, i // 20 * 20) for i in range(60)} and max(written[2:]) <= 12


def test_worker_drops_what_others_left():
    from lodestrata.llm import common, packing

    packing.encoder(None)
    assert list(common.tidied(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert packing.encoder.cache_info().currsize == 0
