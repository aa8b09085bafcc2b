"""Null and large doc_ids, clashing columns and repetitive texts; templates, chunk sharing and training steps against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import fingerprints, language, licenses, media, mixing, near_duplicates, packing, quality, substrings, toxicity

BIG = 1 << 60


def fresh(rng, n=40):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def big(spark):
    """Ids that doubles can't tell apart, and a null, in one batch."""
    rng = random.Random(4)
    rows = [(BIG + 1, fresh(rng), "en", "s", 1), (BIG + 3, fresh(rng), "en", "s", 2), (None, fresh(rng), "de", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_null_doc_ids_leave_others_alone(spark, big):
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 3, 0, 1)], "doc_id long, quality int, toxic int")
    runs = [
        near_duplicates.near_duplicates(big), language.identify(big, language.fit(big))[0], packing.pack(big), quality.select(big, labels), fingerprints.with_next(big),
        toxicity.grade(big, toxicity.fit(big, labels)), substrings.remove_repeats(big), licenses.scan(big), media.media_features(big), mixing.mix(big),
    ]
    for i, run in enumerate(runs, 1):
        assert {r["doc_id"] for r in run.collect()} == {BIG + 1, BIG + 3, None}, i


def test_stages_keep_columns_of_any_name(spark, big):
    extra = ["score", "language", "_text", "_id", "_of", "_mark", "_keep", "row", "copies", "_row", "_copy", "key", "group", "lang_pred", "node", "size"]
    docs = big.selectExpr("*", *[f"concat('{c}', n_chars) as `{c}`" for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert {r["doc_id"] for r in rows} <= {BIG + 1, BIG + 3, None} and all(r["text"] for r in rows), name
        assert all(r[c].startswith(c) and len(r[c]) == len(c) + 1 for r in rows for c in extra), name
        if name != "mix_sources":
            assert len(rows) == 3, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 3


def test_stages_of_an_empty_table(spark, big):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, big.limit(0), "").count() == 0, name


def removed(texts):
    """Words left of each text, by brute force."""
    words, first = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
    return out


def test_substrings_of_repetitive_texts(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(60):
        period = rng.choice([1, 2, 7, 8, 13])
        texts[i] = " ".join(f"p{period}x{k % period}" for k in range(rng.randrange(5, 400))) + " " + fresh(rng, 5)
    passage = fresh(rng, 60).split()
    for i in range(60, 400):
        a = rng.randrange(40)
        texts[i] = " ".join([fresh(rng, rng.randrange(20)), *passage[a : a + rng.randrange(10, 25)], fresh(rng, 3), *passage[: rng.randrange(20)]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = removed(texts)
    for parts in (1, 7):
        got = {r["doc_id"]: r["kept_sha256"] for r in substrings.remove_repeats(docs.repartition(parts)).collect()}
        assert got == want


def test_substrings_in_small_groups(spark, monkeypatch):
    """Blocks, buckets and groups of a few documents, and passages that go to every group."""
    rng = random.Random(10)
    passage = fresh(rng, 30)
    texts = {i: f"{fresh(rng, 3)} {passage if i % 3 else fresh(rng)} {fresh(rng, i % 20)}" for i in range(300)}
    texts[300] = texts[17] + " " + texts[18]
    for name, value in (("GROUP_BYTES", 500), ("BUCKET_BYTES", 100), ("FLUSH", 2000), ("MANY", 5)):
        monkeypatch.setattr(substrings, name, value)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    # Workers read the module anew, so what they use goes through the functions that the driver makes.
    assert {r["doc_id"]: r["kept_sha256"] for r in substrings.remove_repeats(docs).collect()} == removed(texts)


def test_templates(spark):
    mit, gpl = (licenses.TEMPLATES[k] for k in ("mit", "gpl"))
    drifted = mit.split()
    for at in (5, 15, 25, 35):
        drifted.insert(at, "indeed")
    rng = random.Random(12)
    texts = {
        "whole": (f"{fresh(rng)} {mit} {fresh(rng)}", "mit"), "upper": (mit.upper(), "mit"), "drifted": (" ".join(drifted), "mit"),
        "both": (f"{mit} {fresh(rng)} {gpl}", "gpl,mit"), "third": (" ".join(mit.split()[:15]) + " " + fresh(rng), ""),
        "beside": ("permission is hereby " * 50 + mit, "mit"), "fragments": ("permission is hereby " * 200, ""), "scattered": (" ".join(f"{w} {rng.randrange(9)}" for w in mit.split()), ""),
        "phrase": ("Under the MIT License and CC-BY-NC", "cc-by-nc,mit"), "none": (None, ""),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts.values())], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == [w for _, w in texts.values()]
    assert all(bool(r["n_base"]) == bool(r["base_labels"]) and 0 <= r["score"] <= 1 for r in got.values())


def test_base_places(spark):
    rng, phrases = random.Random(13), {p: label for p, label in licenses.BASE.items()}
    parts = [*phrases, "under the mit", "license", "cc by", "nc", "Apache", "x", "CC-BY-NC"]
    texts = {i: ", ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for i in range(80)}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), first, last, ",".join(sorted({x for _, x in at})))


def test_media_of_shared_chunks(spark):
    rng = random.Random(14)
    shared = fresh(rng, 6000)
    texts = {i: fresh(rng, 20 * i) + shared + fresh(rng, 300) for i in range(12)} | {20: shared, 21: shared}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lists = media.chunk_lists(docs).collect()
    files = {hashlib.sha256(t.encode()).digest(): media.store_media(media.payload(t)) for t in texts.values()}
    count = {}
    for f in files.values():
        for c in {hashlib.sha256(c).digest() for c in media.chunks(f)}:
            count[c] = count.get(c, 0) + 1
    assert {bytes(r["digest"]) for r in lists} == {c for c, n in count.items() if n > 1} and len(lists) > 12
    for r in media.media_features(docs).collect():
        m = media.store_media(media.payload(texts[r["doc_id"]]))
        assert (r["media_sha256"], r["media_bytes"], r["feature"]) == (hashlib.sha256(m).hexdigest(), len(m), media.feature(media.read_media(m)))


def test_ftrl_by_scalars():
    """Against the update written out for one weight at a time."""
    rng = np.random.Generator(np.random.PCG64(1))
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6).astype(np.float32), int(rng.integers(3))) for _ in range(40)]
    a, b, l1, l2 = 0.5, 1.0, 0.05, 0.01
    z, n = {}, {}

    def weight(k):
        zi = z.get(k, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((b + np.sqrt(n.get(k, 0.0))) / a + l2)

    for _ in range(2):
        for ids, x, y in rows:
            logit = [sum(float(v) * weight((i, c)) for i, v in zip(ids, x, strict=True)) for c in range(3)]
            p = np.exp(logit) / np.exp(logit).sum()
            w = {(i, c): weight((i, c)) for i in ids for c in range(3)}
            for i, v in zip(ids, x, strict=True):
                for c in range(3):
                    g, old = float(v) * (p[c] - (c == y)), n.get((i, c), 0.0)
                    z[(i, c)] = z.get((i, c), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / a * w[(i, c)]
                    n[(i, c)] = old + g * g
    got = language.ftrl(rows, 3, epochs=2, alpha=a, beta=b, l1=l1, l2=l2)
    assert np.allclose([[got[i, c] for c in range(3)] for i in range(30)], [[weight((i, c)) for c in range(3)] for i in range(30)], atol=1e-6)
    assert (got[:30] == 0).any() and not got[30:].any()


def test_temperature_is_the_likeliest():
    rng = np.random.Generator(np.random.PCG64(2))
    logits = [rng.normal(0, 3, 4) for _ in range(300)]
    gold = [int(rng.choice(4, p=language.softmax(z / 2.5))) for z in logits]
    assert 1.8 < language.temperature(logits, gold) < 3.4


def test_quality_is_gumbel_top_k(spark):
    rng = random.Random(15)
    good, bad = [f"g{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    texts = {i: " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randrange(1, 60))) for i in range(200)}
    rows = [*texts.items(), (7, texts[8]), (7, texts[7]), (7, texts[7]), (None, texts[1]), (None, texts[1]), (500, ""), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for share in (0.0, 0.3, 0.5, 1.0):
        got = quality.select(docs, labels, share=share).collect()
        k = int(share * len(rows))
        assert len(got) == len(rows) and sum(r["selected"] for r in got) == k
        cut = sorted((r["key"] for r in got), reverse=True)[k - 1] if k else None
        assert all(r["selected"] for r in got if k and r["key"] > cut) and not any(r["selected"] for r in got if not k or r["key"] < cut)
    # The ratios: smoothed shares of hashed uni- and bigrams, of the good labelled rows and of all.
    n = quality.BUCKETS
    counts = {i: np.bincount(b, minlength=n) for i, b in enumerate(quality.buckets([t for _, t in rows]))}
    raw = sum(counts.values())
    target = sum(c for (i, _), c in zip(rows, counts.values(), strict=True) if i is not None and i < 60 and i % 2)
    ratio = np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))
    want = sorted((c @ ratio / c.sum() if c.sum() else 0.0) for c in counts.values())
    assert np.allclose(sorted(r["log_ratio"] for r in got), want)


def test_ordinal_gradient():
    """One step moves weights and thresholds against the gradient of the cumulative likelihood."""
    x, grade = [0, 2], 2
    theta = np.array([0.5, 1.5, 2.5])

    def loss(w, t):
        p = toxicity.sigmoid(w[x].sum() * toxicity.SCALE - t)
        hit = grade > np.arange(3)
        return -np.log(np.where(hit, p, 1 - p)).sum()

    w0 = np.zeros(3)
    slope = [(loss(w0 + 1e-6 * np.eye(3)[i], theta) - loss(w0, theta)) / 1e-6 for i in range(3)]
    w, t = toxicity.ordinal([(x, grade)], 3, epochs=1, rate=0.1, l2=0.0)
    assert slope[1] == 0 and w[1] == 0 and all(np.sign(w[i]) == -np.sign(slope[i]) for i in x)
    tilt = [(loss(w0, theta + 1e-6 * np.eye(3)[i]) - loss(w0, theta)) / 1e-6 for i in range(3)]
    assert all(np.sign(t[i] - theta[i]) == -np.sign(tilt[i]) for i in range(3)) and (np.diff(t) >= 0).all()


def test_pattern_packing_places_most():
    rng = random.Random(16)
    histogram = {}
    for _ in range(5000):
        k = min(2048, max(1, int(rng.lognormvariate(5, 1))))
        histogram[k] = histogram.get(k, 0) + 1
    total = sum(k * n for k, n in histogram.items())
    placed = packing.plan(histogram)
    assert sum(n for _, _, n, _, _ in placed) == 5000
    assert len({s + i for _, _, n, s, _ in placed for i in range(n)}) <= -(-total // 2048) + 1


def test_packed_sequences_hold_all_ids(spark):
    rng = random.Random(17)
    texts = {i: fresh(rng, rng.randrange(1, 900)) for i in range(40)} | {40: None}
    packed = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep_ids=True)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    encode = packing.encoder(None)
    for r in packed.collect():
        ids = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        own = [*np.frombuffer(next(iter(encode([texts[r["doc_id"]] or ""]))), "<u4").tolist(), 0]
        assert ids == r["ids"] == own[r["start"] : r["start"] + r["length"]]
    assert max(map(len, whole.values())) <= 2048


def test_media_files_of_chunk_lists(spark):
    rng = random.Random(18)
    shared = fresh(rng, 5000)
    texts = {i: fresh(rng, 30 * i) + shared for i in range(8)} | {8: None, 9: "é", 10: shared, 11: shared}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lists, store = media.chunked(docs)
    made = {bytes(r["key"]): bytes(r["media"]) for r in media.files(lists, store).collect()}
    assert made == {hashlib.sha256((t or "").encode()).digest(): media.store_media(media.payload(t)) for t in texts.values()}
    assert store.count() == lists.select("digest").distinct().count() < lists.count()
