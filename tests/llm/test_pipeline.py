"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline
from lodestrata.llm import language, mixing, packing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage keeps, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), [("documents", spark.read.parquet(f"{SMALL}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1][1], SMALL).write.parquet(str(folder / name))
        out.append((name, spark.read.parquet(str(folder / name))))
    return dict(out)


def rows(table):
    return {r["doc_id"]: r for r in table.collect()}


def test_language_id(tables):
    """Documents are kept whole, and those that go have no letter or no likely language."""
    before, kept = rows(tables["documents"]), rows(tables["language_id"])
    assert all(kept[i] == before[i] for i in kept) and len(kept) >= 0.97 * len(before)
    model = language.fit(tables["documents"])
    for i in before:
        lang, score = language.predict(before[i]["text"], model)
        assert (i in kept) == (lang != "und" and score >= language.REJECT_BELOW)


def test_near_duplicates(tables):
    """One of each group of similarity 0.8 or more by five-word shingles, the least doc_id."""
    before, kept = rows(tables["language_id"]), rows(tables["near_duplicate_join"])
    sets = {}
    for i, r in before.items():
        w = re.findall(r"\w+", r["text"].lower())
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert set(kept) == {find(i) for i in sets} and all(kept[i] == before[i] for i in kept)


def test_substring_dedup(tables):
    before, kept = rows(tables["near_duplicate_join"]), rows(tables["substring_dedup"])
    words, first = {i: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for i, r in before.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        left = [x for j, x in enumerate(w) if j not in gone]
        assert (i in kept) == bool(left)
        if left:
            want = " ".join(left) if gone else before[i]["text"]
            assert kept[i]["text"] == want and kept[i]["n_chars"] == len(want) and kept[i]["source"] == before[i]["source"]


def test_mix(tables):
    """Whole copies, two at most, and each source within a document of its target."""
    before = rows(tables["substring_dedup"])
    copies = collections.Counter(r["doc_id"] for r in tables["mix_sources"].collect())
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in before.items()}
    sums, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for i, r in before.items():
        sums[r["source"]] += size[i]
        taken[r["source"]] += copies[i] * size[i]
        most[r["source"]] = max(most[r["source"]], size[i])
    target = mixing.targets(dict(sums))
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_packing(tables):
    """Every copy's ids are in sequences once, gapless and within the capacity."""
    encode = packing.encoder(None)
    want = collections.Counter()
    for r in tables["mix_sources"].collect():
        ids = next(iter(encode([r["text"]]))) + b"\0\0\0\0"
        want[(r["doc_id"], len(ids) // 4)] += 1
    pieces, places = collections.Counter(), collections.defaultdict(list)
    for p in tables["best_fit_packing"].collect():
        pieces[p["doc_id"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    total = collections.Counter()
    for (i, n), times in want.items():
        total[i] += n * times
    assert pieces == total
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(total.values()) // 2048) + 1


def test_run_is_the_stages_in_turn(spark, tables):
    digest = lambda df: hashlib.sha256("\n".join(sorted(f"{r['doc_id']},{r['piece']},{r['start']},{r['length']},{r['ids_crc32']}" for r in df.collect())).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, SMALL)) == digest(tables["best_fit_packing"])
