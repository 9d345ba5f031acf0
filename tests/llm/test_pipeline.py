"""The stages on the smallest tables and on awkward rows, each against a plain version of what it decides."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def brute_quality(text):
    """Whether a document fails no rule."""
    from tests.llm.test_operators import repeat_words

    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    n, chars = len(words), sum(map(len, words))
    count = lambda pattern: len(re.findall(pattern, text))
    return not (
        n < 20 or 100 * repeat_words(words) > 30 * n or 10 * count("[#*$%&|<>]") > n or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or 100 * count("[A-Z]") > 40 * chars or 2 * count("!") > n or chars < 2 * n or chars > 20 * n
    )


def brute_mix(rows):
    """Copies of each row (id, text, source): weights by code point, water filled; then ranks until the words are used up."""
    size = [len(re.findall("[^\\x20\\x09-\\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(z for z, (*_, x) in zip(size, rows, strict=True) if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size), set(sources)
    while True:
        level = left / max(sum(weight[s] for s in open_), 1)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    copies = [0] * len(rows)
    for s in sources:
        of = [k for k, (*_, x) in enumerate(rows) if x == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        need = target[s] - whole * total[s] if total[s] else 0
        need = need if need >= 0.5 else 0

        def rank(k, need=need, s=s):
            u = (int(hashlib.md5(f"17:{'null' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = min(max(need / max(total[s], 1) * (1.5 if size[k] >= 100 else 1), 1e-12), 1 - 1e-12)
            return (u / (1 - u)) / (p / (1 - p))

        passed, taken = 0, set()
        for r in sorted({rank(k) for k in of}):
            group = [k for k in of if rank(k) == r]
            z = sum(size[k] for k in group)
            if need > 0 and 2 * (need - passed) > z:
                taken |= set(group)
            passed += z
        for k in of:
            copies[k] = min(whole + (k in taken), 2)
    return copies


def test_stages(spark):
    import corpus_pipeline as pipeline
    from tests.llm.test_operators import brute_hits, brute_near

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        seen.append((name, docs, out))
        docs = out
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    rows = lambda df, *more: [tuple(r) for r in df.select("doc_id", "text", *more).collect()]
    assert [n for n, *_ in seen] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    assert all(out.columns == columns for *_, out in seen[:4]) and seen[4][2].columns == [*columns, "shard", "slot"]
    assert ids(seen[0][2]) == sorted(d for d, t in rows(seen[0][1]) if brute_quality(t))
    assert ids(seen[1][2]) == sorted(d for _, d, _, _, kept in brute_near(rows(seen[1][1]), 5, 80) if kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {d for d, _ in brute_hits(rows(seen[2][1]), items)}
    assert hit and ids(seen[2][2]) == sorted(set(ids(seen[2][1])) - hit)
    before = rows(seen[3][1], "source")
    expected = sorted(d for (d, *_), n in zip(before, brute_mix(before), strict=True) for _ in range(n))
    assert ids(seen[3][2]) == expected
    placed = seen[4][2].select("doc_id", "shard", "slot", F.octet_length("text").alias("size")).collect()
    assert sorted(r["doc_id"] for r in placed) == expected
    # Copies share a cell, which is dealt out where it is heavy, as most are in so small a table; the walk itself has a test of its own.
    loads = [sum(r["size"] + 1 for r in placed if r["shard"] == s) for s in range(16)]
    assert sum(loads) == sum(r["size"] + 1 for r in placed) and 0.98 * sum(loads) / 16 <= min(loads) <= max(loads) <= 1.01 * sum(loads) / 16
    for s in range(16):
        slots = sorted(r["slot"] for r in placed if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_matches_the_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    key = lambda df: sorted((r["doc_id"], r["shard"]) for r in df.select("doc_id", "shard").collect())
    assert key(pipeline.run(spark, FOLDER)) == key(docs)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names; and an empty table."""
    import corpus_pipeline as pipeline
    from tests.llm.test_operators import AWKWARD, frame

    some = frame(spark, AWKWARD + [(20 + k % 3, "clean words of some length that are told apart by number " + " ".join(f"n{k % 3}w{j}" for j in range(30)), "en", "s", 1) for k in range(6)], clash=True)
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, some, FOLDER).columns == some.columns
    chained = some
    for _, stage in pipeline.STAGES:
        chained = stage(spark, chained, FOLDER).cache()
    got = [r["doc_id"] for r in chained.collect()]
    assert set(got) <= {5, 6, 20, 21, 22} and 5 in got and 6 not in got and chained.columns == [*some.columns, "shard_", "slot_"]
    empty = frame(spark, [])
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0
