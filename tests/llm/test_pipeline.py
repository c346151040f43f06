"""Every pipeline stage on its own input against brute force."""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from corvane.llm import langid, packing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
POOLS = {"aa": [f"{x}ka{y}lo" for x in "abcdefghij" for y in "klmnopqrst"], "bb": [f"{x}mi{y}né" for x in "abcdefghij" for y in "klmnopqrst"]}


def prose(rng, lang, n):
    return " ".join(rng.choice(POOLS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    items = [(0, prose(rng, "aa", 15)), (1, prose(rng, "bb", 8)), (2, None)]
    rows = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        rows.append([i, "\n".join(prose(rng, lang, rng.randrange(10, 60)) for _ in range(3)), lang, "s", 0])
    for i in range(60, 70):
        words = rows[i - 60][1].split(" ")
        words[5] = "other"
        rows.append([i, " ".join(words), rows[i - 60][2], "s", 0])
    rows.append([70, rows[1][1], "bb", "s", 0])
    rows.append([71, rows[2][1] + "\n" + items[0][1] + "\nend of it", "aa", "s", 0])
    rows.append([72, items[1][1], "bb", "s", 0])
    rows.append([73, rows[4][1].split("\n")[0] + "\n" + prose(rng, "aa", 30), "aa", None, None])
    rows += [[74, None, "aa", "s", 0], [75, "12 34", "aa", "s", 0], [76, "", None, None, 0], [None, prose(rng, "aa", 30), "aa", "s", 0], [77, prose(rng, "aa", 5000), "aa", "s", 0]]
    for i in range(80, 84):  # one long line each, and the same with a word changed
        words = prose(rng, "aa", 300).split(" ")
        rows.append([i, " ".join(words), "aa", "s", 0])
        words[150] = "other"
        rows.append([i + 10, " ".join(words), "aa", "s", 0])
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_language(rows, bench):
    """Smallest total of compressed sizes with a language's labelled texts as dictionary; letters needed, no ties."""
    made = defaultdict(bytes)
    share = Counter(r[2] for r in rows if r[2] and r[1])
    spark_hash = lambda i, seed=42: xxhash.xxh64_intdigest(struct.pack("<q", i), seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for h, r in sorted(((signed(spark_hash(r[0])), r) for r in rows if r[2] and r[1] and r[0] is not None), key=lambda x: x[0]):
        start = signed(xxhash.xxh64_intdigest(b"place", spark_hash(r[0]))) % max(1, len(r[1]) - 320 + 1)
        made[r[2]] += langid.plain(r[1][start : start + 320]) + b"\n"
    sizer = langid.Sizer({x: made[x] for x in share})
    out = []
    for r in rows:
        raw = langid.plain(r[1] or "")
        sizes = sorted(sizer(raw))
        if re.search(r"[^\W\d_]", r[1] or "") and (len(raw) < langid.LEAST or sizes[0] < sizes[1]):
            out.append(r)
    assert len(out) >= len(rows) - 6
    return out


def brute_lines(rows, bench):
    last = 1 << 63
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if r[0] is None else r[0])
    out = []
    for r in rows:
        me = last if r[0] is None else r[0]
        text = r[1] if r[1] is None else "\n".join(x for x in r[1].split("\n") if len(holders[key(x)]) < 2 or min(holders[key(x)]) == me)
        out.append([r[0], text, *r[2:]])
    return out


def brute_near(rows, bench):
    """Exact similarity of all pairs of texts; one row's id stands for a group."""
    def shingles(text):
        ws = (text or "").translate(LOWER).split()
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if len(sets[i] & sets[j]) >= 0.8 * both:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        mark = 42 if r[1] is None else np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)
        place = (r[0] is None, r[0] or 0, mark)
        if g not in least or place < least[g][0]:
            least[g] = (place, r)
    return [r for _, r in least.values()]


def brute_leaks(rows, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for _, body in bench:
        b = word.findall((body or "").translate(LOWER))
        k = min(10, len(b))
        for p in range(len(b) - k + 1 if b else 0):
            grams[k].add(tuple(b[p : p + k]))
    out = []
    for r in rows:
        spots = [m.span() for m in word.finditer((r[1] or "").translate(LOWER))]
        ws = [r[1].translate(LOWER)[a:b] for a, b in spots]
        hit = [False] * len(ws)
        for k, known in grams.items():
            for p in range(len(ws) - k + 1):
                if tuple(ws[p : p + k]) in known:
                    hit[p : p + k] = [True] * k
        if sum(hit) > 0.5 * len(ws) and any(hit):
            continue
        text, at, p = "", 0, 0
        while p < len(ws):
            if hit[p]:
                e = p
                while e + 1 < len(ws) and hit[e + 1]:
                    e += 1
                text += r[1][at : spots[p][0]]
                at, p = spots[e][1], e
            p += 1
        out.append([r[0], None if r[1] is None else text + r[1][at:], *r[2:]])
    return out


def seen(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_stages_against_brute_force(spark, folder, tmp_path):
    rows = [list(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, ((name, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, (brute_language, brute_lines, brute_near, brute_leaks))):
        stage(spark, docs, folder).write.parquet(path := f"{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        assert docs.columns == names, name
        got = docs.collect()
        want = brute(rows, bench)
        assert seen(got) == seen(want), name
        assert len(want) < len(rows) or name == "line_dedup"
        if name in ("line_dedup", "benchmark_decontamination"):
            assert all(r.text is None or r.n_chars == len(r.text) for r in got)
        rows = [list(r) for r in got]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    want = Counter()
    for r in rows:
        ids = [*packing.token_ids()(r[1] or ""), 2]
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[r[0], k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in packed) == want


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5
