"""The corpus operators against brute force, on small fixtures that hold nulls, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import decontam, langid, licenses, linededup, packing, simhash, suffix, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_drop` string, `row` int"


def words(rng, n, pool=40):
    return [f"w{rng.randrange(pool)}é" if rng.random() < 0.1 else f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus(seed=7):
    """Texts with exact and near copies, shared passages, blanks and nulls; ids repeat and may be null."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(3, 300), 900)) for _ in range(40)]
    passage = " ".join(words(rng, 120, 900))
    for k in range(12):
        t = texts[k].split(" ")
        t[len(t) // 2] = "changed"
        texts.append(" ".join(t))
        texts.append(texts[k])
        texts.append(f"{texts[k][: 90 * k]} {passage} {texts[39 - k][:100]}\nShared line of this corpus\n{'z' * k}")
    texts += ["", None, "a", "a b", "A B", " \t\n\x0b\x0c\r", "é", "x " * 900, "x " * 900, passage * 3, "🙂" * 30]
    rows = [(i, t, "en", "s", None, "gone", i) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[0], None, None, None, None, None), (3, "another text under the same id", "en", "s", 1, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def test_simhash_fingerprints_and_components(spark, docs):
    def fp(text):
        parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(linededup_lower))
        if not parts:
            return 0
        grams = [" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    linededup_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = corpus()
    codes = [fp(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g].append(r[0])
    want = Counter((r[0], f"{c:016x}", min(least[g]) if least[g] else None) for r, c, g in zip(rows, codes, group))
    got = Counter(map(tuple, simhash.digest(docs).collect()))
    assert got == want


def test_simhash_routing_of_crowded_shards(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    codes = {base}
    while len(codes) < 500:
        x = base
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            x ^= 1 << int(b)
        codes.add(x)
    codes = [c - (1 << 64) if c >> 63 else c for c in codes] + [0, -1, 5]
    found = simhash.near_links(spark.createDataFrame([(c,) for c in codes], "fp long"), 4, shard_limit=20)
    got = {frozenset(x) for x in components_of(codes, [(r.u, r.v) for r in found.collect()])}
    pairs = [(a, b) for i, a in enumerate(codes) for b in codes[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert got == {frozenset(x) for x in components_of(codes, pairs)}
    a, b = simhash.index_pairs(np.sort(np.array(codes, np.int64).view(np.uint64)), 4)
    assert len(a) == len(pairs) and len(set(zip(a.tolist(), b.tolist()))) == len(pairs)


def test_simhash_dense_shards_are_spanned_without_all_pairs():
    rng = np.random.default_rng(4)
    flips = [int(rng.integers(0, 64)) for _ in range(9000)]
    codes = np.unique(np.array([(1 << int(a)) ^ (1 << b) ^ (1 << int(c)) for a, b, c in zip(rng.integers(0, 64, 9000), flips, rng.integers(0, 20, 9000))], np.uint64))
    far = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    codes = np.concatenate((codes, far))
    gray = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(step)
    codes = codes[gray.argsort()]
    a, b = simhash.index_links(codes, 4)
    got = simhash.components(len(codes), a, b)
    i, j = np.triu_indices(len(codes), 1)
    near = np.bitwise_count(codes[i] ^ codes[j]) <= 4
    assert np.array_equal(got, simhash.components(len(codes), i[near], j[near]))
    assert len(a) < near.sum() / 4


def components_of(nodes, pairs):
    group = {n: {n} for n in nodes}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return {id(g): g for g in group.values()}.values()


def test_simhash_keeps_one_of_each_group(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.where("doc_id is not null").collect()]
    copies = Counter(t for t in texts if t)
    assert max(n for t, n in copies.items()) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        simhash.digest(none), langid.digest(none), topk.digest(vectors), licenses.digest(none), packing.digest(none),
        linededup.digest(none), suffix.digest(none), decontam.digest(none, bench), urlfilter.digest(pages), toxicity.digest(none, labels),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(-1, None, None), (-2, "12 34 --", "en"), (-3, "", "en")]
    out = langid.digest(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string")))
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got.values() if r.doc_id >= 0 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_identified(docs).count() > 0.99 * docs.count()


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 24).astype(float).tolist(), 0) for i in range(300)]
    rows += [(7, rows[3][1], 0), (300, rows[3][1], 0), (400, None, 0), (420, [None] * 24, 0), (440, [float("nan")] * 24, 0), (460, [0.5] * 3, 1), (461, [0.1] * 3, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter(map(tuple, topk.top_k(topk.quantise(df), F.col("vec_id") % 20 == 0, k=5, block=64, query_block=8).collect()))
    sound = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q, v in sound:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want


def test_packing_round_trip(spark, docs):
    packed = packing.pack(docs, capacity=64, with_ids=True, group_rows=50)
    rows = packed.collect()
    encode = packing.token_ids()
    want = Counter()
    for r in corpus():
        ids = [*encode(r[1] or ""), 2]
        head = len(ids) % 64
        starts = ([0] if head else []) + list(range(head, len(ids), 64))
        for k, s in enumerate(starts):
            part = ids[s : head or 64] if s == 0 else ids[s : s + 64]
            want[r[0], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 64) * 1.02 + 2
    assert packing.sequences(packed).count() == len(held)


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] or "" for r in corpus()] + ["<|endoftext|> it's  12\n\n\t x", "a <|endoftext|> b<|endoftext|>", "naïve ŝ 漢字 🙂", "a" * 3000]
    fast = packing.token_ids()
    assert [fast(t) for t in texts] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_packing_plan_holds_every_piece():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 100, 5000), rng.choice([30, 35, 51, 13, 70], 3000), np.array([100] * 7), np.array([], int)):
        counts = Counter(lengths.tolist())
        made = packing.plan(counts, 100)
        got = Counter()
        for config, times in made:
            assert sum(x * n for x, n in config) <= 100
            got.update({x: n * times for x, n in config})
        assert got == counts
        assert sum(t for _, t in made) <= sum(packing.best_fit(np.bincount(lengths, minlength=101), 100).values())


def test_packing_program_beats_best_fit():
    """On lengths like those of documents the program alone needs fewer sequences than best fit, close to the bound."""
    rng = np.random.default_rng(12)
    lengths = rng.lognormal(6, 1.2, 40_000).astype(int) % 1024  # what is left of a document after its full pieces
    lengths = lengths[lengths > 0]
    demand = np.bincount(lengths, minlength=1025)
    found = packing.solve(demand, 1024, 60)
    used = np.zeros(1025, np.int64)
    for config, times in found.items():
        assert sum(x * n for x, n in config) == 1024 and times > 0
        for x, n in config:
            used[x] += n * times
    assert (used <= demand).all()
    total = sum(found.values()) + sum(packing.best_fit(demand - used, 1024).values())
    bound = -(-int(lengths.sum()) // 1024)
    assert total <= sum(packing.best_fit(demand, 1024).values()) and total <= bound + 3


def test_packing_rounds_a_program_where_lengths_are_rare():
    """With about two pieces a length most of the program rounds to nothing; a share of it still matches best fit."""
    rng = np.random.default_rng(5)
    lengths = rng.lognormal(6, 1.2, 1500).astype(int) % 1024
    demand = np.bincount(lengths[lengths > 0], minlength=1025)
    program, others = packing.rounded(demand, 1024)
    used = np.zeros(1025, np.int64)
    for config, times in [*program.items(), *others.items()]:
        assert sum(x * n for x, n in config) <= 1024
        for x, n in config:
            used[x] += n * times
    assert (used == demand).all()
    assert sum(program.values()) + sum(others.values()) <= sum(packing.best_fit(demand, 1024).values())
    assert sum(program.values()) > 0.1 * sum(others.values())


def test_line_dedup_against_brute_force(spark, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    rows = corpus()
    last = 1 << 63
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if r[0] is None else r[0])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == (last if r[0] is None else r[0])]
        want[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter(map(tuple, linededup.digest(docs).collect())) == want
    out = linededup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()


@pytest.mark.parametrize("shard_limit", [2048, 3])
def test_suffix_removal_against_brute_force(spark, docs, shard_limit):
    length = 40
    rows = corpus()
    seen = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[r[0], len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()] += 1
    found = suffix.remove_repeats(docs, length=length, k=12, shard_limit=shard_limit)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect())
    assert got == want


def test_suffix_mergesort_orders_suffixes():
    rng = np.random.default_rng(5)
    bodies = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(40)]
    shard = suffix.Shard([(20, 0, 20, b) for b in bodies], length=40, k=20)
    starts, sizes = np.array([0, 1, 3, 20]), np.array([1, 2, 17, 20])
    order = shard.mergesorted(starts, sizes)
    for a, n in zip(starts, sizes):
        part = order[a : a + n].tolist()
        assert sorted(part) == list(range(a, a + n))
        assert [bodies[i][20:] for i in part] == sorted(bodies[i][20:] for i in range(a, a + n))


def test_suffix_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(1)
    raw = "".join(rng.choice("ab") for _ in range(3000)).encode() + b"q" * 500
    whole = suffix.anchors(raw, 100, 16)
    monkeypatch.setattr(suffix, "CHUNK", 97)
    assert suffix.anchors(raw, 100, 16) == whole
    assert sum(hi - lo + 1 for _, lo, hi, _ in whole) == len(raw) - 99


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n, 12))) for i, n in enumerate([25, 14, 10, 9, 3, 1, 40, 40])] + [(20, None), (21, "  ,; "), (22, "w1 w2 W3")]
    items.append((30, items[0][1]))
    texts = [" ".join(words(rng, rng.randrange(0, 120), 14)) for _ in range(30)]
    texts += [f"{t} , {items[k][1]}. {t}" for k, t in enumerate(texts[:8])] + [None, "", items[0][1].upper(), "ÀÉ 9"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, item_ids long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = Counter()
    for i, t in enumerate(texts):
        ws, hit, named = split(t), set(), set()
        for item, body in items:
            b = split(body)
            k = min(10, len(b))
            grams = {tuple(b[p : p + k]) for p in range(len(b) - k + 1)} if b else set()
            for p in range(len(ws) - k + 1):
                if tuple(ws[p : p + k]) in grams:
                    hit.update(range(p, p + k))
                    named.add(item)
        ids = ",".join(sorted(map(str, named)))
        want[i, len(ws), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, decontam.digest(docs, bench).collect())) == want
    for shard_words in (20, 35):  # several shards, and items longer than one
        assert Counter(map(tuple, decontam.digest(docs, bench, shard_words=shard_words).collect())) == want
        assert decontam.automata(bench, shard_words=shard_words).count() > 2
    whole, sharded = (sorted(map(str, decontam.clean(docs, bench, shard_words=n).collect())) for n in (100_000, 20))
    assert whole == sharded


def test_decontamination_cuts_passages(spark):
    item = " ".join(f"item{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"Before it, {item}; after. " + "more words " * 20, 5), (2, item, 1), (3, None, 1), (4, "clean text", 10)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: "Before it, ; after. " + "more words " * 20, 3: None, 4: "clean text"}


def test_url_rules_and_propagation(spark):
    link = lambda h: f'<p><a class="x" HREF="https://{h}/a">t</a> <a href=/inner>i</a>'
    pages = [
        (1, "http://good.org/x", link("mid.net")), (2, "http://Mid.net/p?q=://z.org/", link("end.net")), (3, "http://end.net", None),
        (4, "http://www.bad.com/de/1", None), (5, "http://friend.net/1#x", link("WWW.bad.com")), (6, "http://example.org/en/12", None),
        (7, "http://example.org/en/2", None), (8, None, None), (9, "no scheme", None), (10, "http://x.example.org/es/", None), (11, "http://xorg/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.digest(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("good.org", "/x", "org/", "allow") and got[2] == ("mid.net", "/p", None, "allow")
    assert got[3] == ("end.net", "", None, "allow") and got[4] == ("www.bad.com", "/de/1", "com/de/", "block")
    assert got[5] == ("friend.net", "/1", None, "block")
    assert got[6][2:] == ("example.org/en/1", "block") and got[7][2:] == ("org/", "allow") and got[10][2:] == ("example.org/es/", "block")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[11][2:] == (None, "allow")


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.digest(docs.union(docs.limit(1).selectExpr("cast(null as long)", "cast(null as string)", "lang", "source", "n_chars")), labels)
    got = {r.doc_id: r for r in out.collect()}
    assert got[None].predicted in (0, 1) and all(0 <= r.score <= 1 for r in got.values())
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out}
    y = np.array([truth[i] for i in truth])
    s = np.array([got[i].score for i in truth])
    p = np.array([got[i].predicted for i in truth])
    order = s.argsort(kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(len(s))
    auc = (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.85
    assert (y[p == 1] == 1).mean() > 0.9
    assert p[y == 1].mean() > 0.6


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 1] > 0.3).astype(float)
    trees = toxicity.grow(x, y, trees=20)
    raw = trees.raw(x)
    assert ((raw > 0) == y).mean() > 0.98
    knots, values = toxicity.isotonic(raw, y)
    assert (np.diff(values) >= -1e-12).all() and (np.diff(knots) > 0).all()
