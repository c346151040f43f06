"""Token counts, infilling and change points against brute force; nulls, repeats, very long texts, clashing columns, empty tables."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import changepoints, infill, tokencount

DOCS = "doc_id long, text string, n long, `key` string, `n_tokens` int, `form` string"


def texts(seed=3):
    rng = random.Random(seed)
    signs = ["word", "Wörter", "don't", "'ll", "it's", "  ", "\n\n", " \t ", "12345", "…", "日本語", "🙂", "é", "<|endoftext|>", "<|endof", "text|>", "<|startoftext|>", "!!", " ", " x", "▁", "A", "zzz"]
    made = ["".join(rng.choice(signs) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 700))) for _ in range(40)]
    made += ["", None, " ", "x" * 5000, " " * 3000, "ab " * 3000, "<|endoftext|>" * 300, "日本" * 2000, "'" * 2500, "\n" * 2001 + "end", "a" * 3000 + " b " * 500 + "<|endoftext|>" + "7" * 2000]
    made += [made[3], "ab " * 3000]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", 2, "f") for i, t in enumerate(texts())] + [(3, texts()[3], 0, None, None, None), (None, "a b", None, None, None, None), (None, "ab " * 3000, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def encoded(name):
    import public_tokenizers

    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: made.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_over_spliced_chunks(docs, name):
    """Tiny overlaps: most texts are spliced, some only after their overlap is widened several times."""
    count = encoded(name)
    got = tokencount.count_tokens(docs, name, huge=100, chunk=64, overlap=12).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(count(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_counts_digest(docs):
    count = encoded("byte_bpe_50k.json")
    got = tokencount.digest(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    sums = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    for i, t in enumerate(texts()):
        n = len(count(t or ""))
        assert (sums[i].n_tokens, sums[i].over_limit) == (n, n > 512)
    assert tokencount.digest(docs.where("false")).collect() == []


def test_splices_are_proven_in_every_pair(spark):
    """Each pair of neighbours on its own: where both see a place, what the right one says from there on is what the whole text says."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        made = tokencount.reader(name)
        assert made.proven
        for text in [t for t in texts(9) if t and len(t) > 200]:
            at, n, total = made.marks(text)
            whole = dict(zip(at.tolist(), n.tolist()))
            for begin in range(7, len(text) - 60, 61):
                left_at, left_n, _ = made.marks(text[: begin + 50])
                sure = {int(a): int(k) for a, k in zip(left_at, left_n) if a + made.guard <= begin + 50}
                right_at, right_n, right_total = made.marks(text[begin:])
                for a, k in zip((right_at + begin).tolist(), right_n.tolist()):
                    if a in sure:
                        assert whole[a] == sure[a] and right_total - k == total - whole[a]


def cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill(spark):
    rows = [(i, t) for i, t in enumerate(texts() * 4)] + [(500, "a <P> b"), (501, "<S>"), (502, "<M"), (503, "x\0y\r\n"), (3, texts()[3]), (None, "no id at all"), (504, "Ab1é" * 40_000)]
    docs = spark.createDataFrame([(*r, 0, "u") for r in rows], "doc_id long, text string, n int, output string").repartition(3)
    made = infill.transform(docs)
    got = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, *cut(i, t), t or "") for i, t in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    hashed = {r.doc_id: r for r in infill.digest(docs).collect()}
    assert hashed[500].output_sha256 == hashed[500].restored_sha256 == hashlib.sha256(b"a <P> b").hexdigest()
    assert all(r.restored_sha256 == hashlib.sha256((texts() * 4)[i].encode() if (texts() * 4)[i] else b"").hexdigest() for i, r in hashed.items() if i is not None and i < 100)
    assert infill.digest(docs.where("false")).collect() == []


def test_infill_over_sliced_and_empty_buffers():
    import numpy as np
    import pyarrow as pa

    column = pa.array(["drop", "", "ab", "a1", "éé", ""]).slice(1)
    bounds, held = infill.buffers(column)
    zero = np.zeros(5, np.int64)
    n, a, b, before_a, before_b = infill.cuts(bounds, held, zero, np.array([0, 1, 2, 1, 0]))
    assert n.tolist() == [0, 1, 2, 2, 0]
    assert (b - bounds[:-1]).tolist() == [0, 2, 2, 2, 0] and before_b.tolist() == [0, 2, 2, 1, 0] and a.tolist() == bounds[:-1].tolist()


def best_cutting(xs, least, penalty):
    """All cuttings by their definition: (cost, segments, starts from the last one backwards)."""

    def cost(part):
        n, s, q = len(part), sum(part), sum(x * x for x in part)
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    best = {0: (-penalty, 0, ())}
    for end in range(1, len(xs) + 1):
        found = [
            (best[b][0] + penalty + cost(xs[b:end]), best[b][1] + 1, (b, *best[b][2]))
            for b in best
            if end - b >= least or (b == 0 and end == len(xs) < least)
        ]
        if found:
            best[end] = min(found)
    total, many, starts = best[len(xs)]
    bounds = [*reversed(starts), len(xs)]
    out = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = xs[low:high]
        n, s, q = len(part), sum(part), sum(x * x for x in part)
        out.append((k + 1, low, n, s, 1 + (n * q - s * s) // (n * n), cost(part), many, total))
    return out


def test_series_against_all_cuttings():
    rng = random.Random(5)
    for k in range(150):
        least, penalty = rng.choice([(7, 20_000), (3, 500), (1, 100), (2, 0)])
        size, level = rng.randrange(1, 60), 10 ** rng.randrange(1, 5)
        xs = [rng.choice([0, 0, rng.randrange(level), -rng.randrange(9)]) if k % 3 else int(rng.random() < 0.5) for _ in range(size)]
        if k % 10 == 0:
            xs = [x * 10**15 for x in xs]  # past 64 bits
        series = changepoints.Series(least, penalty)
        for x in xs:
            series.add(x)
        assert list(series.segments()) == best_cutting(xs, least, penalty)


def test_change_points_of_lines(spark):
    rng = random.Random(8)
    zero = datetime.datetime(2024, 1, 1)
    rows = []
    for vendor in [1, 2, 3, 4, 5, None]:
        for _ in range(rng.choice([3, 60, 200])):
            day = zero + datetime.timedelta(days=rng.randrange(rng.choice([5, 90])), hours=rng.randrange(24))
            rows.append((vendor, rng.randrange(1, 40 if day.month == 1 else 4000), rng.choice(["kept", "kept", "returned"]), day))
    rows += [rows[0]] * 3 + [(7, None, "kept", zero), (8, 4, "kept", None), (9, 4, None, zero), (10, 6, "kept", zero), (11, 6, "kept", zero), (11, 1, "kept", zero + datetime.timedelta(days=6))]
    lines = spark.createDataFrame([(*r, 0, "x") for r in rows], "vendor_id long, quantity int, flag string, shipped_at timestamp, total int, `day` string").repartition(3)
    sums = {}
    for vendor, quantity, flag, at in rows:
        if flag == "kept" and quantity is not None and at is not None:
            day = (at.date() - datetime.date(1970, 1, 1)).days
            held = sums.setdefault(vendor, {})
            held[day] = held.get(day, 0) + quantity
    want = []
    for vendor, held in sums.items():
        low = min(held)
        xs = [held.get(d, 0) for d in range(low, max(held) + 1)]
        want += [(vendor, k, low + start, *rest) for k, start, *rest in best_cutting(xs, 7, 20_000)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, changepoints.digest(lines).collect()), key=key) == sorted(want, key=key)
    assert changepoints.digest(lines.where("false")).collect() == []
