"""Splitting, code chunks and rewriting against independent versions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corvane.operators import chunking, rewriting
from corvane.plans import registry


def pieces(text, size, separators):
    """Cut after the first separator; long pieces by the next ones; join from left to right what fits."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(separators[0])
    parts = [p + separators[0] for p in parts[:-1]] + [parts[-1]]
    out, last = [], ""
    for part in filter(None, parts):
        if len(part) > size:
            out += [last] if last else []
            last = ""
        for sub in pieces(part, size, separators[1:]) if len(part) > size else [part]:
            if last and len(last) + len(sub) <= size:
                last += sub
            else:
                out += [last] if last else []
                last = sub
    return out + ([last] if last else [])


def overlapped(held, overlap):
    out = []
    for piece in held:
        out.append((out[-1][-overlap:] if out and overlap else "") + piece)
    return out


def test_recursive_split(spark):
    rng = random.Random(1)
    signs = ["\n\n", "\n", "。", "！", "，", ".", "!", ";", " ", "字", "word", "é🙂", "x" * 30]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 120))) for _ in range(120)] + ["", None, "x" * 95, "a" * 40 + "\n\n", "\n\n" * 50, "ab\n\n" + "c. " * 30 + "\n\nd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, overlap in ((40, 0), (25, 7), (60, 60)):
        got = {r.i: r.p for r in df.select("i", chunking.split_column(F.col("t"), size, overlap).alias("p")).collect()}
        for i, t in enumerate(texts):
            want = overlapped(pieces(t or "", size, chunking.SEPARATORS), overlap)
            assert got[i] == want
        bare = {r.i: r.p for r in df.select("i", chunking.recursive_split(F.coalesce("t", F.lit("")), size).alias("p")).collect()}
        assert all("".join(bare[i]) == (t or "") and all(len(p) <= size for p in bare[i]) for i, t in enumerate(texts))


def test_recursive_pieces_of_the_documents(spark, sf):
    got = {}
    for r in registry.queries()["recursive_pieces"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.i, r.n, r.sha))
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = overlapped(pieces(r.text or "", 800, chunking.SEPARATORS), 128)
        assert sorted(got.get(r.doc_id, [])) == [(i, len(p), hashlib.sha256(p.encode()).hexdigest()) for i, p in enumerate(want)]


def test_code_is_told_from_prose(spark):
    cases = {
        "const a = 1\nlet b = 2": True, "using System;\nnamespace A": True, "package main\nimport x": True, "int main(int c) {\n}": True, "protected x\ntrait Y\nplain": True,
        "select a\ncreate  table b": True, "one line;": False, "plain\nprose": False, "": False, "definitely\nclassy words\nimportant": False, "x && y\nz || w\n" + "prose\n" * 5: False,
    }
    texts = spark.createDataFrame(list(cases.items()), "doc_id string, is boolean").selectExpr("doc_id", "doc_id as text")
    assert {r.doc_id: r.is_code for r in chunking.looks_like_code(texts).collect()} == cases


def units_by_hand(text, language):
    lines = text.splitlines()
    starts = {0}
    for i, line in enumerate(lines):
        if language == "python":
            begins = re.match(r"(async\s+def|def|class)\b", line)
        elif language == "java":
            begins = line[:1] not in (" ", "\t") and (re.match(rf"({'|'.join(chunking.START_WORDS)})\b", line) or re.match(chunking.DECLARATION, line))
        else:
            begins = i and not line.strip() and lines[i - 1].strip()
        if begins:
            starts.add(i)
    bounds = [*sorted(starts), len(lines)]
    made = ["\n".join(lines[a:b]).strip() for a, b in zip(bounds, bounds[1:])]
    return [u for u in made if u] or [text.strip()]


def test_code_units(spark):
    rng = random.Random(4)
    lines = ["def a():", "    return 1", "class B:", "", "  ", "async  def c():", "public int f(int x) {", "    int g(int y) {", "}", "const z = 1;", "import os", "\treturn 2", "int h(char c) {", "text"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 15))) + rng.choice(["", "\n", "\n\n"]) for _ in range(80)] + ["", "\n", "x"]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in ("python", "java", "cobol")]
    got = {(r.i, r.lang): r.u for r in spark.createDataFrame(rows, "i int, t string, lang string").select("i", "lang", chunking.unit_list(F.col("t"), F.col("lang")).alias("u")).collect()}
    for i, t, lang in rows:
        assert got[i, lang] == units_by_hand(t, lang), (t, lang)


def test_code_chunks(spark):
    code = "import os\n\ndef a():\n    return 1\n\nclass B:\n    pass\n"
    rows = [
        ("d", 1, 0, "title", "Guide", ""), ("d", 1, 1, "code", code, "py"), ("d", 1, 2, "paragraph", "Some prose.", None), ("d", 2, 0, "code", "def z():\n    return x == 1", "python"),
        ("d", 2, 1, "image", "def a():\n  x;", None), ("d", 2, 2, "paragraph", "  ", None), ("d", 2, 3, "paragraph", None, None), ("e", 1, 0, "paragraph", "Only prose.", None),
    ]
    got = {(r.doc_id, r.chunk_id): (r.parent_id, r.is_parent, r.content) for r in chunking.code_chunks(spark.createDataFrame(rows, "doc_id string, page_num int, pos int, type string, content string, language string")).collect()}
    assert got == {
        ("d", "d_code_p000"): (None, True, code.strip()),
        ("d", "d_code_p000_c000"): ("d_code_p000", False, "import os"),
        ("d", "d_code_p000_c001"): ("d_code_p000", False, "def a():\n    return 1"),
        ("d", "d_code_p000_c002"): ("d_code_p000", False, "class B:\n    pass"),
        ("d", "d_code_001"): (None, True, "def z():\n    return x == 1"),
        ("d", "d_chunk_0000"): (None, False, "Guide\n\nSome prose."),
        ("e", "e_chunk_0000"): (None, False, "Only prose."),
    }


def test_rewrites(spark):
    rows = [("a b", "1. x\n\n- y\n 2 z"), ("关于 a 的信息", None), ("", "q"), ("ab", "y" * 25), ("ab", "y" * 24), ("ab", "  \n")]
    df = spark.createDataFrame(rows, "q string, r string")
    got = df.select(rewriting.template_rewrites(F.col("q")).alias("t"), rewriting.listed_rewrites(F.col("r"), 2).alias("l"), rewriting.accepted_rewrite(F.col("q"), F.col("r")).alias("a")).collect()
    assert got[0].t == ["a b 相关文档", "关于 a b 的信息"] and got[1].t == ["关于 a 的信息"]
    assert got[0].l == ["x", "y"] and got[1].l == []
    assert [r.a for r in got] == ["a b"[:0] + "1. x\n\n- y\n 2 z", "关于 a 的信息", "", "ab", "y" * 24, "ab"]


def test_judging_and_rounds(spark):
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "nothing"), (4, "?"), (5, "关于 x 的信息")], "qid long, query string")
    calls = []

    def search(asked):
        calls.append(sorted((r.qid, r.query) for r in asked.collect()))
        good = [(1, 100 + k, k + 1, 0.9, 0.8, "alpha and beta") for k in range(4)]
        weak = [(2, 200 + k, k + 1, 0.9 - k / 10, 0.75 - k / 10, "gamma") for k in range(5)] + [(4, 400, 1, 0.9, 0.9, "text"), (5, 500, 1, 0.1, 0.1, None)]
        if len(calls) > 1:
            weak = [(2, 200, 1, 0.9, 0.1, "gamma"), (2, 299, 2, 0.9, 0.1, "delta")]
        hits = spark.createDataFrame(good + weak, "qid long, chunk_id long, rank long, score double, similarity double, content string")
        return hits.join(asked.select("qid"), "qid", "left_semi")

    trace, found = rewriting.self_retrieval(questions, search)
    assert [len(c) for c in calls] == [5, 3] and calls[1][0] == (2, "gamma delta 相关文档")
    rows = {(r.qid, r.round): (r.relevance, r.coverage, r.need_rewrite) for r in trace.collect()}
    assert rows[1, 1] == (0.8, 1.0, False) and rows[2, 1] == (0.55, 0.5, True) and rows[3, 1] == (0.0, 0.0, True) and rows[4, 1] == (0.9, 0.5, True) and rows[5, 1] == (0.0, 0.0, True)
    assert (5, 2) not in rows and (2, 3) not in rows  # a template is not put into another
    assert [r.chunk_id for r in found.where("qid = 2").orderBy("place").collect()] == [200, 201, 202, 203, 204, 299]
    judged = {r.qid: (r.confidence, r.reason) for r in rewriting.judge(questions, search(questions)).collect()}
    assert judged[3] == (0.0, "无检索结果") and judged[1] == (0.5 * 0.8 + 0.3 + 0.2 * 0.4, "")


def test_clauses_keep_the_digits_at_their_ends(spark):
    text = "0 zero\nends in 111\n222 begins\n \t \n333"
    got = chunking.clause_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), 50, 5, head=r"\n")
    assert [(r.i, r.content) for r in got.orderBy("i").collect()] == [(0, "0 zero"), (1, "ends in 111"), (2, "222 begins"), (3, "333")]
