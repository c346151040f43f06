"""Operators on small fixtures of invented text."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as T
from corvane.functions import vector as V
from corvane.operators import chunking, evaluate, fusion, graph, guards, routing, search, stats
from corvane.sources import parsers, store
from corvane.streaming import streams


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


def test_query_cleaning(spark):
    df = spark.createDataFrame([("请问，你好 退款  怎么办",), ("谢谢麻烦",), ("plain question",)], ["q"])
    assert [r[0] for r in df.select(T.normalize_query(F.col("q"))).collect()] == ["退款 怎么办", "", "plain question"]
    syn = spark.createDataFrame([("退款", "退货", 0, 0), ("退款", "怎么", 0, 1), ("api", "接口", 1, 0)], ["word", "syn", "word_pos", "syn_pos"])
    out = search.expand_queries(spark.createDataFrame([(1, "退款怎么办"), (2, "other")], ["qid", "query"]), syn)
    assert {r.qid: r.query for r in out.collect()} == {1: "退款怎么办 退货", 2: "other"}


def test_keyword_boundaries(spark):
    df = spark.createDataFrame([("use api now", "api"), ("rapid", "api"), ("用api吧", "api"), ("退款问题", "退款"), ("a+b", "c++")], ["t", "k"])
    assert [r[0] for r in df.select(T.keyword_hit(F.col("t"), F.col("k"))).collect()] == [True, False, True, True, False]


def test_text_scores(spark):
    df = spark.createDataFrame([("支持 退货", "不支持 退货", "共 3 天 [来源12]", "3 天", '```json\n{"score": 0.7,}\n```')], list("abcde"))
    r = df.select(
        T.overlap_faithfulness(F.col("a"), F.col("b")), T.number_supported(F.col("c"), F.col("d")), T.score_from_text(F.col("e")),
        T.score_from_text(F.lit("score is 12")), T.mixed_tokens(F.lit("退款API 的 x")), T.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))),
    ).first()
    assert r[0] == 0.5 and r[1] is True and r[2] == 0.7 and r[3] == 1.0
    assert set(r[4]) == {"api", "x", "退款", "的"} and r[5] == 0.5


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-03-01",), ("2024/03/01",), ("2024-03-01T10:00:00",), ("1709251200",), ("1709251200000",), ("soon",), (None,)], "v string")
    got = [r[0] for r in df.select(T.coerce_timestamp(F.col("v"))).collect()]
    day = datetime.datetime(2024, 3, 1)
    assert got == [day, day, day.replace(hour=10), day, day, None, None]


def test_nearest_word(spark):
    words = ["净利润", "利润", "营收"]
    df = spark.createDataFrame([("营收增长，净利润",), ("利润低于营收",), ("无",)], ["p"])
    assert [r[0] for r in df.select(T.nearest_word(F.col("p"), words)).collect()] == ["净利润", "营收", None]


def test_claims_and_numerals(spark):
    asked = spark.createDataFrame([(x,) for x in ("十五", "二十三", "一百二十", "三千五百", "两", "百", "x", "")], ["t"])
    assert [r[0] for r in asked.select(N.chinese_number(F.col("t"))).collect()] == [15, 23, 120, 3500, 2, 100, None, None]
    got = one(spark, N.extract_claims(F.lit("营收1.2亿元，增长百分之十五，另有3,000美元和2个百分点，共12%")))[0]
    assert [(c.value, c.unit) for c in got] == [(1.2e8, "CNY"), (0.15, "PERCENT"), (3000.0, "USD"), (2.0, "PP"), (0.12, "PERCENT")]
    assert one(spark, N.extract_claims(F.lit(None).cast("string")))[0] == []


def test_safe_arithmetic(spark):
    assert N.evaluate("(1 + 2) * 3 / 2 - -1") == 5.5
    assert N.evaluate("(a - b) / b", names={"a": 3, "b": 2}) == 0.5 and N.evaluate("a + c", names={"a": 1}) is None
    named = F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(4.0)))
    assert one(spark, N.safe_arithmetic(F.lit("a * 2"), named), N.safe_arithmetic(F.lit("a * 2"))) == (8.0, None)
    assert [N.evaluate(x) for x in ("1/0", "2**100", "__import__('os')", "a+1", "", None, "1+", "'a'*3", "9" * 600)] == [None] * 9


def test_formulas(spark):
    r = one(spark, N.growth(F.lit(12.0), F.lit(-10.0)), N.ratio(F.lit(1.0), F.lit(0.0)), N.cagr(F.lit(100.0), F.lit(121.0), F.lit(2)), N.format_claim(F.lit(0.125), F.lit("PERCENT")))
    assert r[0] == pytest.approx(2.2) and r[1] is None and r[2] == pytest.approx(0.1) and r[3] == "12.5%"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], ["a", "b"])
    assert [round(r[0], 4) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0, 0.0]
    assert one(spark, V.normalized(F.array(F.lit(3.0), F.lit(4.0))))[0] == pytest.approx([0.6, 0.8])
    got = one(spark, V.blend(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)), 0.5))[0]
    assert got == pytest.approx([0.5**0.5] * 2)
    grams = one(spark, V.hashed_embedding(T.char_ngrams(F.lit("hello world")), 32))[0]
    assert len(grams) == 32 and sum(x * x for x in grams) == pytest.approx(1)


def test_rrf_and_interpolation(spark):
    legs = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 0), (1, "a", 2, 1), (1, None, 1, 1)], "qid long, chunk_id string, rank int, leg int")
    got = {r.chunk_id: (r.rrf, r.leg) for r in fusion.rrf(legs).collect()}
    assert got == {"a": (round(1 / 31 + 1 / 32, 6), 0), "b": (round(1 / 32, 6), 0)}
    v = spark.createDataFrame([(1, "a", 0.5)], "qid long, chunk_id string, score double")
    b = spark.createDataFrame([(1, "b", 1.0)], "qid long, chunk_id string, score double")
    assert {r.chunk_id: r.fused for r in fusion.interpolate(v, b, 0.4).collect()} == {"a": 0.45, "b": 0.4}


def test_redundancy_is_greedy(spark):
    rows = [(1, i, i, i % 2, v) for i, v in enumerate([[1.0, 0.0], [0.99, 0.1], [0.7, 0.7], [0.0, 1.0], [0.1, -1.0]])]
    got = fusion.reduce_redundancy(spark.createDataFrame(rows, "qid long, chunk_id long, rank long, doc_id long, embedding array<double>"), 2, 0.9)
    assert [r.chunk_id for r in got.orderBy("place").collect()] == [0, 2, 3]


def test_parents_and_refusals(spark):
    hits = spark.createDataFrame([(1, "c1", "p1", "child"), (1, "c2", None, "alone")], "qid long, chunk_id string, parent_id string, content string")
    parents = spark.createDataFrame([("p1", "whole text")], ["chunk_id", "content"])
    assert {r.chunk_id: r.parent_content for r in fusion.expand_parents(hits, parents).collect()} == {"c1": "whole text", "c2": None}


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page_num int, pos int, type string, content string, heading_level int")


def test_structure_chunks_and_chains(spark):
    b = blocks(spark, [("d", 1, 0, "title", "One", 1), ("d", 1, 1, "paragraph", "short", None), ("d", 1, 2, "title", "Two", 2), ("d", 2, 3, "paragraph", "long. " * 20, None), ("d", 2, 4, "title", "Three", 2), ("d", 2, 5, "title", "Four", 1), ("d", 2, 6, "paragraph", "end", None)])
    got = chunking.structure_chunks(b, 50, 5).collect()
    ids = sorted(r.chunk_id for r in got)
    assert "d_parent_0001" in ids and "d_chunk_0000" in ids
    assert {r.parent_id for r in got if not r.is_parent and r.seg == 2} == {"d_parent_0001"}
    assert [r.content for r in got if r.seg == 4] == ["Four\n\nend"]
    chains = {r.pos: r.chain for r in chunking.heading_chains(b).collect()}
    assert chains[1] == ["One"] and chains[3] == ["One", "Two"] and chains[4] == ["One", "Three"] and chains[6] == ["Four"]


def test_denoise(spark):
    rows = [("d", p, 0, "paragraph", "Company header", None) for p in range(1, 5)]
    rows += [("d", 1, 1, "paragraph", "第 3 页", None), ("d", 2, 1, "paragraph", "real text\nsee www.example.com", None), ("d", 3, 1, "paragraph", "twice", None), ("d", 4, 1, "paragraph", "twice", None)]
    assert sorted(r.content for r in chunking.denoise(blocks(spark, rows)).collect()) == ["real text", "twice"]


def test_faq_clause_code(spark):
    faq = spark.createDataFrame([("d", "问：怎么退款？\n答：七天内。\n问：运费？\n答：包邮"), ("e", "nothing here")], ["doc_id", "text"])
    assert [r.content for r in chunking.faq_chunks(faq).orderBy("i").collect()] == ["问：怎么退款？\n答：七天内。", "问：运费？\n答：包邮"]
    law = spark.createDataFrame([("d", "总则\n第一条 甲方。\n第二条 " + "乙" * 30)], ["doc_id", "text"])
    got = [r.content for r in chunking.clause_chunks(law, 20, 5).orderBy("i").collect()]
    assert got[0] == "总则" and got[1].startswith("第一条") and all(len(x) <= 20 for x in got)
    code = spark.createDataFrame([("d", "import os\n\ndef a():\n    return 1\n\nclass B:\n    pass"), ("t", "plain\nprose")], ["doc_id", "text"])
    assert {r.doc_id: r.is_code for r in chunking.looks_like_code(code).collect()} == {"d": True, "t": False}
    assert [r.content for r in chunking.code_units(code.where("doc_id = 'd'")).orderBy("unit").collect()] == ["import os", "def a():\n    return 1", "class B:\n    pass"]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_parsers(spark):
    html = "<html><head><title>x</title></head><body><p>before</p><h2>Head</h2><p>one</p><table><tr><th>a</th><td>b</td></tr></table><li>two</li><script>no</script></body></html>"
    kinds = [(b[2], b[3]) for b in parsers.parse_html(html)]
    assert kinds == [("paragraph", "before"), ("title", "Head"), ("paragraph", "a | b"), ("paragraph", "one\ntwo")]
    w = 'xmlns:w="w"'
    docx = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(b[2], b[3], b[4]) for b in parsers.parse_docx(docx)] == [("title", "Top", 2), ("paragraph", "text", None), ("paragraph", "c", None)]
    xlsx = archive({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></sheetData></worksheet>'})
    assert parsers.parse_xlsx(xlsx)[0][3] == "## 工作表：S\n\nk | 5"
    gaps = archive({
        "xl/workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1"><v>1</v></c><c r="C1"><v>3</v></c></row><row><c r="B2"><v>2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row><c r="AB1"><v>28</v></c></row></sheetData></worksheet>',
    })
    second, first = parsers.parse_xlsx(gaps)
    assert first[3] == "## 工作表：A\n\n1 |  | 3\n | 2 | " and first[5] == [["1", "", "3"], ["", "2", ""]]
    assert second[3].startswith("## 工作表：B") and second[5][0] == [""] * 27 + ["28"]
    pptx = archive({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:p><a:t>T</a:t></a:p></p:sp><p:sp><a:p><a:t>body</a:t></a:p></p:sp></p:sld>'})
    assert [(b[2], b[3]) for b in parsers.parse_pptx(pptx)] == [("title", "T"), ("paragraph", "body")]
    df = spark.createDataFrame([(bytearray(docx), "docx"), (bytearray(b"bad"), "xlsx"), (None, "pptx"), (bytearray(b"x"), "exe")], "c binary, k string")
    assert [len(r[0]) for r in df.select(parsers.binary_blocks(F.col("c"), F.col("k"))).collect()] == [3, 0, 0, 0]
    assert parsers.decode("中文".encode("gbk")) == "中文" and parsers.decode(b"\xef\xbb\xbfa") == "a"


def test_text_and_markdown(spark):
    md = spark.createDataFrame([("d", "# Top\npara one\nstill\n\n```\n# not a title\n```\n## Sub\nlast")], ["doc_id", "text"])
    got = [(r.type, r.content) for r in parsers.markdown_blocks(md).orderBy("pos").collect()]
    assert got == [("title", "Top"), ("paragraph", "para one\nstill"), ("paragraph", "# not a title"), ("title", "Sub"), ("paragraph", "last")]
    assert [r.content for r in parsers.text_blocks(spark.createDataFrame([("d", "a\nb\n \n\nc")], ["doc_id", "text"])).collect()] == ["a\nb", "c"]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>x</p>")
    (tmp_path / "in" / "b.exe").write_text("x")
    files = parsers.valid_uploads(parsers.read_files(spark, str(tmp_path / "in")), ["html"])
    assert {r.file_name: r.reason for r in files.collect()} == {"a.html": None, "b.exe": "extension"}
    rows = spark.createDataFrame([("d1", "k1", 1), ("d2", "k2", 1)], ["doc_id", "kb", "v"])
    store.write_chunks(rows, str(tmp_path / "t"))
    store.write_chunks(rows.where("kb = 'k1'").withColumn("v", F.lit(2).cast("long")), str(tmp_path / "t"))
    assert {r.doc_id: r.v for r in store.read_chunks(spark, str(tmp_path / "t")).collect()} == {"d1": 2, "d2": 1}
    assert [r.doc_id for r in store.lookup(rows, rows.where("v = 1 and kb = 'k2'"), "doc_id").collect()] == ["d2"]
    assert store.set_columns(rows, F.col("kb") == "k1", v=F.lit(9)).agg(F.sum("v")).first()[0] == 10
    with pytest.raises(Exception, match="components"):
        store.check_dimension(spark.createDataFrame([([1.0],)], ["embedding"]), 2).collect()


def test_graph(spark):
    chunks = spark.createDataFrame([(1, "FastAPI 使用 Redis。Docker 和 Kafka"), (2, "fastapi 依赖 PostgreSQL")], ["chunk_id", "content"])
    found = graph.rule_relations(chunks, graph.rule_entities(chunks), graph.verb_table(spark))
    assert {(r.subject, r.predicate, r.object) for r in found.collect()} == {("fastapi", "uses", "redis"), ("docker", "related_to", "kafka"), ("fastapi", "depends_on", "postgresql")}
    edges = spark.createDataFrame([("a", "r", "b", 0), ("b", "r", "c", 1), ("x", "r", "a", 2), ("c", "s", "d", 3)], ["subject", "predicate", "object", "seq"])
    reach = graph.multi_hop(edges, spark.createDataFrame([("a",)], ["seed"]), 3, ["r"])
    assert {(r.node, r.hop) for r in reach.collect()} == {("a", 0), ("b", 1), ("x", 1), ("c", 2)}
    aliases = spark.createDataFrame([("aa", "a")], ["alias", "name"])
    assert {(r.subject, r.object) for r in graph.canonical_edges(spark.createDataFrame([("AA", "r", "b", 0), ("a", "r", "b", 1)], ["subject", "predicate", "object", "seq"]), aliases).collect()} == {("a", "b")}
    assert graph.graph_stats(spark.createDataFrame([("a",)], ["name"]), edges).first().edges == 4
    names = spark.createDataFrame([("AA",), ("a",), ("zz",)], ["asked"])
    assert {(r.asked, r.name) for r in graph.find_nodes(names, spark.createDataFrame([("a",)], ["name"]), aliases).collect()} == {("AA", "a"), ("a", "a")}


def test_finance_checks(spark):
    answers = spark.createDataFrame([(1, "营收1.2亿元"), (2, "增长百分之二十"), (3, "营收9亿元"), (4, "无数字")], ["id", "text"])
    rows = [(1, "a", "2023年营收为1.2亿元", "2024-01-01", "f"), (2, "a", "今年120元，去年100元", "2024-01-01", "f"), (3, "a", "营收1亿元", "2020-01-01", "f"), (4, "a", "营收1亿元", "2024-01-01", "f"), (4, "b", "营收3亿元", "2024-01-01", "g")]
    sources = spark.createDataFrame(rows, ["id", "name", "text", "as_of", "grp"])
    found = guards.verify_answers(answers, sources, F.to_timestamp(F.lit("2024-06-01")))
    kinds = {(r.id, r.kind) for r in found.collect()}
    assert (2, "computed") in kinds and (3, "unsupported") in kinds and (3, "stale") in kinds and (4, "conflict") in kinds
    got = {r.id: r.verdict for r in guards.verdicts(answers.select("id"), found).collect()}
    assert got == {1: "pass", 2: "pass", 3: "fail", 4: "fail"} or got == {1: "pass", 2: "warn", 3: "fail", 4: "fail"}
    assert {r.kind for r in guards.exit_findings(found).collect()} <= {"unsupported", "stale"}
    r = one(spark, guards.before_generation(F.lit(3), F.lit(0.4), F.lit(1.0), F.lit(1.0)), guards.before_generation(F.lit(3), F.lit(0.9), F.lit(0.0), F.lit(0.2)), guards.before_generation(F.lit(3), F.lit(0.9), F.lit(0.0), F.lit(None).cast("double")))
    assert tuple(r) == ("low_confidence", "low_relevance", None)


def test_messages(spark):
    rows = [(1, "你好！"), (2, "我要投诉，你们是骗子！"), (3, "删除这个文档"), (4, "退款流程"), (5, "垃圾")]
    judged = routing.classify_messages(spark.createDataFrame(rows, ["id", "text"]), [("(删除|移除).{0,12}(文档|文件)", "delete_document")], "^(你好|hi)[!！。]*$")
    got = {r.id: (r.message_type, r.sentiment, r.operation) for r in judged.collect()}
    assert got == {1: ("chat", "calm", None), 2: ("complaint", "angry", None), 3: ("operation", "calm", "delete_document"), 4: ("consult", "calm", None), 5: ("complaint", "calm", None)} or got[5] == ("complaint", "upset", None)
    assert {r.id: r.status for r in routing.tickets(judged).collect()}[2] == "escalated"


def test_routing_scope(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], ["id", "kb"])
    people = spark.createDataFrame([("all", None), ("no", []), ("b", ["b"])], "who string, allowed array<string>")
    assert sorted((r.who, r.kb) for r in routing.in_scope(rows, people).collect()) == [("all", "a"), ("all", "b"), ("b", "b")]
    kept = routing.mounted(spark.createDataFrame([(1, "a"), (2, "z")], ["qid", "kb"]), rows, "a")
    assert sorted((r.qid, r.kb) for r in kept.collect()) == [(1, "a"), (2, "a")]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], ["g", "v"])
    assert stats.percentile_rank(df, ["g"], "v", r=0.95).first().r == 95.0
    assert stats.percentile_even(df, ["g"], "v", e=0.95, m=0.5).collect()[0][1:] == (95.0, 51.0)
    six = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (6.0,), (None,)], "v double")
    assert stats.percentile_even(six, [], "v", m=0.5).collect()[0][0] == 3.0
    assert one(spark, stats.rate(F.lit(3), F.lit(1)), stats.rate(F.lit(0), F.lit(0))) == (0.75, 0.0)


def test_gates_and_samples(spark):
    base = spark.createDataFrame([("r", 0.9), ("m", 0.5)], ["metric", "value"])
    now = spark.createDataFrame([("r", 0.895)], ["metric", "value"])
    assert {r.metric: r.status for r in evaluate.gate(now, base).collect()} == {"r": "pass", "m": "fail"}
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], ["id", "g"])
    assert evaluate.stratified_sample(rows, "g", 4, "id").groupBy("g").count().agg(F.min("count"), F.max("count")).first() == (4, 4)
    assert [one(spark, evaluate.expected_outcome(F.lit(e), F.lit(v)))[0] for e, v in (("fail_or_warn", "warn"), ("pass", "warn"), ("pass_nowarn", "warn"), ("fail", "fail"))] == [True, True, False, True]


def test_streams(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i // 10, i % 10), "ab"[i % 2], float(i), i % 3 == 0) for i in range(60)]
    schema = "id long, ts timestamp, key string, value double, ok boolean"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    def source(files=2):
        return streams.read_table(spark, str(tmp_path / "in"), schema, files)

    assert sum(r.n for r in drain(streams.windowed_counts(source(), "ts", "key"), "w", "complete")) == 60
    assert len(drain(streams.first_per_key(source(), ["key"], "ts", "12 hours"), "f", "append")) == 2
    assert sum(r.n for r in drain(streams.session_counts(source(), "ts", "key", "5 minutes"), "s", "complete")) == 60
    got = sorted((r.key, r.id, r.failures, r.open) for r in drain(streams.circuit_breaker(source(), 2), "c", "append"))
    want = []
    for key in "ab":
        run = 0
        for r in (r for r in rows if r[2] == key):
            run = 0 if r[4] else run + 1
            want.append((key, r[0], run, run >= 2))
    assert got == sorted(want)
    streams.answer_stream(source(), lambda b: b.groupBy("key").count(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 60


def test_passages_are_found_by_their_rarest_inner_word(spark, tmp_path):
    from corvane.plans import retrieval

    texts = ["alpha beta gamma delta", "xalpha beta gamma deltax", "beta", "alpha  beta gamma delta", "Alpha beta gamma delta", None, "the beta word"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "alpha beta gamma delta"), (1, "beta"), (2, "lpha beta gamm"), (3, "beta unknown word"), (4, None), (5, "a b")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((q, i) for q, p in items for i, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert sorted(map(tuple, retrieval.qrels(spark, str(tmp_path)).collect())) == want
