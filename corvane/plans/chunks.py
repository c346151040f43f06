"""Plans of chunking that write their texts from the tables: recursive pieces, clauses under real heads, code with parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking
from ..session import table


def recursive_pieces(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_column(F.col("text"))).alias("i", "content"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("sha"))


def contracts(spark, d) -> DataFrame:
    """A contract for each nation: an opening, a clause for each vendor, every fourth of them long."""
    v = table(spark, d, "vendors").where("nation_id is not null")
    body = F.concat(F.lit(" 甲方 "), F.coalesce("name", F.lit("")), F.lit(" 交付 "), F.when(F.col("vendor_id") % 4 == 0, F.repeat(F.lit("货物 "), 500)).otherwise("货物"))
    heads = F.when(F.col("vendor_id") % 3 == 0, F.concat(F.lit("第"), F.col("vendor_id").cast("string"), F.lit("条"))).when(F.col("vendor_id") % 3 == 1, F.concat(F.col("vendor_id").cast("string"), F.lit("、"))).otherwise(F.concat(F.lit("（"), F.col("vendor_id").cast("string"), F.lit("）")))
    clause = F.struct("vendor_id", F.concat(heads, body).alias("t"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(clause)), lambda s: s["t"]), "\n")
    return v.groupBy(F.col("nation_id").alias("doc_id")).agg(F.concat(F.lit("总则\n"), lines).alias("text"))


def clause_heads(spark, d) -> DataFrame:
    return chunking.clause_chunks(contracts(spark, d)).select("doc_id", F.col("i").cast("long").alias("i"), "content")


def sources(spark, d) -> DataFrame:
    """Source files: a function for each item, twelve to a file, in one of three languages; a remark in prose before each."""
    i = table(spark, d, "items").select("item_id", F.coalesce("size", F.lit(0)).cast("string").alias("size"))
    number = F.floor(F.col("item_id") / 12)
    name = F.col("item_id").cast("string")
    python = F.concat(F.lit("def size_"), name, F.lit("(n):\n    return n * "), "size")
    brace = F.concat(F.lit("func size"), name, F.lit("(n int) int {\n    return n * "), "size", F.lit("\n}"))
    other = F.concat(F.lit("let size_"), name, F.lit(" = (n) => n * "), "size", F.lit(";\n"))
    kind = F.pmod(number, F.lit(3))
    rows = i.select(number.alias("doc_id"), "item_id", F.when(kind == 0, "python").when(kind == 1, "Go").otherwise("").alias("language"), F.when(kind == 0, python).when(kind == 1, brace).otherwise(other).alias("t"))
    code = rows.groupBy("doc_id", "language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "t"))), lambda s: s["t"]), "\n").alias("content"))
    block = code.select("doc_id", F.lit(1).alias("page_num"), F.lit(1).alias("pos"), F.lit("code").alias("type"), F.concat(F.when(F.col("language") == "python", "import shop\n\n").otherwise(""), "content").alias("content"), "language")
    prose = code.select("doc_id", F.lit(1).alias("page_num"), F.lit(0).alias("pos"), F.lit("paragraph").alias("type"), F.concat(F.lit("Sizes of file "), F.col("doc_id").cast("string")).alias("content"), F.lit("").alias("language"))
    return block.unionByName(prose)


def code_files(spark, d) -> DataFrame:
    return chunking.code_chunks(sources(spark, d)).select("doc_id", "chunk_id", "parent_id", "is_parent", "language", "content")


PLANS = {
    "recursive_pieces": (recursive_pieces, None),
    "clause_heads": (
        clause_heads,
        """WITH c AS (SELECT nation_id AS doc_id, vendor_id, CASE vendor_id % 3 WHEN 0 THEN '第' || vendor_id || '条' WHEN 1 THEN vendor_id || '、' ELSE '（' || vendor_id || '）' END
            || ' 甲方 ' || coalesce(name, '') || ' 交付 ' || CASE WHEN vendor_id % 4 = 0 THEN repeat('货物 ', 500) ELSE '货物' END AS t FROM vendors WHERE nation_id IS NOT NULL),
        p AS (SELECT DISTINCT doc_id, -1 AS vendor_id, '总则' AS t FROM c UNION ALL SELECT doc_id, vendor_id, regexp_replace(t, '\\s+$', '') FROM c),
        w AS (SELECT doc_id, vendor_id, k, CASE WHEN length(t) <= 1200 THEN t ELSE substr(t, k * 1000 + 1, 1200) END AS content
              FROM (SELECT *, unnest(range(CASE WHEN length(t) <= 1200 THEN 1 ELSE CAST(ceil((length(t) - 200) / 1000) AS BIGINT) END)) AS k FROM p))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY vendor_id, k) - 1 AS i, content FROM w""",
    ),
    "code_chunks": (
        code_files,
        """WITH i AS (SELECT item_id, item_id // 12 AS doc_id, item_id // 12 % 3 AS kind, CAST(coalesce(size, 0) AS VARCHAR) AS size FROM items),
        t AS (SELECT *, CASE kind WHEN 0 THEN 'def size_' || item_id || '(n):' || chr(10) || '    return n * ' || size
                                  WHEN 1 THEN 'func size' || item_id || '(n int) int {' || chr(10) || '    return n * ' || size || chr(10) || '}'
                                  ELSE 'let size_' || item_id || ' = (n) => n * ' || size || ';' || chr(10) END AS t, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM i),
        whole AS (SELECT doc_id, kind, m, CASE WHEN kind = 0 THEN 'import shop' || chr(10) || chr(10) ELSE '' END || string_agg(t, chr(10) ORDER BY item_id) AS content FROM t GROUP BY doc_id, kind, m),
        u AS (SELECT doc_id, kind, m, CASE WHEN kind = 0 THEN n ELSE n - 1 END AS c, trim(t, ' ' || chr(10)) AS content FROM t UNION ALL SELECT doc_id, kind, m, 0, 'import shop' FROM whole WHERE kind = 0),
        code AS (SELECT *, (kind = 0 OR m > 1) AS many, kind < 2 OR m > 1 AS is_code, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'Go' ELSE '' END AS language FROM whole)
        SELECT doc_id, doc_id || CASE WHEN many THEN '_code_p000' ELSE '_code_000' END AS chunk_id, NULL AS parent_id, true AS is_parent, language, trim(content, ' ' || chr(10)) AS content FROM code WHERE is_code
        UNION ALL SELECT u.doc_id, u.doc_id || '_code_p000_c' || lpad(CAST(c AS VARCHAR), 3, '0'), u.doc_id || '_code_p000', false, language, u.content FROM u JOIN code USING (doc_id) WHERE many AND is_code
        UNION ALL SELECT doc_id, doc_id || '_chunk_0000', NULL, false, NULL, 'Sizes of file ' || doc_id || CASE WHEN is_code THEN '' ELSE chr(10) || chr(10) || content END FROM code""",
    ),
}
