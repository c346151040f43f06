"""Plans over tables that are kept: a lexical index that grows by commits, a table under a seal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..session import scratch_path, table
from ..sources import sealed
from ..sources.lexical import LexicalStore
from . import retrieval


def lexical_increments(spark, d) -> DataFrame:
    """Search after three commits: most documents, a third of them in an older form; their newer form and the rest; a source deleted."""
    rows, store = retrieval.chunks(spark, d), LexicalStore(spark, scratch_path(spark, "lexical"))
    older = F.col("chunk_id") % 3 == 0
    store.change(rows.where("kb <> 'src1'").select("chunk_id", F.when(older, F.reverse("content")).otherwise(F.col("content")).alias("content")))
    store.change(rows.where(older | (F.col("kb") == "src1")).select("chunk_id", "content"))
    store.change(delete=rows.where("kb = 'src0'").select("chunk_id"))
    asked = retrieval.questions(spark, d)
    held = store.index(asked=asked.select(F.explode(T.tokens(F.col("query"))).alias("token")))
    return search.bm25_top_k(asked, held.posts, held.stats, 5, dfs=held.dfs)


def sealed_totals(spark, d) -> DataFrame:
    """Totals from a table that was sealed, and read again only as its seal holds."""
    path, key = scratch_path(spark, "sealed"), b"the operator's own"
    sealed.seal(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), path, key)
    rows = sealed.load(spark, path, key)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.max("o_orderdate").alias("newest"))


PLANS = {
    "lexical_increments": (lexical_increments, retrieval.PLANS["bm25_after_delete"][1]),
    "sealed_totals": (sealed_totals, "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS newest FROM orders GROUP BY 1"),
}
