"""What surrounds an answer: ownership, pending work, budgets, replies of models, documents and their life, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import ranked


def may_open(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (session, key, admin) with allowed: administrators, and the owner; a session without owner opens to administrators only."""
    owned = requests.join(sessions.select("session", "owner"), "session", "left")
    return owned.withColumn("allowed", F.coalesce(F.col("admin"), F.lit(False)) | F.coalesce(F.col("owner") == F.col("key"), F.lit(False))).drop("owner")


def still_pending(operations: DataFrame, now: Column, ttl_seconds: int = 600) -> DataFrame:
    return operations.where(F.col("ts") >= now - F.make_interval(secs=F.lit(float(ttl_seconds))))


def remaining(total: float, elapsed: Column, cap: float, floor: float = 0.05) -> Column:
    """Seconds a step may still take: its cap within what is left of the whole, never under the floor."""
    return F.greatest(F.lit(floor), F.least(F.lit(cap), F.lit(total) - elapsed))


# Wording of the follow-up suggestions and refusals.
REPHRASE = ("能否换一种表述方式，例如更具体地描述您想了解的「", "」？")
OPEN_SOURCE = ("查看《", "》中的相关内容（展开来源全文）")
CHECK_KB = "确认问题所属的知识库（产品 / 服务 / 技术等）是否正确。"


def followups(question: Column, title: Column) -> Column:
    """Up to three suggestions: rephrase, open the first source, check the knowledge base if there are fewer than two."""
    asked = F.trim(F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), r"^[?？。.！!]+|[?？。.！!]+$", ""))
    ask = F.when(asked != "", F.concat(F.lit(REPHRASE[0]), F.substring(asked, 1, 20), F.lit(REPHRASE[1])))
    look = F.when(title.isNotNull(), F.concat(F.lit(OPEN_SOURCE[0]), title, F.lit(OPEN_SOURCE[1])))
    check = F.when(ask.isNull() | look.isNull(), F.lit(CHECK_KB))
    return F.slice(F.filter(F.array(ask, look, check), lambda x: x.isNotNull()), 1, 3)


def finding_lines(findings: Column, n: int = 3) -> Column:
    """The first findings, one a line."""
    return F.array_join(F.transform(F.slice(findings, 1, n), lambda x: F.concat(F.lit("· "), x)), "\n")


def latest_sources(versions: DataFrame) -> DataFrame:
    """Provisional and final sources (qid, chunk_id, rank, phase): the final list of a question replaces the provisional one."""
    last = versions.groupBy("qid").agg(F.max("phase").alias("phase"))
    return versions.join(last, ["qid", "phase"])


def to_embed(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 600) -> DataFrame:
    """Distinct (query, model) that no unexpired cache row (query, model, ts) holds: what the model is asked for."""
    fresh = cache.where(F.col("ts") > now - F.make_interval(secs=F.lit(float(ttl_seconds)))).select("query", "model").distinct()
    return requests.select("query", "model").distinct().join(fresh, ["query", "model"], "left_anti")


def remember(memories: DataFrame, fresh: DataFrame, cap: int, cut: int = 300) -> DataFrame:
    """Memories (user, id, ts, answer) with new ones added, answers cut, the newest ``cap`` of a user kept."""
    added = memories.unionByName(fresh.withColumn("answer", F.substring("answer", 1, cut)))
    return ranked(added, cap, F.desc("ts"), F.desc("id"), by=("user",), name="_n").drop("_n")


STATUS_FIELDS = ("status", "chunk_count", "error")


def patched(documents: DataFrame, patches: DataFrame, fields: tuple[str, ...] = STATUS_FIELDS) -> DataFrame:
    """Documents with the allowed fields of patches (doc_id, fields) that are given; other fields of a patch have no effect."""
    used = [c for c in fields if c in patches.columns and c in documents.columns]
    p = patches.select("doc_id", *[F.col(c).alias(f"_{c}") for c in used])
    joined = documents.join(p, "doc_id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in used else F.col(c) for c in documents.columns])


def deletable(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, code): 200 if an administrator or a key of the knowledge base may delete it, 403, 404, or 409 while it is processed."""
    joined = requests.join(documents.select("doc_id", "kb", "status"), "doc_id", "left")
    mine = F.col("admin") | (F.col("kbs").isNotNull() & F.array_contains("kbs", F.col("kb")))
    code = F.when(F.col("kb").isNull(), 404).when(~F.coalesce(mine, F.lit(False)), 403).when(F.col("status") == "processing", 409).otherwise(200)
    return joined.select("doc_id", code.cast("long").alias("code"))


def cascade(tables: list[DataFrame], gone: DataFrame) -> list[DataFrame]:
    """Each table without the rows of deleted documents."""
    return [t.join(gone, "doc_id", "left_anti") for t in tables]


def page(documents: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page of documents; sizes are held within 1 and 100."""
    size = max(1, min(size, 100))
    return documents.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def first_text(wanted: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(chunk_id, content) of wanted ids: the first table that has an id gives its text."""
    parts = [t.select("chunk_id", "content", F.lit(i).alias("_t")) for i, t in enumerate(tables)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min_by("content", "_t").alias("content"))


def completion(reply: Column) -> Column:
    """A chat reply (JSON): content, or the reasoning where the content is empty, tokens, and calls of tools."""
    usage = "usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>"
    call = "tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    r = F.from_json(reply, f"choices array<struct<message:struct<content:string,reasoning_content:string,{call.replace(' ', ':', 1)}>>>, {usage}")
    m = r["choices"][0]["message"]
    content = F.when(F.coalesce(m["content"], F.lit("")) != "", m["content"]).otherwise(F.coalesce(m["reasoning_content"], F.lit("")))
    calls = F.transform(F.coalesce(m["tool_calls"], F.array()), lambda c: F.struct(F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["function"]["name"], F.lit("")).alias("name"), F.coalesce(c["function"]["arguments"], F.lit("{}")).alias("arguments")))
    return F.struct(content.alias("content"), F.coalesce(r["usage"]["total_tokens"], F.lit(0)).alias("total_tokens"), calls.alias("calls"))


def skill_of(reply: Column, skills: list[str]) -> Column:
    """The skill a model names: its JSON object, else the first known skill that its text holds."""
    found = F.regexp_extract(reply, r'\{"skill"\s*:\s*"([^"]+)"\}', 1)
    parsed = F.get_json_object(reply, "$.skill")
    out = F.lit(None).cast("string")
    for skill in reversed(skills):
        out = F.when(F.lower(reply).contains(skill), skill).otherwise(out)
    return F.when(found != "", F.lower(F.trim(found))).when(parsed.isNotNull(), F.lower(F.trim(parsed))).otherwise(out)


def pdf_route(mean_chars: Column, garbled: Column) -> Column:
    """native, ocr (a garbled text layer) or scanned."""
    return F.when(mean_chars < 30, "scanned").when(garbled, "ocr").otherwise("native")


def ocr_dpi(width: Column, height: Column, dpi: int = 300, most: int = 25_000_000) -> Column:
    """The resolution, halved until the page has no more than ``most`` pixels or the resolution is 72 or less."""
    steps = [dpi]
    while steps[-1] > 72:
        steps.append(steps[-1] // 2)
    out = F.lit(steps[-1])
    for d in reversed(steps[:-1]):
        out = F.when((width * d / 72) * (height * d / 72) <= most, d).otherwise(out)
    return out


def rerank_on(enabled: Column, was_set: Column, auto: Column, gpu: Column) -> Column:
    """On if set so; off if set so; where nothing is set, on with a GPU if that is automatic."""
    return F.coalesce(enabled, F.lit(False)) | (F.coalesce(auto, F.lit(False)) & ~F.coalesce(was_set, F.lit(False)) & F.coalesce(gpu, F.lit(False)))


def half_open(states: DataFrame, now: Column, rest_seconds: int = 60) -> DataFrame:
    """Breaker rows (key, id, ts, ok, open) to each key's state at ``now``: closed, open, or half-open after the rest."""
    last = states.groupBy("key").agg(F.max_by("open", F.struct("ts", "id")).alias("open"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("failed"))
    rested = F.col("failed") <= now - F.make_interval(secs=F.lit(float(rest_seconds)))
    return last.select("key", F.when(~F.col("open"), "closed").when(rested, "half-open").otherwise("open").alias("state"))


def result_rows(answers: DataFrame) -> DataFrame:
    """(qid, meta, latency) JSON: one structure for sources, result and done events, all fields always there."""
    meta = F.struct(F.round("top", 4).alias("top1_score"), F.col("n").alias("result_count"), (F.size("kbs") > 0).alias("cross_kb"), F.col("kbs").alias("cross_kb_kbs"), F.col("level").alias("degradation_level"))
    return answers.select("qid", F.to_json(meta).alias("meta"))


def merged_question(question: Column, captions: Column, most: int = 2000) -> Column:
    """The question with what its images say, cut."""
    return F.substring(F.concat_ws("\n", question, F.array_join(F.filter(captions, lambda c: F.trim(c) != ""), "\n")), 1, most)


def triples(line: Column) -> Column:
    """subject, predicate, object of a context line: two words and the rest."""
    parts = F.split(F.trim(line), r"\s+", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("subject"), parts[1].alias("predicate"), parts[2].alias("object")))


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1))


def dig(payload: Column, *path: str) -> Column:
    """A metric by nested keys, or flat under the keys joined by underscores."""
    return F.coalesce(F.get_json_object(payload, "$." + ".".join(path)), F.get_json_object(payload, "$." + "_".join(path))).cast("double")


def model_first(model: DataFrame, rules: DataFrame, asked: DataFrame) -> DataFrame:
    """Relations of the model where it answered for a text (an empty answer counts), of the rules elsewhere."""
    return model.unionByName(rules.join(asked.select("chunk_id").distinct(), "chunk_id", "left_anti"))
