"""Extractive answers, contexts, summaries and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import formal, sentences, tokens

# ---- fixed values -------------------------------------------------------------
PROVENANCE = ("source:", "topic url:", "bulk feed generated:", "safety:", "数据集：", "hugging face 仓库：", "固定版本：", "原始文件：", "许可证标记：", "证据说明：", "安全说明：", "发布机构：", "发布日期：", "资料类别：", "官方原文：", "固定文件 sha-256：", "来源等级：")
QUANTITY, LISTED, CLASSES = "多少|几(?:种|类|项)?", "多少|几(?:种|类|项)?|哪(?:些|三类)", "哪三类|分为.*类|几类"
CONCEPTS = ("烹调油", "食盐")
UNITS, CLASSIFIED, CLASS = "(?i)[0-9]|[一二三四五六七八九十]+类|(?:mg|kg|g|ml|%)", "分类管理|分为[^。]{0,20}类", "第[一二三]类"
FOLLOW_UP = ("它", "这个", "那个", "那", "还有", "呢", "刚才", "前面", "为啥", "怎么", "咋", "有啥", "再")
MARKED = "(?s)## 数据集答案\\s*(.+?)(?=\n\\s*## |\\z)"
# -------------------------------------------------------------------------------


def candidates(evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """ANS1's scoring core: each sentence of the three first evidence rows with its score. Columns query_id, question, rank, text in."""
    cut = evidence.where("rank <= 3").select(query, "question", "rank", F.posexplode(sentences(F.col("text"), 8, "。！？；.!?;")).alias("position", "sentence"))
    plain = ~F.col("sentence").rlike("[?？]$")
    for prefix in PROVENANCE:
        plain = plain & ~F.lower("sentence").startswith(prefix)
    q = F.col("question")
    overlap = F.size(F.array_intersect(F.array_distinct(tokens(q)), F.array_distinct(tokens(F.col("sentence")))))
    counted = F.when(q.rlike(LISTED) & F.col("sentence").rlike(UNITS), 2).otherwise(0)
    classed = F.when(q.rlike(CLASSES), F.when(F.col("sentence").rlike(CLASSIFIED), 10).when(F.col("sentence").rlike(CLASS), 4).otherwise(0)).otherwise(0)
    return cut.where(plain).withColumn("score", overlap + counted + classed)


def extractive_answers(evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """ANS1: query, answer. A marked answer section of the first row wins; else the best sentences, with source numbers; else its first 240 characters."""
    first = evidence.where("rank = 1").select(query, "question", F.col("text").alias("first_text"))
    marked = F.regexp_replace(F.trim(F.regexp_extract("first_text", MARKED, 1)), r"\s+", " ")
    scored = candidates(evidence, query)
    same = Window.partitionBy(query, "sentence").orderBy(F.desc("score"), "rank", "position")
    order = Window.partitionBy(query).orderBy(F.desc("score"), "rank", "position")
    once = scored.withColumn("_s", F.row_number().over(same)).where("_s = 1").withColumn("place", F.row_number().over(order))
    top = once.where("place = 1").select(query, F.col("rank").alias("top_rank"), F.col("position").alias("top_position"))
    with_top = once.join(top, query)
    q = F.col("question")
    classes = q.rlike(CLASSES)
    near = (F.col("rank") == F.col("top_rank")) & (F.col("position") > F.col("top_position")) & (F.col("position") <= F.col("top_position") + 4) & F.col("sentence").rlike(CLASS)
    # two quantities asked for: the first numbered sentence of each; then the best others, up to the number wanted
    everywhere, by_place = Window.partitionBy(query), Window.partitionBy(query).orderBy("place")
    said = [F.min(F.when(F.col("sentence").contains(c) & F.col("sentence").rlike("[0-9]"), F.col("place"))).over(everywhere) for c in CONCEPTS]
    asked = [q.contains(c) for c in CONCEPTS]
    hit = [F.coalesce(asked[0] & asked[1] & (F.col("place") == x), F.lit(False)) for x in said]
    fixed = (F.col("place") == 1) | hit[0] | hit[1]
    wanted = F.greatest(F.when(q.rlike(QUANTITY), 1).otherwise(2), asked[0].cast("int") + asked[1].cast("int"))
    staged = with_top.withColumn("_fixed", fixed).withColumn("_n", F.sum(F.col("_fixed").cast("int")).over(everywhere)).withColumn("_other", F.sum((~F.col("_fixed")).cast("int")).over(by_place))
    turn = F.when(F.col("place") == 1, 0).when(classes, 1 + F.col("position") - F.col("top_position")).when(hit[0], 1).when(hit[1], 2).otherwise(2 + F.col("place"))
    staged = staged.withColumn("_turn", turn)
    chosen = staged.where((F.col("place") == 1) | (classes & near) | (~classes & (F.col("_fixed") | (F.col("_other") <= wanted - F.col("_n")))))
    joined = chosen.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_turn", "sentence", "rank"))).alias("a"))  # a few sentences
    text = F.array_join(F.transform("a", lambda x: F.concat(x["sentence"], F.lit(" [source:"), x["rank"], F.lit("]"))), " ")
    plain = F.concat(F.substring("first_text", 1, 240), F.lit(" [source:1]"))
    return first.join(joined, query, "left").select(query, F.when(marked != "", F.concat(F.substring(marked, 1, 800), F.lit(" [source:1]"))).otherwise(F.coalesce(text, plain)).alias("answer"))


def contexts(evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """ANS2, EV13: the numbered evidence of each question as one string, and its length. The rows of a question are few."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("source"), F.lit("\n"), F.col("text"))
    return evidence.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def answer_rows(answers: DataFrame, evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """ANS3, TK6: each answer with its citations, the three first evidence rows."""
    cited = evidence.where("rank <= 3").groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "source", "document_id"))).alias("citations"))
    return answers.join(cited, query, "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<rank:int,source:string,document_id:bigint>>")))


def map_summaries(docs: DataFrame, key: str = "doc_id", also: list[str] = ()) -> DataFrame:
    """SUM1, SUM4: the first three sentences, or 600 characters; 1,200 at most; a row without content is a failure row. ``also``: columns that stay."""
    s = docs.select(key, *also, "text", sentences(F.col("text")).alias("_s"))  # found once
    text = F.substring(F.when(F.size("_s") > 0, F.array_join(F.slice("_s", 1, 3), " ")).otherwise(F.substring(F.trim("text"), 1, 600)), 1, 1200)
    out = s.select(key, *also, text.alias("summary"))
    return out.select(key, *also, "summary", F.size(tokens(F.col("summary"))).alias("tokens"), F.when(F.coalesce(F.length("summary"), F.lit(0)) > 0, "succeeded").otherwise("failed").alias("status"))


LEAST_LINE = 17  # characters of the shortest line: its marks, one of the summary, one of the key, the newline


def reduce_summaries(maps: DataFrame, job: str, key: str = "doc_id", limit: int = 8000) -> DataFrame:
    """SUM2: lines of summaries in id order, cut at ``limit``: only rows whose line starts within it are gathered.

    No more than ``limit`` / ``LEAST_LINE`` lines can start there, so each task hands on as many of a job's first rows at most.
    """
    by_key = Window.partitionBy(job).orderBy(key)
    first = maps.where("summary <> ''").select(job, key, "summary").withColumn("_n", F.row_number().over(by_key)).where(F.col("_n") <= limit // LEAST_LINE + 1)
    line = F.concat(F.lit("- "), F.col("summary"), F.lit(" [document:"), F.col(key), F.lit("]"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.select(job, key, line.alias("line")).withColumn("start", before).where(F.col("start") < limit)
    return kept.groupBy(job).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "line"))), lambda x: x["line"]), "\n"), 1, limit).alias("summary"))


def missing_citations(summaries: DataFrame, members: DataFrame, job: str, key: str = "doc_id") -> DataFrame:
    """SUM3: members whose citation a summary lacks."""
    return members.join(summaries, job).where(~F.col("summary").contains(F.concat(F.lit("[document:"), F.col(key), F.lit("]")))).select(job, key)


def contextualised(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", depth: int = 6) -> DataFrame:
    """CNV3, WN5: each user turn in formal words; a follow-up gets the anchor before it, the first of the last six user turns."""
    w = Window.partitionBy(conversation).orderBy(turn)
    users = turns.where("role = 'user'").withColumn("anchor", F.first(text).over(w.rowsBetween(-depth, -1)))
    clean = formal(F.col(text))
    follows = F.length(clean) <= 18
    for mark in FOLLOW_UP:
        follows = follows | clean.contains(mark)
    joined = F.concat(F.regexp_replace(formal(F.col("anchor")), "\n", " "), F.lit("；"), clean)
    return users.select(conversation, turn, F.when(F.col("anchor").isNotNull() & follows, joined).otherwise(clean).alias("contextualised"), (F.col("anchor").isNotNull() & follows).alias("changed"))


def conversation_list(conversations: DataFrame, messages: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """CNV1: with message counts, the latest first."""
    counts = messages.groupBy(key).agg(F.count("*").alias("messages"), F.max("created_at").alias("updated_at"))
    return conversations.join(counts, key, "left").fillna(0, ["messages"]).orderBy(F.desc("updated_at"), key).limit(limit)


def append_message(messages: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """CNV4: the message table with the new rows, and each conversation's time of update."""
    both = messages.unionByName(new)
    return both, both.groupBy(key).agg(F.max("created_at").alias("updated_at"), F.count("*").alias("messages"))


def titled(column: Column) -> Column:
    return F.substring(F.regexp_replace(column, "\n", " "), 1, 36)
