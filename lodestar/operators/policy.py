"""Gates on evidence and the decision of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_injection
from .fusion import margin

# ---- fixed values -------------------------------------------------------------
SCORE, LEXICAL, DENSE, IMAGE, MARGIN = 0.20, 0.28, 0.40, 0.28, 0.002
MEDICAL_ADVICE = "诊断|确诊|吃什么药|开.{0,6}药|推荐.{0,6}药|给我.{0,6}药|用药|剂量|治疗方案|处方|diagnos|dosage|treatment"
DOMAIN = (
    "医|病|症|药|血|菌|病毒|感染|炎|癌|瘤|疼|痛|压疮|检查|手术|预防|护理|康复|器械|患者|心脏?|肺|肝|肾|脑|胃|肠|骨|皮肤|眼|牙|孕|新生儿|营养|体重|饮食|过敏|免疫|遗传|并发症|副作用|不良反应|临床|健康|生理|体征|呼吸|脉搏|卫生|"
    "消毒|灭菌|洗手|A1C|medical|medicine|disease|symptom|drug|blood|infection|asthma|diabetes|arthritis|diagnos|treatment|surgery|prevention|patient|clinical|儿童|生长|蛋白|device|oximeter|infusion|UDI|PACS|DICOM|HIS|EMR|LIS|HL7|SSO|Redis|Kafka|NTP|"
    "影像|挂号|电子签名|信息系统|故障|运维|告警|日志|知识助手|backup|VPN|gateway|archive|queue"
)
# -------------------------------------------------------------------------------


def text_confident(top: DataFrame) -> Column:
    """POL1: over a question's first evidence row: score, then the floor of its strategy."""
    lexical, dense = F.col("keyword_score") >= LEXICAL, F.col("vector_score") >= DENSE
    floor = F.when(F.col("strategy").isin("keyword", "bm25", "parent_child"), lexical).when(F.col("strategy") == "vector", dense).otherwise(lexical | dense)
    return (F.col("score") >= SCORE) & floor


def visual_confident(evidence: DataFrame, query: list[str]) -> DataFrame:
    """POL2: of each query whether its first image is similar enough and leads by enough. Columns rank, image_similarity."""
    led = evidence.withColumn("lead", margin("image_similarity", query)).where("rank = 1")
    return led.select(*query, F.coalesce((F.col("image_similarity") >= IMAGE) & (F.col("lead") >= MARGIN), F.lit(False)).alias("visual_confident"))


def quarantine(evidence: DataFrame, query: list[str], text: str = "text") -> DataFrame:
    """POL3: evidence without signs of injection, ranked anew."""
    w = Window.partitionBy(*query).orderBy("rank")
    return evidence.where(~has_injection(F.col(text))).withColumn("rank", F.row_number().over(w))


def asks_for_advice(question: Column, profile: Column) -> Column:
    """POL4."""
    return (profile == "medical") & question.rlike(f"(?iu){MEDICAL_ADVICE}")


def in_domain(question: Column, profile: Column) -> Column:
    """POL4."""
    return (profile == "enterprise") | question.rlike(f"(?iu){DOMAIN}")


def decide(questions: DataFrame) -> DataFrame:
    """POL5: adds ``decision``. Columns: question, policy_profile, resolved_profile, requested_profile, n_evidence, n_safe, text_confident, n_images, n_safe_images, visual_confident, n_payloads."""
    c = F.col
    visual = (c("resolved_profile") == "visual") | ((c("requested_profile") == "auto") & ~c("text_confident") & c("visual_confident"))
    accepted = F.when(visual, c("visual_confident")).otherwise(c("text_confident"))
    unsafe = ((c("n_evidence") > 0) & (c("n_safe") == 0)) | ((c("n_images") > 0) & (c("n_safe_images") == 0))
    return questions.withColumn(
        "decision",
        F.when(asks_for_advice(c("question"), c("policy_profile")), "medical_advice_denied")
        .when((c("resolved_profile") == "text") & ~in_domain(c("question"), c("policy_profile")), "insufficient_evidence")
        .when(~accepted & unsafe, "unsafe_evidence")
        .when(~accepted & visual, "insufficient_visual_evidence")
        .when(~accepted, "insufficient_evidence")
        .when(visual & (c("n_payloads") == 0), "visual_payload_unavailable")
        .otherwise("answer"),
    )


def payload_budget(images: DataFrame, query: list[str], size: str, limit: int = 3, most: int = 6_000_000) -> DataFrame:
    """POL6: ids of the first images that fit the budget; one that does not fit is passed over, later smaller ones may fit."""
    n = max(0, min(limit, 5))
    first = images.where(F.col("rank") <= n).groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("rank", "image_id", F.col(size).cast("long").alias("size")))).alias("a"))  # at most 5 a query
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))
    step = lambda s, x: F.when(s["used"] + x["size"] <= most, F.struct((s["used"] + x["size"]).alias("used"), F.concat(s["ids"], F.array(x["image_id"].cast("long"))).alias("ids"))).otherwise(s)
    return first.select(*query, F.aggregate("a", start, step).alias("s")).select(*query, F.col("s.ids").alias("image_ids"), F.col("s.used").alias("bytes"))


def grounded(answers: DataFrame) -> DataFrame:
    """POL7: an answer without citations abstains."""
    bare = ~F.col("abstained") & (F.size("citations") == 0)
    return answers.withColumn("reason", F.when(bare, "no_citation").otherwise(F.col("reason"))).withColumn("abstained", F.col("abstained") | bare)
