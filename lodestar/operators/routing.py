"""Query features, the rule-based route, query expansion and request defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hypothetical_document, rewrite_query, strip, tokens, wants_hyde

# ---- fixed values -------------------------------------------------------------
QUOTED = "[\"'“”‘’《》](.{2,80}?)[\"'“”‘’《》]"
IDENTIFIER = r"(?<![A-Za-z0-9])(?:[A-Z]{2,}(?:[-_/.][A-Z0-9]+)*|[A-Z][A-Z0-9]*[-_/][A-Z0-9][A-Z0-9._/-]*|\d{3,}(?:[-_/.]\d+)+|(?:GB|WS|YY|ISO|IEC|RFC)\s*\d{2,})(?![A-Za-z0-9])"
MULTI_PART = r"以及|并且|同时|分别|对比|比较|与.+?的|and|versus|vs\.?|compare"
SEMANTIC = ("为什么", "原因", "如何", "怎样", "说明", "解释", "含义", "区别", "相似", "机制", "影响", "why", "how", "explain", "meaning", "difference", "similar", "mechanism", "impact", "what is the required response")
LONG_CONTEXT = ("全文", "完整流程", "完整步骤", "所有步骤", "前后文", "上下文", "跨章节", "多个章节", "综合文档", "结合文档", "从前提到", "先决条件", "后续验证", "全篇", "entire document", "full procedure", "all steps", "across sections", "multiple sections", "prerequisite", "subsequent verification", "broader context")
SEMANTIC_LIMIT, PARENT_LIMIT = 1.25, 2.0
# -------------------------------------------------------------------------------


def _cues(text: Column, cues: tuple[str, ...]) -> Column:
    found = F.lit(0)
    for cue in cues:
        found = found + text.contains(cue).cast("int")
    return found


def query_features(queries: DataFrame, text: str = "question", identifiers: bool = True) -> DataFrame:
    """RET12: adds chars, tokens, identifiers, quoted, semantic_cues, long_cues, multi_part; a blank question is an error. ``identifiers`` off: their number is 0."""
    q = F.col(text)
    low = F.replace(F.lower(strip(q)), F.lit("ß"), F.lit("ss"))  # as case folding has it
    ok = F.when(F.length(low) == 0, F.raise_error(F.lit("a query must not be empty"))).otherwise(low)
    staged = queries.withColumn("_low", ok)
    low = F.col("_low")
    return staged.withColumns({
        "chars": F.length(low), "tokens": F.size(tokens(low)), "identifiers": F.size(F.regexp_extract_all(q, F.lit(IDENTIFIER), 0)) if identifiers else F.lit(0), "quoted": F.size(F.regexp_extract_all(q, F.lit(QUOTED), 0)),
        "semantic_cues": _cues(low, SEMANTIC), "long_cues": _cues(low, LONG_CONTEXT), "multi_part": low.rlike(f"(?iu){MULTI_PART}"),
    }).drop("_low")


def route(features: DataFrame, dense_available: bool, parent_child_available: bool = True) -> DataFrame:
    """RET13: adds strategy, reason_code, confidence and the three scores to RET12's columns."""
    c = F.col
    yes = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    exact = 2.0 * c("identifiers") + 1.5 * c("quoted") + yes(c("tokens") <= 8)
    semantic = 1.25 * c("semantic_cues") + yes(c("multi_part")) + 0.75 * yes(c("tokens") >= 12) - F.least(F.lit(1.0), 0.5 * c("identifiers"))
    parent = 2.0 * c("long_cues") + 0.75 * yes(c("multi_part")) + 0.5 * yes(c("tokens") >= 20)
    scored = features.withColumns({"exact_score": exact, "semantic_score": semantic, "parent_score": parent})
    to_parent = F.lit(parent_child_available) & (c("parent_score") >= PARENT_LIMIT)
    meant = c("semantic_score") >= SEMANTIC_LIMIT
    to_rrf = F.lit(dense_available) & meant
    pick = lambda a, b, fallback, exact_, default: F.when(to_parent, a).when(to_rrf, b).when(meant, fallback).when(c("exact_score") > 0, exact_).otherwise(default)
    lit = F.lit
    return scored.withColumns({
        "strategy": pick(lit("parent_child"), lit("rrf"), lit("bm25"), lit("bm25"), lit("bm25")),
        "reason_code": pick(lit("broad_context_required"), lit("semantic_or_multi_concept_query"), lit("dense_unavailable_bm25_fallback"), lit("exact_or_identifier_lookup"), lit("lexical_default")),
        "confidence": F.round(pick(F.least(lit(0.98), 0.78 + 0.04 * (c("parent_score") - PARENT_LIMIT)), F.least(lit(0.96), 0.72 + 0.04 * (c("semantic_score") - SEMANTIC_LIMIT)), lit(0.6), F.least(lit(0.97), 0.76 + 0.03 * c("exact_score")), lit(0.62)), 3),
        **{k: F.round(F.greatest(lit(0.0), c(k)), 3) for k in ("exact_score", "semantic_score", "parent_score")},
    })


def expand(queries: DataFrame, text: str = "question", requested: str = "query_transform", auto_hyde: bool = True) -> DataFrame:
    """RET10: one row for each different variant: variant (0, 1), variant_text; ``resolved`` names the transform."""
    q, want = F.col(text), F.col(requested)
    resolved = F.when(want == "auto", F.when(F.lit(auto_hyde) & wants_hyde(q), "hyde").otherwise("none")).otherwise(want)
    new = rewrite_query(q)
    variants = F.when(F.col("resolved") == "rewrite", F.array(new)).when(F.col("resolved") == "multi_query", F.array_distinct(F.array(q, new))).when(F.col("resolved") == "hyde", F.array(hypothetical_document(q))).otherwise(F.array(q))
    return queries.withColumn("resolved", resolved).select("*", F.posexplode(variants).alias("variant", "variant_text"))


def request_defaults(queries: DataFrame, defaults: dict[str, object], role: str = "role", admin: str = "admin") -> DataFrame:
    """RET19: who is not an administrator gets the default parameters."""
    return queries.withColumns({k: F.when(F.col(role) == admin, F.col(k)).otherwise(F.lit(v)) for k, v in defaults.items()})
