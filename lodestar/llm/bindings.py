"""The queries ``opN_<name>``: thin bindings of the operators to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import best_position, decontaminate, preferences, quality_rules, repair, revisits, secrets, toxicity
from .common import table
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import score_quality
from .substring_dedup import remove_repeats
from .topk import exact_topk


def op1_preferences(spark, sf_dir):
    return preferences.format_preferences(preferences.stale_replies(table(spark, sf_dir, "conversations")))


def op2_revisits(spark, sf_dir):
    found = revisits.resolve_revisits(revisits.captures_of(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "canonical_url", "ts", "outcome", "refers_to", headers.alias("headers"), F.md5("payload").alias("payload_md5"))


def op3_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark, sf_dir):
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.split_fold() == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=~held_out)
    scored = toxicity.score(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


def op9_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def op10_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op11_structure_repair(spark, sf_dir):
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark, sf_dir):
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op13_best_position(spark, sf_dir):
    return best_position.best_position_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_preferences, op2_revisits, op3_suffix_array_dedup, op4_exact_topk, op5_decontamination, op6_quality, op7_packing, op8_toxicity, op9_secrets, op10_minhash, op11_structure_repair, op12_quality_rules, op13_best_position)}
ORACLES: dict[str, str] = {"op1_preferences": preferences.SQL, "op2_revisits": revisits.SQL, "op5_decontamination": decontaminate.sql(), "op11_structure_repair": repair.sql(), "op13_best_position": best_position.SQL}
