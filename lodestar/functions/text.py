"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -------------------------------------------------------------
CJK = "一-鿿"
WORD = "[a-z0-9_+\\-]+"
PII = (
    (r"(?U)\b1[3-9]\d{9}\b", "[REDACTED_PHONE]"),
    (r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?U)\b\d{17}[\dXx]\b", "[REDACTED_ID]"),
    (r"(?iuU)\b(?:patient|患者)[-_ ]?(?:id|编号)?[:： ]*[A-Za-z0-9-]{4,}\b", "[REDACTED_PATIENT_ID]"),
    (r"(?iU)(bearer\s+)[A-Za-z0-9._-]+", "$1[REDACTED_TOKEN]"),
)
INJECTION = (
    r"ignore (all |the )?(previous|system) instructions",
    r"忽略(之前|以上|系统)(的)?指令",
    r"(reveal|leak|print).{0,20}(secret|prompt|all documents)",
    r"(泄露|输出).{0,20}(全部文档|系统提示|密钥)",
    r"(run_shell|delete_database|send_email)\s*\(",
)
ENGLISH_FILLER = r"\b(?:what is|how should|which controlled action|please|operators?|the required response|for this issue|resolves? this issue)\b"
CHINESE_FILLER = "(?:请用运行手册说明|应该如何处置|第一项受控操作是什么|为什么不能|遇到)"
QUERY_MARKS = "[?？:：,，;；]"
HYDE_CUES = ("why", "how", "explain", "为什么", "如何", "说明")
COLLOQUIAL = (
    ("血脂高", "高脂血症"),
    ("小孩", "儿童"),
    ("长得慢", "生长迟缓"),
    ("啥时候", "什么情况下"),
    ("啥", "什么"),
    ("一天", "每日"),
    ("油和盐", "烹调油和食盐"),
    ("吃多少", "控制在多少"),
    ("撸多少", "摄入多少"),
    ("瞧", "检查"),
    ("老是", "经常"),
    ("重新分一个", "分配新的标识"),
    ("得分配", "需要分配"),
)
VISUAL_TERMS = ("图片", "图像", "截图", "图标", "颜色", "形状", "示意图", "流程图", "拓扑图", "曲线", "柱状图", "饼图", "看起来", "image", "picture", "screenshot", "icon", "color", "shape", "diagram", "chart", "graph", "visual")
CITATION = r"\s*[\[【](?:\d+:\d+|source:\d+|evidence:\d+|visual:\d+|image:\d+|来源\d+|图像\d+)[\]】]"
TERMINATORS = "。！？.!?"
# -------------------------------------------------------------------------------

def strip(text: Column) -> Column:
    """Without white space, Unicode's too, on both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def tokens(text: Column) -> Column:
    """FN1: words in lower case, then of each CJK run its characters and its bigrams; repeats stay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), 0)
    pieces = lambda run, n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(run)), lambda i: F.substring(run, i, F.lit(n)))
    return F.concat(F.regexp_extract_all(low, F.lit(WORD), 0), F.flatten(F.transform(runs, lambda r: F.concat(pieces(r, 1), pieces(r, 2)))))


def normalise(text: Column) -> Column:
    """FN2: line ends to LF, runs of blanks and tabs to one blank, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "[ \t]+", " "))


def lookup_terms(text: Column, limit: int = 48) -> Column:
    """FN6: trigrams of CJK runs and words of three or more letters, different ones in order, the first ``limit``."""
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]{{3,}}"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_+\\-]{3,}"), 0), lambda w: F.lower(w))
    return F.slice(F.array_distinct(F.concat(grams, words)), 1, limit)


def redact_pii(text: Column) -> Column:
    """FN7: five patterns, in order."""
    for pattern, to in PII:
        text = F.regexp_replace(text, pattern, to)
    return text


def has_injection(text: Column) -> Column:
    """FN8: whether any of five signs of embedded instructions occurs."""
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in INJECTION)), F.lit(False))


def strip_citations(text: Column) -> Column:
    """FN9: without inline citation marks, no blank before punctuation, single blanks."""
    out = F.regexp_replace(text, "(?iu)" + CITATION, "")
    out = F.regexp_replace(out, "[ \t]+([，。！？；：,.!?;:])", "$1")
    return strip(F.regexp_replace(out, "[ \t]{2,}", " "))


def rewrite_query(query: Column) -> Column:
    """FN10: filler words and marks to blanks; the query itself if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(query, "(?iuU)" + ENGLISH_FILLER, " "), CHINESE_FILLER, " ")
    out = strip(F.regexp_replace(F.regexp_replace(out, QUERY_MARKS, " "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), query)


def hypothetical_document(query: Column) -> Column:
    """FN11: a template passage about the query, at most 1,800 characters."""
    focus = rewrite_query(query)
    chinese = F.concat(F.lit("医院信息系统运维运行手册。故障现象："), focus, F.lit("。处置步骤包括核对告警与日志、确认根因、执行受控变更、验证恢复结果并保留回滚路径。"))
    other = F.concat(
        F.lit("Healthcare or medical-device knowledge document. Incident symptom and required response: "),
        focus,
        F.lit(". Verify alerts and logs, confirm the root cause, perform the controlled remediation, validate recovery, and retain a rollback path."),
    )
    return F.substring(F.when(focus.rlike(f"[{CJK}]"), chinese).otherwise(other), 1, 1800)


def wants_hyde(query: Column) -> Column:
    """FN12: eight or more tokens and a cue word."""
    low = F.lower(query)
    cue = F.lit(False)
    for word in HYDE_CUES:
        cue = cue | low.contains(word)
    return (F.size(tokens(query)) >= 8) & cue


def visual_intent(query: Column, requested: Column) -> Column:
    """FN13: 'text' or 'visual'; an explicit request wins."""
    low, found = F.lower(query), F.lit(False)
    for word in VISUAL_TERMS:
        found = found | low.contains(word)
    return F.when(requested.isin("text", "visual"), requested).otherwise(F.when(found, "visual").otherwise("text"))


def formal(text: Column) -> Column:
    """FN14: thirteen colloquial phrases replaced, in order."""
    text = strip(text)
    for old, new in COLLOQUIAL:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """SRC10: compatibility-composed; no built-in function does it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_folded(text: pd.Series) -> pd.Series:
    """NFKC and full case folding."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def question_key(text: Column) -> Column:
    """FN15: a question's word and CJK characters, folded."""
    return F.regexp_replace(nfkc_folded(text), f"[^\\w{CJK}]+", "")


def answer_key(text: Column, unit: str = "克") -> Column:
    """FN16: without punctuation, the unit word as g, in lower case."""
    return F.lower(F.replace(F.regexp_replace(text, r"[\s，。；：、,.;:!?！？（）()]+", ""), F.lit(unit), F.lit("g")))


def answer_matches(answer: Column, expected: Column) -> Column:
    """FN17: the expected key is contained, or all of its two or more listed terms are."""
    a = answer_key(answer)
    terms = F.filter(F.split(expected, "[、，,;；]"), lambda t: F.length(F.trim(t)) > 0)
    return a.contains(answer_key(expected)) | ((F.size(terms) >= 2) & F.forall(terms, lambda t: a.contains(answer_key(t))))


def sentences(text: Column, least: int = 8, terminators: str = TERMINATORS) -> Column:
    """FN18: cut after terminators and at newlines, trimmed of marks, those of ``least`` characters and more."""
    cut = F.split(text, f"(?<=[{terminators}])\\s*|\n+")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, "^[ #\\-\t]+|[ #\\-\t]+$", "")), lambda s: F.length(s) >= least)


def ends_sentence(text: Column) -> Column:
    """FN19: whether the last character is a semantic boundary."""
    return F.regexp_replace(text, r"\s+$", "").rlike("[。！？；.!?;]$")


def digest(value: Column) -> Column:
    """FN20: sha256 in hex."""
    return F.sha2(value, 256)


def auto_title(title: Column, first_message: Column, default: str, limit: int = 36) -> Column:
    """FN22: the first message as a title, if the title is still the default."""
    return F.when(title == default, F.substring(F.regexp_replace(first_message, "\n", " "), 1, limit)).otherwise(title)


def progress(done: Column, total: Column) -> Column:
    """FN23: 10 + 70 * done / total, half-even, within 5 to 95."""
    return F.greatest(F.lit(5), F.least(F.lit(95), 10 + F.bround(70.0 * done / F.greatest(total, F.lit(1))))).cast("int")


def age_seconds(since: Column, as_of: Column) -> Column:
    """FN25: seconds between two times, 0 at least."""
    return F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(since))


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """FN27: a map literal's value, or the default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))
