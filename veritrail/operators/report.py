"""Support reports in Markdown, as numbered lines per claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import SUPPORT_THRESHOLD, py_round
from ..functions.text import strip, text_or_empty, unnest
from .keys import running_number
from .logs import utc_stamp
from .support import evidence_of

# Headings and phrases of the report.
_TITLE, _CLAIM, _SUMMARY, _DETAIL = "# 支撑度评估报告 — ", "## 论断", "## 判定汇总", "## 逐篇判定"
_COLUMNS = "| # | 论文 | 年份 | 证据级别 | 分数 | 级别 | 结论 |\n|---|------|------|----------|------|------|------|"
_VERDICT = {"CONTRADICTORY": "⚠️ 矛盾（永不引用）", "INSUFFICIENT_EVIDENCE": "❌ 证据不足",
            "passed": "✅ 可引用", "rejected": "❌ 低于阈值"}
_CONCLUSION = {
    "CONTRADICTORY": "- **结论**: ⚠️ **矛盾证据——永不引用**（即使分数被高估也由硬门禁排除）",
    "INSUFFICIENT_EVIDENCE": "- **结论**: ❌ 证据不足——不引用；如需支撑请补充证据或弱化论断（需授权）",
}
_CONTRA_LIST, _THIN_LIST, _NOTES = "## 矛盾证据清单（永不引用）", "## 证据不足清单", "## 备注"
# Sections of a report, in order.
_ROWS, _DETAILS, _CONTRA, _THIN, _CAPPED = range(5)
_CAP_NOTE = "- METADATA_ONLY 上限 0.74 已应用（级别随分数重推）:"


def report_buckets(scored: DataFrame, threshold: float = SUPPORT_THRESHOLD, key: str = "claim_id") -> DataFrame:
    """Counts of passed, rejected, contradictory and insufficient papers per claim."""
    b = bucket(threshold)
    return scored.groupBy(key).agg(*[F.count_if(b == name).alias(alias) for name, alias in (
        ("passed", "passed"), ("rejected", "rejected"), ("CONTRADICTORY", "contradictory"),
        ("INSUFFICIENT_EVIDENCE", "insufficient"))])


def bucket(threshold: float) -> Column:
    level = F.col("support_level")
    return (F.when(level.isin("CONTRADICTORY", "INSUFFICIENT_EVIDENCE"), level)
            .when(F.coalesce("support_score", F.lit(0.0)) >= threshold, F.lit("passed")).otherwise(F.lit("rejected")))


def _or(value: Column | str, other: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(other))


def _paper_parts(scored: DataFrame, threshold: float, order: str) -> DataFrame:
    """Per paper the texts it adds to the report, by section number."""
    limit = f"{threshold:.2f}"
    numbered = running_number(scored, "_i", [order], ["claim_id"])
    score = F.format_string("%.2f", py_round(F.coalesce("support_score", F.lit(0.0)), 2))
    year = _or(F.nullif("year", F.lit(0)), "?")
    level, kind = text_or_empty(F.col("support_level")), bucket(threshold)
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in _VERDICT.items() for x in kv]), kind)
    proof = strip(evidence_of())
    number = F.col("_i").cast("string")
    row = F.concat(F.lit("| "), number, F.lit(" | "), F.substring(text_or_empty(F.col("title")), 1, 60), F.lit(" | "), year,
                   F.lit(" | "), _or("evidence_level", "?"), F.lit(" | "), score, F.lit(" | "), level, F.lit(" | "), verdict, F.lit(" |"))
    conclusion = (F.when(kind == "CONTRADICTORY", F.lit(_CONCLUSION["CONTRADICTORY"]))
                  .when(kind == "INSUFFICIENT_EVIDENCE", F.lit(_CONCLUSION["INSUFFICIENT_EVIDENCE"]))
                  .when(kind == "passed", F.lit(f"- **结论**: ✅ 可引用（≥{limit}）"))
                  .otherwise(F.lit(f"- **结论**: ❌ 低于阈值 {limit}——不引用")))
    authors = F.array_join(F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 5), ", ")
    noted = lambda column, label: F.when(_or(column, "") != "", F.concat(
        F.lit(f"（{label}: "), F.col(column), F.lit("）"))).otherwise(F.lit(""))
    detail = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), number, F.lit(". "), _or("title", "(untitled)"), F.lit("（"), year, F.lit("）")), F.lit(""),
        F.concat(F.lit("- **元数据**: "), authors, F.lit(" · "), _or("venue", "?"), F.lit(" · DOI: "), _or("doi", "—")),
        F.concat(F.lit("- **证据级别**: "), _or("evidence_level", "?"), noted("evidence_source", "来源")),
        F.when(proof != "", F.concat(F.lit("- **证据摘录**（真实获取原文，前 300 字）:\n\n  > "), F.substring(proof, 1, 300), F.lit("\n"))),
        F.concat(F.lit("- **判定**: **"), score, F.lit(" "), level, F.lit("**"), noted("scoring_method", "评分引擎")),
        F.concat(F.lit("- **理由**: "), _or("support_reasoning", "—")), conclusion, F.lit(""))
    name = F.concat(F.lit("- **"), _or("title", "None"), F.lit("**（"), _or(F.col("year"), "None"), F.lit("）: "))
    parts = {
        _ROWS: row,
        _DETAILS: detail,
        _CONTRA: F.when(kind == "CONTRADICTORY", F.concat(
            name, F.lit("证据称 “"), F.substring(text_or_empty(F.col("evidence_text")), 1, 120), F.lit("…”"))),
        _THIN: F.when(kind == "INSUFFICIENT_EVIDENCE", F.concat(name, F.lit("无可用证据文本"))),
        _CAPPED: F.when((F.col("evidence_level") == "METADATA_ONLY") & F.contains("support_reasoning", F.lit("capped")),
                        F.concat(F.lit("  - "), _or("title", "None"), F.lit(" → "), score, F.lit(" "), level)),
    }
    made = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("text")) for k, v in parts.items()])
    return unnest(numbered, F.filter(made, lambda e: e["text"].isNotNull()), "claim_id", F.col("_i").alias("position"),
                  value="e").select("claim_id", "e.section", "position", "e.text")


def _claim_parts(scored: DataFrame, threshold: float, high_rigor: bool, at: Column | None) -> DataFrame:
    """Per claim the headings and counts around the papers' texts."""
    limit = f"{threshold:.2f}"
    b = bucket(threshold)
    capped = (F.col("evidence_level") == "METADATA_ONLY") & F.contains("support_reasoning", F.lit("capped"))
    claims = scored.groupBy("claim_id").agg(
        F.min("claim_text").alias("claim"), F.count_if(capped).alias("capped"),
        *[F.count_if(b == k).alias(k) for k in _VERDICT])
    lines = lambda *parts: F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = lambda k: F.col(k).cast("string")
    made = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("position"), text.alias("text"))
                     for section, text in (
        (_ROWS, lines(F.concat(F.lit(_TITLE), _or("claim_id", "claim")), "", _CLAIM, "", F.concat(F.lit("> "), "claim"), "",
                      F.concat(F.lit("- 评估时间: "), utc_stamp(at)), f"- 硬阈值: {limit}" + ("（High Rigor）" if high_rigor else ""),
                      "", _SUMMARY, "", _COLUMNS)),
        (_DETAILS, lines("", F.concat(F.lit(f"- 通过（≥{limit}）: **"), n("passed"), F.lit("** 篇")),
                         F.concat(F.lit("- 拒绝: "), n("rejected"), F.lit(" 篇（低于阈值）")),
                         F.concat(F.lit("- 矛盾证据: **"), n("CONTRADICTORY"), F.lit("** 篇（显式标注，永不引用）")),
                         F.concat(F.lit("- 证据不足: "), n("INSUFFICIENT_EVIDENCE"), F.lit(" 篇")), "", _DETAIL, "")),
        (_CONTRA, F.when(F.col("CONTRADICTORY") > 0, F.lit(f"{_CONTRA_LIST}\n"))),
        (_THIN, F.when(F.col("INSUFFICIENT_EVIDENCE") > 0, F.concat(
            F.when(F.col("CONTRADICTORY") > 0, F.lit("\n")).otherwise(F.lit("")), F.lit(f"{_THIN_LIST}\n")))),
        (_CAPPED, F.when(F.col("capped") > 0, F.concat(
            F.when(F.col("CONTRADICTORY") + F.col("INSUFFICIENT_EVIDENCE") > 0, F.lit("\n")).otherwise(F.lit("")),
            F.lit(f"{_NOTES}\n\n{_CAP_NOTE}")))))])
    return unnest(claims, F.filter(made, lambda e: e["text"].isNotNull()), "claim_id", value="e").select(
        "claim_id", "e.section", "e.position", "e.text")


def support_report_lines(scored: DataFrame, threshold: float = SUPPORT_THRESHOLD, high_rigor: bool = False,
                         order: str = "ord", at: Column | None = None) -> DataFrame:
    """(claim_id, section, position, text): joined in this order by line feeds,
    the texts of a claim are its report. They stay rows, so a claim with very
    many papers is never gathered into one value."""
    return _claim_parts(scored, threshold, high_rigor, at).unionByName(_paper_parts(scored, threshold, order))


def write_reports(lines: DataFrame, path: str) -> None:
    """One folder of text per claim; its files in name order are the report."""
    (lines.repartitionByRange("claim_id", "section", "position").sortWithinPartitions("claim_id", "section", "position")
     .select("claim_id", "text").write.mode("overwrite").partitionBy("claim_id").text(path))
