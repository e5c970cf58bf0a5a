"""Evaluation questions from YAML-shaped data, and which variant of question and answer each mode takes."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import flat_map

QUESTION = "id string, question string, revised_question string, ticker string, ground_truth string, original_ground_truth string, issue_type string"
# Issue types whose correction a mode takes.
CORRECTED = {
    "original": (),
    "updated": ("outdated", "added_precision"),
    "standard": ("outdated", "incorrect_answer", "structurally_invalid"),
}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of YAML files with a ``questions`` list, one file a row and each parsed in its task; or of JSON lines, natively."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(QUESTION).json(path)
    if importlib.util.find_spec("yaml") is None:
        raise RuntimeError("reading YAML needs the yaml package")
    names = [x.split()[0] for x in QUESTION.split(", ")]

    def parse(row: dict) -> list[dict]:
        import yaml

        return [{n: None if q.get(n) is None else str(q[n]) for n in names} for q in yaml.safe_load(row["value"])["questions"]]

    return flat_map(spark.read.text(path, wholetext=True).select("value"), parse, QUESTION)


def select_mode(questions: DataFrame, mode: str = "standard") -> DataFrame:
    """Replace question and ground_truth by the mode's variant."""
    issue = F.coalesce("issue_type", F.lit("none"))
    revised = F.coalesce("revised_question", "question")
    if mode == "strict":
        asked, truth = revised, F.col("ground_truth")
    else:
        asked = F.when(issue == "structurally_invalid", revised).otherwise(F.col("question")) if mode == "standard" else F.col("question")
        fixed = issue.isin(*CORRECTED[mode]) if CORRECTED[mode] else F.lit(False)
        truth = F.when(fixed, F.col("ground_truth")).otherwise(F.coalesce("original_ground_truth", "ground_truth"))
    return questions.withColumn("question", asked).withColumn("ground_truth", truth)


def tickers(questions: DataFrame) -> DataFrame:
    """Distinct tickers of comma-separated lists, trimmed and upper-cased."""
    each = questions.select(F.explode(F.split("ticker", ",")).alias("ticker"))
    return each.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()


def write_report(results: DataFrame, path: str) -> str:
    """Write results as JSON; returns a short markdown summary of the totals."""
    results.write.mode("overwrite").json(path)
    r = results.agg(F.count("*"), F.sum(F.col("correct").cast("int")), F.avg("cost_usd"), F.avg("execution_time_seconds"), F.avg("num_iter")).first()
    n = r[0] or 1
    return f"| questions | correct | accuracy | avg cost | avg time | avg iterations |\n|---|---|---|---|---|---|\n| {r[0]} | {r[1] or 0} | {100 * (r[1] or 0) / n:.1f} % | ${r[2] or 0:.4f} | {r[3] or 0:.2f} s | {r[4] or 0:.1f} |"
