"""Question-answering benchmarks in one shape: id, question, answer, contexts, kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, question string, answer string, contexts array<string>, kind string"

#: Two stand-in rows of each benchmark, for use without its files.
SAMPLES: dict[str, list[tuple]] = {
    "hotpotqa": [
        ("hotpotqa-1", "Which river flows through the city where the firm that built the old bridge was founded?", "the Elde", ["The old bridge was built by Marn and Sons.", "Marn and Sons was founded in Torvik.", "The Elde flows through Torvik."], "bridge"),
        ("hotpotqa-2", "Which of the two observatories is older, Halden or Voss?", "Halden", ["Halden observatory opened in 1874.", "Voss observatory opened in 1901."], "comparison"),
    ],
    "natural_questions": [
        ("natural_questions-1", "when was the first tram line of torvik opened", "1893", ["The first tram line of Torvik opened in 1893."], "short"),
        ("natural_questions-2", "who wrote the history of the elde valley", "Ida Marn", ["The history of the Elde valley was written by Ida Marn."], "short"),
    ],
    "triviaqa": [
        ("triviaqa-1", "What metal are the roofs of Halden covered with?", "copper", ["The roofs of Halden are covered with copper."], "trivia"),
        ("triviaqa-2", "How many islands lie in Lake Voss?", "seven", ["Seven islands lie in Lake Voss."], "trivia"),
    ],
}


def load_benchmark(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """The stand-in rows of a benchmark, or the published JSON file (an array or lines of objects) at `path`."""
    if name not in SAMPLES:
        raise ValueError(f"no benchmark named {name}; there are {sorted(SAMPLES)}")
    if path is None:
        return spark.createDataFrame(SAMPLES[name], SCHEMA)
    raw = spark.read.option("multiLine", True)
    if name == "hotpotqa":
        rows = raw.schema("_id string, question string, answer string, type string, context array<array<string>>").json(path)
        # A context is [title, [sentences]]; read as text, its second member is a JSON list.
        texts = F.transform("context", lambda c: F.array_join(F.from_json(F.get(c, F.lit(1)), "array<string>"), ""))
        return rows.select(F.col("_id").alias("id"), "question", "answer", texts.alias("contexts"), F.col("type").alias("kind"))
    if name == "natural_questions":
        rows = raw.schema("example_id string, question_text string, short_answer string, long_answer string").json(path)
        return rows.select(F.col("example_id").alias("id"), F.col("question_text").alias("question"), F.col("short_answer").alias("answer"), F.array("long_answer").alias("contexts"), F.lit("short").alias("kind"))
    rows = raw.schema("question_id string, question string, answer struct<value:string>, contexts array<string>").json(path)
    return rows.select(F.col("question_id").alias("id"), "question", F.col("answer.value").alias("answer"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), F.lit("trivia").alias("kind"))
