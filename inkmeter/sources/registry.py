"""Kinds of writing, their writers and comparison arms, as small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Genre:
    id: str
    reference: str
    decider: str
    tested: tuple[str, ...]
    described: tuple[str, ...]
    pairing: str
    matched_placebo: bool = False
    not_recorded: tuple[str, ...] = ()


# ---- fixed values: the registry ----
GENRES = [
    Genre("abstracts", "raid-human", "raid-gpt4", ("raid-chatgpt", "raid-gpt4", "raid-llama-chat", "raid-mistral-chat"), ("raid-claude",), "document"),
    Genre("posts", "posts-human", "posts-gpt4", ("posts-chatgpt", "posts-gpt4", "posts-llama-chat", "posts-mistral-chat"), (), "document", False, ("bulleted_bold", "title_case_headings")),
    Genre("essays", "essays-human", "essays-claude-student", ("essays-claude-student", "essays-llama3-student"), ("essays-claude-plain",), "prompt", True),
]
COMPARISONS = ["casual-human", "careful-human", "hc3-gpt35"]
# ---- end of the fixed values ----


def writers(spark: SparkSession) -> DataFrame:
    """genre, arm, role: every arm of every genre; comparison arms have no genre."""
    rows = [(None, a, "comparison") for a in COMPARISONS]
    for g in GENRES:
        rows.append((g.id, g.reference, "reference"))
        rows += [(g.id, a, "decider" if a == g.decider else "tested") for a in g.tested] + [(g.id, a, "described") for a in g.described]
    return spark.createDataFrame(rows, "genre string, arm string, role string")


def genres_to_run(named: list[str] | None, collected: set[str]) -> tuple[list[Genre], list[str]]:
    """Genres to measure and names that are missing. Named ones are all required;
    by default every collected one runs, and abstracts are required."""
    by_id = {g.id: g for g in GENRES}
    wanted = named or [g.id for g in GENRES if g.id in collected or g.id == "abstracts"]
    return [by_id[x] for x in wanted if x in collected and x in by_id], [x for x in wanted if x not in collected or x not in by_id]
