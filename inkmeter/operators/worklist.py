"""Work lists of texts to be written: numbered slots, what is wrong with a returned one, and its record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dialect import java
from ..functions.tokens import n_words

#: The least words of an essay, and how much of its assignment it may carry.
LEAST_WORDS, ECHO_SPAN, ECHO_COPIED = 40, 40, 200


def slots(cells: DataFrame, arms: list[str], order: Column) -> DataFrame:
    """id, arm, slug, grade, n, index from cells (slug, grade, slots).

    An id depends on its cell alone. ``index`` is the place in an arm's order,
    a hash of the cell and number, the same for every arm, so a run that stops
    has covered the same cells in each. The window runs over slots, which are
    counted in hundreds and not rows of data.
    """
    each = cells.where("slots > 0").select("slug", "grade", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("n"))
    each = each.withColumn("_k", order).withColumn("index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_k", "slug", "grade", "n")) - 1).drop("_k")
    each = each.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    id_ = F.concat_ws(".", "arm", "slug", F.concat(F.lit("g"), F.col("grade").cast("string")), F.lpad(F.col("n").cast("string"), 3, "0"))
    return each.select(id_.alias("id"), "arm", "slug", "grade", "n", "index")


def prompt_for(template: Column, grade: Column, assignment: Column) -> Column:
    """A template with its grade and assignment put in literally, so no character of either is special."""
    return F.replace(F.replace(template, F.lit("{grade}"), grade.cast("string")), F.lit("{assignment}"), assignment)


def letter_asked(assignment: Column) -> Column:
    return assignment.rlike(java(r"\bwrite a letter\b", "i"))


def longest_echo(text: str | None, assignment: str | None, least: int = ECHO_SPAN) -> tuple[int, str] | None:
    """Length and beginning of the longest run of characters that both hold, from ``least`` on.

    Case and white space are folded. The run is found by a suffix automaton of
    the assignment, in time that grows with both lengths and not their product.
    """
    a, b = (" ".join((x or "").lower().split()) for x in (text, assignment))
    step: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in b:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    best, end, at, length = 0, 0, 0, 0
    for i, c in enumerate(a):
        while at and c not in step[at]:
            at = link[at]
            length = size[at]
        if c in step[at]:
            at = step[at][c]
            length += 1
        if length > best:
            best, end = length, i + 1
    return (best, a[end - best : end - best + min(best, 120)]) if best >= least else None


@F.pandas_udf(T.StructType([T.StructField("longest", T.IntegerType()), T.StructField("snippet", T.StringType())]))
def assignment_echo(text: pd.Series, assignment: pd.Series) -> pd.DataFrame:
    """How much of an assignment a text carries; nulls below the least span."""
    found = [longest_echo(t, a) or (None, None) for t, a in zip(text, assignment, strict=True)]
    return pd.DataFrame(found, columns=["longest", "snippet"]).astype({"longest": "Int32"})


FILES = "id string, slot string, file_arm string, model string, text string, prompt string, prompt_sha256 string, text_sha256 string, error string, generated_at string, context_id string"


def problems(rows: DataFrame, strict: bool = False) -> DataFrame:
    """id, problems: everything wrong with a returned slot, as a list.

    ``rows`` join the slot's (id, arm, wanted_model, wanted_prompt, assignment)
    and its file's columns (``FILES`` without id). Absent optional fields are null.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("_t", text).withColumn("_n", n_words(text)).withColumn("_e", assignment_echo(F.col("_t"), F.col("assignment")))
    differs = lambda a, b: F.col(a).isNotNull() & (F.col(a) != b)
    limit = ECHO_SPAN if strict else ECHO_COPIED
    tests = [
        (~F.col("slot").eqNullSafe(F.col("id")), "another slot"),
        (~F.col("file_arm").eqNullSafe(F.col("arm")), "another arm"),
        (F.col("error").isNotNull(), "an error was recorded"),
        (differs("prompt", F.col("wanted_prompt")), "another prompt"),
        (differs("prompt_sha256", F.sha2("wanted_prompt", 256)), "another prompt's hash"),
        (F.col("_t") == "", "empty"),
        ((F.col("_t") != "") & (F.col("_n") < LEAST_WORDS), "too short"),
        (differs("text_sha256", F.sha2("_t", 256)), "another text's hash"),
        (differs("model", F.col("wanted_model")), "another model"),
        (F.coalesce("generated_at", F.lit("")) == "", "no time"),
        (F.coalesce("context_id", F.lit("")) == "", "no context"),
        (F.col("_e.longest") >= limit, "carries the assignment"),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), name) for t, name in tests)), lambda x: x.isNotNull())
    return rows.select("id", found.alias("problems"))


def recorded(rows: DataFrame) -> DataFrame:
    """The record of checked slots: ids, settings and hashes, computed here and never taken from a file."""
    text = F.trim("text")
    return rows.select("id", "arm", "model", "generated_at", "context_id", F.sha2("wanted_prompt", 256).alias("prompt_sha256"), F.sha2(text, 256).alias("text_sha256"), n_words(text).alias("words"))


def manifest(records: DataFrame) -> DataFrame:
    """arm, texts, words, digest: one row per arm; the digest is of its text hashes in order of id."""
    got = records.groupBy("arm").agg(F.count("*").alias("texts"), F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("id", "text_sha256"))).alias("h"))  # a work list's slots
    return got.select("arm", "texts", "words", F.sha2(F.concat_ws(",", F.col("h.text_sha256")), 256).alias("digest"))
