"""What of a machine's texts may be shown beside a person's, and which texts a panel draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import java
from ..session import cut
from .overlap import exploded, small

#: Fixed value: subjects on which no text is shown where the person may not be quoted.
SENSITIVE = r"\b(?:suicid\w*|self[- ]?harm\w*|kill(?:ing)? myself|end(?:ing)? my (?:own )?life|sexual(?:ly)? (?:assault|abus)\w*|rap(?:e|ed|es|ing|ist)\b|molest\w*|abus(?:e|ed|er|ers|ive)\b|psychos[ie]s|psychotic|overdos\w*|addict\w*|alcoholi\w*|rehab\b|drugs?\b|heroin|cocaine|opioid\w*|fentanyl|meth\b|eating disorders?|anorexi\w*|bulimi\w*|accus(?:e|ed|es|ing|ation|ations)\b|convict\w*|arrest\w*|bomb\w*|terror\w*|shoot(?:ing|er|ers)\b|murder\w*|lawsuits?\b)"


#: Where a match of ``SENSITIVE`` begins, looked for first.
BEGINS = r"(?<!\w)(?=[abcdefhklmoprst])"


def is_sensitive(text: Column) -> Column:
    return F.coalesce(text.rlike(java(f"{BEGINS}{SENSITIVE}", "i")), F.lit(False))


def one_persons_words(machine: DataFrame, people: DataFrame, assignments: DataFrame) -> DataFrame:
    """id of the machine texts (id, text) that hold eight words in a row which exactly one of the persons' texts (id, text) holds and no assignment (text) does."""
    single = exploded(people.withColumnRenamed("id", "who"), 8, "who").groupBy("gram").agg(F.count("*").alias("n")).where("n = 1").select("gram")
    given = exploded(assignments, 8).join(small(single), "gram", "left_semi").distinct()
    pool = cut(single.join(given, "gram", "left_anti"))
    return exploded(machine, 8, "id").join(small(pool), "gram", "left_semi").select("id").distinct()


def panel(rows: DataFrame, writers: list[str], guarded: DataFrame, order: Column, person: str | None = None, n: int = 6) -> DataFrame:
    """doc, rank of the first ``n`` documents, in order of a hash, that all ``writers`` (and the person) have.

    ``rows`` are (arm, doc, text). A document is passed over if any arm's text
    touches a sensitive subject or it is among ``guarded`` (doc).
    """
    needed = [*writers, person] if person else writers
    have = rows.where(F.col("arm").isin(*needed)).groupBy("doc").agg(F.countDistinct("arm").alias("arms"), F.bool_or(is_sensitive(F.col("text"))).alias("bad"))
    fine = have.where((F.col("arms") == len(needed)) & ~F.col("bad")).select("doc").join(guarded.select("doc"), "doc", "left_anti")
    first = fine.withColumn("_k", order).orderBy("_k", "doc").limit(n)
    return first.agg(F.array_sort(F.collect_list(F.struct("_k", "doc"))).alias("a")).select(F.posexplode("a").alias("rank", "x")).select("x.doc", (F.col("rank") + 1).alias("rank"))


LEVELS = ["grade and length", "grade", "assignment only"]


def level_draw(rows: DataFrame, lead: str, others: list[str], order: Column) -> DataFrame:
    """grp, matched, arm, id: one text per writer and assignment, as level as the texts allow.

    ``rows`` are (arm, id, grp, grade, bin); no text that must not be shown is
    among them. The levels are tried in turn; at the first one at which every
    writer has a text with the key of some text of the lead, the lead's first
    such text in hash order is taken and each other writer's first with its
    key. A text outside all bins has no key at the first level.
    """
    grade = F.concat(F.lit("g"), F.coalesce(F.col("grade").cast("string"), F.lit("?")))
    keys = [F.when(F.col("bin") >= 0, F.concat(grade, F.lit("/b"), F.col("bin").cast("string"))), grade, F.lit("")]
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys))))
    each = rows.where(F.col("arm").isin(lead, *others)).withColumn("_k", order).select("arm", "id", "grp", "_k", level.alias("l")).where("l.key is not null")
    firsts = each.groupBy("grp", "arm", "l.level", "l.key").agg(F.min(F.struct("_k", "id")).alias("first"))
    whole = firsts.groupBy("grp", "level", "key").agg(F.count("*").alias("arms"), F.min(F.when(F.col("arm") == lead, F.col("first"))).alias("lead"))
    best = whole.where((F.col("arms") == 1 + len(others)) & F.col("lead").isNotNull()).groupBy("grp").agg(F.min(F.struct("level", "lead", "key")).alias("b"))
    chosen = best.select("grp", "b.level", "b.key")
    names = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1)
    return firsts.join(chosen, ["grp", "level", "key"]).select("grp", names.alias("matched"), "arm", "first.id")


def grade_of(id_: Column) -> Column:
    """The grade that an id records (".g8."); null without."""
    return F.nullif(F.regexp_extract(id_, r"\.g([0-9]+)\.", 1), F.lit("")).cast("int")


def link_for(arm: Column, id_: Column) -> Column:
    """The address of a comparison arm's text; null for others."""
    se = r"^(english|academia|writing):([0-9]+)$"
    return F.when((arm == "casual-human") & id_.rlike(r"^[0-9]+\z"), F.concat(F.lit("https://news.ycombinator.com/item?id="), id_)).when(
        (arm == "careful-human") & id_.rlike(se), F.concat(F.lit("https://"), F.regexp_extract(id_, se, 1), F.lit(".stackexchange.com/a/"), F.regexp_extract(id_, se, 2))
    )
