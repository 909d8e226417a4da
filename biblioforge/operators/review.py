"""Flagging records for human review, checking the answers and carrying them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioforge.operators.merge import descending, first_by, ordered_join
from biblioforge.operators.relational import require_columns

#: Flags with the column of their answer, and the answers allowed.
ANSWERS = {
    "low_prob": ("review_low_prob", ("do not remove", "remove")),
    "duplicate_urls": ("review_dup_urls", ("do not merge", "merge on record with best name prob", "conflicting record(s) to be removed")),
    "duplicate_names": ("review_dup_names", ("do not merge", 'merge all "dup name" IDs', "merge only:", "conflicting record(s) to be removed")),
}
LOW_PROB = "low_prob_best_name"


def flag_low_prob(prob: Column, least: float) -> Column:
    """A mark where a score is below the least one, else blank; a score that is no number is an error."""
    return F.when(prob.cast("double") < least, F.lit(LOW_PROB)).otherwise(F.lit(""))


def add_review_columns(df: DataFrame) -> DataFrame:
    """With the six blank columns that reviewers fill."""
    names = [a for a, _ in ANSWERS.values()]
    return df.withColumns({c: F.lit("") for c in [*names, *(f"review_notes_{n.removeprefix('review_')}" for n in names)]})


def flag_counts(df: DataFrame) -> DataFrame:
    """One row: how many records have any flag, and each of the three."""
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    u, n, p = (set_(c) for c in ("duplicate_urls", "duplicate_names", "low_prob"))
    return df.agg(F.count_if(u | n | p).alias("any_flag"), F.count_if(u).alias("url_flag"), F.count_if(n).alias("name_flag"), F.count_if(p).alias("prob_flag"))


def violations(df: DataFrame, id_col: str) -> DataFrame:
    """(id, column, problem) of flagged records without an answer and of answers that are not allowed."""
    require_columns(df, [a for a, _ in ANSWERS.values()])
    parts = []
    for flag, (answer, allowed) in ANSWERS.items():
        given = F.trim(F.coalesce(F.col(answer), F.lit("")))
        flagged = F.coalesce(F.col(flag), F.lit("")) != ""
        problem = F.when(flagged & (given == ""), "unanswered").when((given != "") & ~given.isin(*allowed) & ~given.startswith("merge only:"), "not allowed")
        parts.append(F.struct(F.lit(answer).alias("column"), problem.alias("problem")))
    found = df.select(F.col(id_col), F.inline(F.array(*parts)))
    return found.where("problem is not null")


def note_violations(df: DataFrame, id_col: str) -> DataFrame:
    """(id, note) of records to be merged with some others only whose note is no list of ids."""
    note = F.trim(F.coalesce(F.col("review_notes_dup_names"), F.lit("")))
    return df.where((F.trim("review_dup_names") == "merge only:") & ~note.rlike("^[0-9]+(\\s*,\\s*[0-9]+)*$")).select(id_col, note.alias("note"))


def mixed_instructions(df: DataFrame, id_col: str, group: str, answer: str) -> DataFrame:
    """Groups in which not all instructions are the same."""
    said = df.where(F.coalesce(F.col(group), F.lit("")) != "").select(group, F.explode(F.split(F.col(answer), ", ")).alias("said")).where("said <> ''")
    return said.groupBy(group).agg(F.countDistinct("said").alias("n_instructions")).where("n_instructions > 1")


def stop_on_violations(df: DataFrame, id_col: str, show: int = 20) -> None:
    """Raise if there are violations, naming the first ones."""
    found = violations(df, id_col).orderBy(id_col, "column").limit(show).collect()
    if found:
        raise ValueError("; ".join(f"{r[id_col]}: {r['column']} {r['problem']}" for r in found))


def drop_removed(df: DataFrame) -> DataFrame:
    """Without records that reviewers removed, and without the columns that said so."""
    return df.where(F.coalesce(F.col("review_low_prob"), F.lit("")) != "remove").drop("low_prob", "review_low_prob", "review_notes_low_prob")


def merge_urls(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Records told to merge on their address become one: ids and names listed by descending score, the rest from the first one."""
    told = F.col("review_dup_urls") == "merge on record with best name prob"
    order = [-F.coalesce(F.col("best_name_prob").try_cast("double"), F.lit(0.0)), F.col(id_col)]
    return _merged(df, told, "extracted_url", order, id_col, ["best_name", "best_name_prob"], columns)


def merge_names(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Records not told otherwise that share a name become one, newest first."""
    told = (F.coalesce(F.col("duplicate_names"), F.lit("")) != "") & (F.col("review_dup_names") != "do not merge")
    order = [descending(F.col("publication_date")), F.col(id_col)]
    return _merged(df, told, "best_name", order, id_col, ["best_name_prob"], columns)


def _merged(df: DataFrame, told: Column, group: str, order: list[Column], id_col: str, listed: list[str], columns: list[str]) -> DataFrame:
    told = F.coalesce(told, F.lit(False))
    kept = df.where(~told).select(F.col(id_col).cast("string").alias(id_col), *[F.col(c).cast("string").alias(c) for c in columns])
    firsts = [c for c in columns if c not in listed and c != group]
    merged = df.where(told).groupBy(group).agg(
        ordered_join(F.col(id_col), order).alias(id_col), *[ordered_join(F.col(c), order).alias(c) for c in listed],
        *[first_by(F.col(c).cast("string"), order).alias(c) for c in firsts])
    return kept.unionByName(merged.select(id_col, *columns))
