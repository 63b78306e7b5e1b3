"""Validators as projections: every broken rule of every record, not the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column | str]]) -> DataFrame:
    """(key, rule, message) for each rule (name -> (broken, message)) that a record breaks; null is not broken."""
    found = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for name, (broken, m) in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("p")).select(key, "p.rule", "p.message")


def unresolved(df: DataFrame, key: str, refs: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """(key, rule, message): array items that no known row has."""
    each = df.select(key, F.explode(refs).alias("__ref")).distinct()
    return each.join(known.select(F.col(known_key).alias("__ref")).distinct(), "__ref", "left_anti").select(key, F.lit(rule).alias("rule"), F.concat(F.lit("unknown "), F.col("__ref").cast("string")).alias("message"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).count().where("count > 1")
    return n.select(key, F.lit("repeated_id").alias("rule"), F.format_string("%d rows", F.col("count")).alias("message"))


def split_by_problems(df: DataFrame, key: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, broken) rows: one bad record doesn't block the others."""
    bad = found.select(key).distinct()
    return df.join(bad, key, "left_anti"), df.join(bad, key, "left_semi")


def append_batch(existing: DataFrame, batch: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """existing and batch together, or an error that names every reason: all rows are added or none."""
    clash = batch.join(existing.select(key), key, "left_semi").select(key, F.lit("existing_id").alias("rule"), F.lit("already stored").alias("message"))
    all_found = found.unionByName(clash).unionByName(repeated(batch, key))
    if rows := all_found.limit(20).collect():
        raise ValueError("; ".join(f"{r[0]}: {r['rule']} ({r['message']})" for r in rows))
    return existing.unionByName(batch)


MOST_AUTHOR, MOST_ITEM, MOST_NOTE, MOST_LINE, MOST_LINES = 80, 2000, 2000, 200, 60


def _author(author: Column) -> dict[str, tuple[Column, str]]:
    blank = F.trim(F.coalesce(author, F.lit(""))) == ""
    return {"author": (blank, "author is required for attribution"), "author_length": (F.length(F.trim(author)) > MOST_AUTHOR, f"author exceeds {MOST_AUTHOR} characters")}


def rating_rules(answer_id: Column, issued: Column, rating: Column, note: Column) -> dict[str, tuple[Column, str]]:
    """Rules of a rating for ``problems``; issued: whether the server has given this answer's id out."""
    blank = F.coalesce(answer_id, F.lit("")) == ""
    return {
        "answer_id": (blank, "answer_id must be a non-empty string"),
        "not_issued": (~blank & ~F.coalesce(issued, F.lit(False)), "answer_id is not one this server issued"),
        "rating": (~F.coalesce(rating.isin("up", "down"), F.lit(False)), "rating must be 'up' or 'down'"),
        "note": (F.length(note) > MOST_NOTE, f"note must be a string of at most {MOST_NOTE} characters"),
    }


def rubric_rules(known: Column, author: Column, points: Column, errors: Column) -> dict[str, tuple[Column, str]]:
    """Rules of a submitted rubric; points and errors: arrays of text, blank items don't count."""
    filled = F.filter(F.coalesce(points, F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    long = lambda items: F.exists(items, lambda p: F.length(F.trim(p)) > MOST_ITEM)
    return {
        "id": (~F.coalesce(known, F.lit(False)), "unknown id"),
        **_author(author),
        "key_points": (F.size(filled) < 2, "at least 2 key points are needed"),
        "point_length": (long(points), f"a key point exceeds {MOST_ITEM} characters"),
        "error_length": (long(errors), f"a common error exceeds {MOST_ITEM} characters"),
    }


def adjudication_rules(known: Column, author: Column, present: Column, n_errors: Column, note: Column, not_covered: Column) -> dict[str, tuple[Column, str]]:
    """Rules of a blind adjudication; present: the numbers of the errors that are in the answer."""
    bare = F.trim(F.coalesce(note, F.lit(""))) == ""
    return {
        "key": (~F.coalesce(known, F.lit(False)), "unknown key"),
        **_author(author),
        "missing": (present.isNull(), "errors_present must be a list"),
        "too_many": (F.size(present) > n_errors, "errors_present contains too many entries"),
        "range": (F.exists(present, lambda n: ~n.between(F.lit(1), n_errors)), "error numbers must be among the errors shown"),
        "note": (bare & ((F.size(present) > 0) | F.coalesce(not_covered, F.lit(False))), "a note is required when errors are selected or the answer is not covered"),
        "note_length": (F.length(F.trim(note)) > MOST_NOTE, f"note exceeds {MOST_NOTE} characters"),
    }


def reference_rules(known: Column, author: Column, lines: Column) -> dict[str, tuple[Column, str]]:
    """Rules of a submitted reference line; blank lines don't count."""
    filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return {
        "record": (~F.coalesce(known, F.lit(False)), "unknown record"),
        **_author(author),
        "missing": (lines.isNull(), "reference_actions must be a list"),
        "too_many": (F.size(filled) > MOST_LINES, f"at most {MOST_LINES} actions"),
        "line_length": (F.exists(filled, lambda x: F.length(x) > MOST_LINE), f"an action line is over {MOST_LINE} characters"),
    }


def upserted(stored: DataFrame, candidates: DataFrame, saved: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, refused): stored records with what was saved over them; a candidate that is saved becomes stored.

    saved: (key, at, author, key_points, common_errors, category, difficulty); the last of a key counts. Blank
    items go; under two points, or of an unknown id, a row is refused with its reason. stored and candidates
    have the same columns, among them those saved, rubric_source and needs_review.
    """
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    last = saved.groupBy(key).agg(F.max_by(F.struct(*(c for c in saved.columns if c != key)), "at").alias("s"))
    last = last.select(key, clean(F.col("s.key_points")).alias("__p"), clean(F.col("s.common_errors")).alias("__e"), *(F.col(f"s.{c}").alias(f"__{c}") for c in ("author", "category", "difficulty")))
    base = stored.withColumn("__stored", F.lit(True)).unionByName(candidates.join(stored.select(key), key, "left_anti").withColumn("__stored", F.lit(False)))
    reason = F.when(F.size("__p") < 2, "fewer than 2 key points").when(F.col("__stored").isNull(), "unknown record")
    refused = last.join(base.select(key, "__stored"), key, "left").select(key, reason.alias("reason")).where("reason is not null")
    good = F.size("__p") >= 2
    by = F.when(F.coalesce("__author", F.lit("")) != "", F.concat(F.lit("hand-authored ("), F.col("__author"), F.lit(")"))).otherwise("hand-authored")
    new = {"key_points": F.col("__p"), "common_errors": F.col("__e"), "category": F.coalesce("__category", "category"), "difficulty": F.coalesce("__difficulty", "difficulty"), "rubric_source": by, "needs_review": F.lit(True)}
    met = base.join(last, key, "left").withColumn("__new", F.coalesce(good, F.lit(False)))
    out = met.where("__stored or __new").withColumns({c: F.when(F.col("__new"), v).otherwise(F.col(c)) for c, v in new.items()})
    return out.select(*stored.columns), refused
