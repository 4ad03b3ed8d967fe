"""Exact dedup: skew-safe combining of equal texts.

1. Locally: the map side of the first group-by folds equal texts of a partition.
2. Salted digest groups: (salt, digest, text) groups are merged, so a text that
   makes up a third of all rows is spread over ``salts`` tasks.
3. Globally: the salt winners, at most ``salts`` rows a text, are combined.

The normalised text is part of every grouping key, so content is compared at
every stage and the digest only routes rows.  Decisions go back to the rows by
(salt, digest, second hash): again no key holds more than a salt's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import lower_ascii


def _winners(docs: DataFrame, id_col: str, text_col: str, salts: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with normalised text, digests and salt; and (digest, check, keep_id, group_size) of each text."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    cols = [F.col(id_col).alias("id"), text.alias("norm")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    base = (docs.select(*cols)
            .withColumn("digest", F.sha2("norm", 256))
            .withColumn("check", F.xxhash64("norm"))
            .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")))
    merged = (base.groupBy("salt", "digest", "check", "norm")
              .agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")))
    winners = (merged.groupBy("digest", "check", "norm")
               .agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size")))
    return base, winners.select("digest", "check", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a
    group stays.  Null text counts as empty.  A null id never wins against an
    id; a group without ids has keep_id null and its rows are kept.  Rows that
    repeat both id and text all carry the decision of that id.  Other columns
    are ignored whatever their names.  An empty table gives an empty result.
    """
    base, winners = _winners(docs, id_col, text_col, salts, carry=False)
    salted = (base.select("salt", "digest", "check").distinct()  # hashes only: the text is not moved again
              .join(winners, ["digest", "check"]))
    out = base.drop("norm").join(salted, ["salt", "digest", "check"])
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"),
                      F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, once each, with all their columns.

    Only the kept ids and their digests meet the rows again, so the hot groups
    are gone by then; repeats of a row fall in the same task and need no more shuffle.
    """
    base, winners = _winners(docs, id_col, text_col, salts, carry=True)
    kept = winners.select(F.xxhash64("keep_id").alias("who"), "digest", "check", "keep_id")
    rows = base.drop("norm", "salt").withColumn("who", F.xxhash64("id"))
    # not <=>, which the planner would add to the join's keys: repeats must stay dealt by the three keys alone
    same = F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull())
    found = rows.join(kept.hint("merge"), ["who", "digest", "check"]).where(same)
    return found.dropDuplicates(["who", "digest", "check"]).select("row.*")
