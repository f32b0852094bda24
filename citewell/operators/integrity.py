"""Visibility by organisation and integrity reports, as semi- and anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def visible_rows(rows: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Rows of organisations that the user belongs to."""
    return rows.join(members.filter(F.col("user_id") == user_id), "org_id", "left_semi")


def writable_rows(rows: DataFrame, members: DataFrame, user_id: int, owner_only: bool = False) -> DataFrame:
    roles = ("owner",) if owner_only else ("owner", "recruiter")
    return rows.join(members.filter((F.col("user_id") == user_id) & F.col("role").isin(*roles)), "org_id", "left_semi")


def member_list(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id").orderBy("org_id", "name", "email")


def unique_violations(checks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """``check, key, n``: keys that occur more than once."""
    parts = [rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("check"), F.to_json(F.struct(*keys)).alias("key"), "n") for name, rows, keys in checks]
    return reduce(DataFrame.unionByName, parts)


def check_violations(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """``check, n``: rows that break each rule; a rule that is null for a row holds, as in SQL."""
    parts = [rows.agg(F.count_if(~rule).alias("n")).select(F.lit(name).alias("check"), "n") for name, rows, rule in checks]
    return reduce(DataFrame.unionByName, parts)


def fk_violations(checks: list[tuple[str, DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """``check, key``: child keys without a parent; keys with a null part are left out."""
    parts = []
    for name, child, parent, keys in checks:
        own = child.select(*keys).dropna().distinct()
        parts.append(own.join(parent.select(*keys).distinct(), keys, "left_anti").select(F.lit(name).alias("check"), F.to_json(F.struct(*keys)).alias("key")))
    return reduce(DataFrame.unionByName, parts)


def owned_report(reports: DataFrame, user_id: int) -> DataFrame:
    return reports.filter(F.col("user_id") == user_id)


def invitation_lookup(asked: DataFrame, invitations: DataFrame) -> DataFrame:
    """``asked(ask_id, code)`` -> the invitation whose token hashes to the code's hash, else whose passcode does in upper case."""
    # the hashes made here are far longer than Spark expects, which would send all of them to the driver for a broadcast
    by_token = invitations.select(F.col("token_hash").alias("h1"), F.col("invitation_id").alias("by_token")).hint("merge")
    by_code = invitations.select(F.col("passcode_hash").alias("h2"), F.col("invitation_id").alias("by_code")).hint("merge")
    rows = asked.withColumns({"h1": F.sha2("code", 256), "h2": F.sha2(F.upper("code"), 256)})
    return rows.join(by_token, "h1", "left").join(by_code, "h2", "left").select("ask_id", F.coalesce("by_token", "by_code").alias("invitation_id"))
