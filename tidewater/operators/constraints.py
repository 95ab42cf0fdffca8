"""Audits as declared constraints. Rules are compiled so that each table is scanned once, whatever their number.

A table becomes one aggregate: its row rules are counted directly. Key rules (unique, foreign) need rows by key: these are counted by key
first, in the same scan, as one grouped table a key that all rules of it share.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.layout import written


@dataclass(frozen=True)
class Row:
    """A condition on each row; null fails."""

    name: str
    table: str
    holds: Column


@dataclass(frozen=True)
class Unique:
    """No two rows share the key; null keys fail."""

    name: str
    table: str
    key: str


@dataclass(frozen=True)
class Foreign:
    """Each non-null key of a row is a key of the other table."""

    name: str
    table: str
    key: str
    other: str
    other_key: str


@dataclass(frozen=True)
class Count:
    """The number of rows (that hold a condition) lies in a range."""

    name: str
    table: str
    least: int
    most: int | None = None
    where: Column | None = None


@dataclass(frozen=True)
class Same:
    """Two counts are equal: rows of a table (that hold a condition) and of another one."""

    name: str
    table: str
    other: str
    where: Column | None = None
    other_where: Column | None = None


Rule = Row | Unique | Foreign | Count | Same


def audit(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """``rule, kind, checked, failed, passed`` of each rule.

    Each table that a rule names is read once: one pass groups its rows by the keys that rules ask for (GROUPING SETS) and counts
    the rows that break each row rule in the grand total. What foreign keys compare are the grouped keys and not the rows.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    keys: dict[str, dict[str, None]] = defaultdict(dict)
    counted: dict[str, dict[str, Column]] = defaultdict(dict)
    for r in rules:
        counted[r.table]
        if isinstance(r, Row):
            counted[r.table][r.name] = ~F.coalesce(r.holds, F.lit(False))
        elif isinstance(r, Unique):
            keys[r.table][r.key] = None
        elif isinstance(r, Foreign):
            keys[r.table][r.key] = None
            keys[r.other][r.other_key] = None
            counted[r.other]
        elif isinstance(r, Count):
            counted[r.table][r.name] = F.lit(True) if r.where is None else F.coalesce(r.where, F.lit(False))
        else:
            counted[r.table][r.name] = F.lit(True) if r.where is None else F.coalesce(r.where, F.lit(False))
            counted[r.other][r.name + "/other"] = F.lit(True) if r.other_where is None else F.coalesce(r.other_where, F.lit(False))
    grouped = {t: written(group(tables[t], list(keys[t]), counted[t]), "audit") for t in counted}
    each = [totals(t, grouped[t], [r for r in rules if isinstance(r, Row | Count) and r.table == t]) for t in counted]
    each += [verdict(r, grouped, keys) for r in rules if not isinstance(r, Row | Count)]
    return reduce(DataFrame.unionByName, [x for x in each if x is not None]).withColumn("passed", F.col("failed") == 0)


def group(table: DataFrame, keys: list[str], counted: dict[str, Column]) -> DataFrame:
    """``which`` (of the keys; -1 the total), ``value`` of that key, ``n`` rows, and ``hits``, in the total, of each counted rule.

    A row is put out once for each key and once for the total, and combined in its task before anything is shuffled.
    """
    base = table.select(*(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)), *(c.cast("long").alias(f"c{i}") for i, c in enumerate(counted.values())))
    zeros = [F.lit(0).cast("long") for _ in counted]
    total = F.struct(F.lit(-1).alias("which"), F.lit(None).cast("string").alias("value"), *(F.col(f"c{i}").alias(f"h{i}") for i in range(len(counted))))
    by_key = [F.struct(F.lit(i).alias("which"), F.col(f"k{i}").alias("value"), *(z.alias(f"h{j}") for j, z in enumerate(zeros))) for i in range(len(keys))]
    rows = base.select(F.explode(F.array(total, *by_key)).alias("x")).select("x.*")
    hits = F.create_map(*(x for i, name in enumerate(counted) for x in (F.lit(name), F.sum(f"h{i}")))) if counted else F.lit(None).cast("map<string,bigint>")
    return rows.groupBy("which", "value").agg(F.count("*").alias("n"), hits.alias("hits"))


def result(name: str | Column, kind: str | Column, checked: Column, failed: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(name).alias("rule"), text(kind).alias("kind"), checked.cast("long").alias("checked"), failed.cast("long").alias("failed"))


def summed(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def totals(table: str, grouped: DataFrame, rules: list[Row | Count]) -> DataFrame | None:
    """The row and count rules of a table, from its one row of totals."""
    if not rules:
        return None
    row = grouped.where("which = -1").agg(summed(F.col("n")).alias("n"), *(summed(F.col("hits")[r.name]).alias(f"h{i}") for i, r in enumerate(rules)))
    out = []
    for i, r in enumerate(rules):
        hits = F.col(f"h{i}")
        if isinstance(r, Row):
            out.append(result(r.name, "row", F.col("n"), hits))
        else:
            over = F.greatest(hits - r.most, F.lit(0)) if r.most is not None else F.lit(0)
            out.append(result(r.name, "count", hits, F.greatest(r.least - hits, F.lit(0)) + over))
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def verdict(rule: Unique | Foreign | Same, grouped: dict[str, DataFrame], keys: dict[str, dict[str, None]]) -> DataFrame:
    mine = grouped[rule.table]
    of = lambda table, key: grouped[table].where(F.col("which") == list(keys[table]).index(key))
    if isinstance(rule, Unique):
        broken = F.when(F.col("value").isNull() | (F.col("n") > 1), F.col("n")).otherwise(0)
        found = of(rule.table, rule.key).agg(summed(F.col("n")).alias("checked"), summed(broken).alias("failed"))
    elif isinstance(rule, Foreign):
        own = of(rule.table, rule.key).where(F.col("value").isNotNull()).select("value", "n")
        lost = own.join(of(rule.other, rule.other_key).select("value", F.lit(True).alias("there")), "value", "left")
        found = lost.agg(summed(F.col("n")).alias("checked"), summed(F.when(F.col("there").isNull(), F.col("n"))).alias("failed"))
    else:
        sides = mine.where("which = -1").select(F.col("hits")[rule.name].alias("a"), F.lit(0).alias("b"))
        sides = sides.unionAll(grouped[rule.other].where("which = -1").select(F.lit(0).alias("a"), F.col("hits")[rule.name + "/other"].alias("b")))
        found = sides.agg(summed(F.col("a")).alias("checked"), F.abs(summed(F.col("a")) - summed(F.col("b"))).alias("failed"))
    return found.select(result(rule.name, type(rule).__name__.lower(), F.col("checked"), F.col("failed")).alias("x")).select("x.*")


def require_passed(found: DataFrame) -> DataFrame:
    """The audit, refused if a rule of it failed: what is published after it (tables, reports) rests on it."""
    broken = sorted(r.rule for r in found.where("NOT passed").select("rule").collect())  # a row a rule
    if broken:
        raise ValueError(f"failed audits: {', '.join(broken)}")
    return found
