"""Generalization, information loss and privacy audits of groups that are known: aggregates that Catalyst plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RuleSet
from .generalizers import Categories, Reduction


def _summaries(df: DataFrame, rules: RuleSet) -> list[Column]:
    types = dict(df.dtypes)
    out = []
    for r in rules.quasi_identifiers:
        c = F.col(r.column)
        array = {"is_array": True} if isinstance(r.generalizer, Categories) and types[r.column].startswith("array") else {}
        out.append(r.generalizer.aggregate(c, **array).alias(f"_s_{r.column}"))
    return out


def info_loss(rules: RuleSet, prefix: str = "_s_") -> Column:
    """Combined loss: weighted if the weights round to 1, else the mean; 0 without quasi-identifiers."""
    losses = [(r.weight, r.generalizer.loss_column(F.col(f"{prefix}{r.column}"))) for r in rules.quasi_identifiers]
    if not losses:
        return F.lit(0.0)
    if round(sum(r.weight for r in rules.rules)) == 1:
        return sum((F.lit(w) * x for w, x in losses[1:]), F.lit(losses[0][0]) * losses[0][1])
    return sum((x for _, x in losses[1:]), losses[0][1]) / len(losses)


def generalize_groups(df: DataFrame, keys: list[str], rules: RuleSet, subject: str | None = None) -> DataFrame:
    """A row per group: keys, each quasi-identifier generalized, info_loss, and n_subjects if a subject is named."""
    size = [F.count_distinct(F.col(subject)).alias("n_subjects")] if subject else []
    found = df.groupBy(*keys).agg(*_summaries(df, rules), *size)
    shown = [r.generalizer.render(F.col(f"_s_{r.column}")).alias(r.column) for r in rules.quasi_identifiers if r.column not in keys]
    return found.select(*keys, *shown, info_loss(rules).alias("info_loss"), *(["n_subjects"] if subject else []))


def generalize_rows(df: DataFrame, keys: list[str], rules: RuleSet) -> DataFrame:
    """Each row with the values of its group; columns without a rule are left out, passing ones stay."""
    groups = generalize_groups(df, keys, rules)
    passing = [r.column for r in rules.rules if r.generalizer.passes and r.column not in keys]
    return df.select(*keys, *passing).join(groups, keys)


def _merged(rules: RuleSet, one: str, two: str) -> list[Column]:
    """Summaries of two groups together: least and greatest values and lengths, whatever the generalizer. Nulls don't count."""
    out = []
    for r in rules.quasi_identifiers:
        x, y = F.col(f"{one}{r.column}"), F.col(f"{two}{r.column}")
        parts = {"a": F.least, "b": F.greatest} if isinstance(r.generalizer, Categories) else {"lo": F.least, "hi": F.greatest}
        if isinstance(r.generalizer, Reduction):
            parts = {"a": F.least, "b": F.greatest, "lo": F.least, "hi": F.greatest}
        out.append(F.struct(*(f(x[n], y[n]).alias(n) for n, f in parts.items())).alias(f"_w_{r.column}"))
    return out


def enlargement(df: DataFrame, keys: list[str], rules: RuleSet, probes: DataFrame, probe_id: str) -> DataFrame:
    """(keys, probe_id, enlargement): how a group's loss grows with a probe, for each group and probe.

    A probe is the rows of one probe_id: a single row, or a group to merge with. Probes are a stated set, broadcast.
    """
    columns = [f"_s_{r.column}" for r in rules.quasi_identifiers]
    base = df.groupBy(*keys).agg(*_summaries(df, rules)).select(*keys, *columns)
    asked = probes.groupBy(probe_id).agg(*_summaries(probes, rules)).withColumnsRenamed({c: "_p" + c[2:] for c in columns})
    both = base.join(F.broadcast(asked)).select("*", *_merged(rules, "_s_", "_p_"))
    return both.select(*keys, probe_id, (info_loss(rules, "_w_") - info_loss(rules)).alias("enlargement"))


def k_sizes(df: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """Distinct subjects of each group, exactly."""
    return df.groupBy(*keys).agg(F.count_distinct(F.col(subject)).alias("k_size"))


def k_violations(df: DataFrame, keys: list[str], subject: str, k: int) -> DataFrame:
    return k_sizes(df, keys, subject).where(F.col("k_size") < k)


def l_diversity(df: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """Distinct sensitive values of each group; an array counts by its last element."""
    c = F.col(sensitive)
    value = F.try_element_at(c, F.lit(-1)) if dict(df.dtypes)[sensitive].startswith("array") else c
    return df.groupBy(*keys).agg((F.count_distinct(value) + F.max(value.isNull().cast("int"))).alias("l_size"))


def l_violations(df: DataFrame, keys: list[str], sensitive: str, l: int) -> DataFrame:  # noqa: E741
    return l_diversity(df, keys, sensitive).where(F.col("l_size") < l)


def greedy_diversity(df: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """Rounds in which the most frequent (column, value) is taken and its rows dropped, per group.

    Groups meet as counts of distinct combinations, so a large group is as small as its domain.
    """
    counts = df.groupBy(*keys, *sensitive).agg(F.count("*").alias("_n"))
    types = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, rounds = rows, 0
        while len(left):
            best = None
            for p, c in enumerate(sensitive):
                for v, n in left.groupby(c, dropna=False)["_n"].sum().items():
                    rank = (-n, p, str(v))
                    if best is None or rank < best[0]:
                        best = (rank, c, v)
            _, c, v = best
            left = left[left[c].notna()] if v != v or v is None else left[left[c] != v]
            rounds += 1
        return rows[keys].iloc[:1].assign(diversity=rounds)

    return counts.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", diversity long")


def value_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group and how often it occurs; ties go to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"))).alias("m"))
    return best.select(*keys, F.col("m.v").alias(value), "n")


def moving_loss(df: DataFrame, order: list[str], loss: str, mu: int = 10, by: list[str] | None = None) -> DataFrame:
    """tau: the mean of the last mu losses, by shard if one is named."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-(mu - 1), 0)
    return df.withColumn("tau", F.avg(loss).over(w))


def nearest(df: DataFrame, keys: list[str], distance: str, tie: str, k: int) -> DataFrame:
    """The k - 1 nearest rows of each group by distance."""
    w = Window.partitionBy(*keys).orderBy(distance, tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k - 1)


def suppress(df: DataFrame, rules: RuleSet, strategy: int) -> DataFrame:
    """All rows suppressed: dropped (0), quasi-identifiers null (1) or most general (2), or all null; with info_loss 1."""
    by, columns = {r.column: r for r in rules.rules}, []
    for f in df.schema.fields:
        r = by.get(f.name)
        kind = f.dataType if r is None else r.generalizer.output_type(f.dataType)
        null = F.lit(None).cast(kind)
        if r is None or strategy not in (0, 1, 2):
            c = null
        elif r.generalizer.passes:
            c = F.col(f.name)
        else:
            c = r.generalizer.max_column(f.dataType) if strategy == 2 else null
        columns.append(c.alias(f.name))
    out = df.select(*columns, F.lit(1.0).cast("float").alias("info_loss"))
    return out.limit(0) if strategy == 0 else out


def group_counts(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Released combinations that occur fewer than k times."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") < k)
