"""Scalar operators over findings: enrichment, ids, normalisation, aggregates, risks and exit codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def _by_capability(place: int) -> Column:
    return F.coalesce(*[F.when(F.col("capability") == k, v[place]) for k, v in R.CAPABILITIES.items()], F.lit(R.OTHER_CAPABILITY[place]))


def enrich(found: DataFrame) -> DataFrame:
    """Fill empty explanations and impacts, and replace a missing or ``medium`` risk, from the capability."""
    have = set(found.columns)
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string")
    risk = given("risk_level")
    return found.withColumns(
        {
            "explanation": F.coalesce(given("explanation"), _by_capability(1)),
            "impact": F.coalesce(given("impact"), _by_capability(2)),
            "risk_level": F.when(risk.isNull() | (F.lower(risk) == "medium"), _by_capability(0)).otherwise(risk),
        }
    )


def with_ids(found: DataFrame) -> DataFrame:
    """Add finding_ref ``detector:file:line[:evidence]`` and finding_id, the first 12 hex digits of its SHA-1."""
    line = F.coalesce(F.col("lineno").cast("string"), F.lit("None"))
    ref = F.concat("detector", F.lit(":"), "rel", F.lit(":"), line, F.when(F.coalesce("evidence", F.lit("")) == "", "").otherwise(F.concat(F.lit(":"), "evidence")))
    return found.withColumn("finding_ref", ref).withColumn("finding_id", F.substring(F.sha1(F.col("finding_ref").cast("binary")), 1, 12))


def normalized(found: DataFrame) -> DataFrame:
    """Report constraints: risk one of four levels, confidence in [0, 1], an integer line; what cannot be
    converted becomes NULL (risk: ``medium``). A NULL stays NULL."""
    risk = F.lower("risk_level")
    sure = F.expr("try_cast(confidence AS double)")
    return found.withColumns(
        {
            "risk_level": F.when(F.col("risk_level").isNull(), None).when(risk.isin(R.LEVELS), risk).otherwise("medium"),
            "confidence": F.when(F.isnan(sure), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))) if dict(found.dtypes)["confidence"] == "string" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double"))),
            "lineno": F.expr("try_cast(lineno AS int)"),
        }
    )


def capabilities(found: DataFrame) -> DataFrame:
    """Sorted distinct capabilities of each project."""
    return found.groupBy("project").agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))


def risks(found: DataFrame, rules=R.RISKS) -> DataFrame:
    """Combined risks of each project: those whose needed capabilities all occur."""
    destroys = (F.col("capability") == "WRITE") & F.lower("evidence").rlike("|".join(R.DESTRUCTIVE))
    have = found.groupBy("project").agg(F.collect_set("capability").alias("have"), F.coalesce(F.max(destroys), F.lit(False)).alias("destroys"))
    table = R.table(found.sparkSession, [(n, i, t, "high", w, sorted(c), d) for n, (i, t, w, c, d) in enumerate(rules)], "nth int, id string, title string, severity string, why string, capabilities_triggered array<string>, needs boolean")
    fits = (F.size(F.array_except("capabilities_triggered", "have")) == 0) & (~F.col("needs") | F.col("destroys"))
    return have.join(F.broadcast(table), fits).select("project", "nth", "id", "title", "severity", "why", "capabilities_triggered")  # a fixed table of a few rows


def exit_code(found: DataFrame, severity: str = "high") -> DataFrame:
    """One row: 1 if a reachable finding has a level of the severity, else 0."""
    levels = {"high": ["high"], "medium": ["high", "medium"], "none": []}.get(severity, ["high"])
    hit = (F.col("reachability") == "reachable") & F.col("risk_level").isin(levels) if levels else F.lit(False)
    return found.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("exit_code"))


def languages(paths: DataFrame) -> DataFrame:
    """Files per other language and project, from paths(project, path), most first."""
    extension = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    names = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in R.LANGUAGES.items()) + ")")
    kept = paths.filter(~excluded(F.col("path"), R.LANGUAGE_SKIPS)).withColumn("language", F.try_element_at(names, extension)).filter("language is not null")
    return kept.groupBy("project", "language").agg(F.count(F.lit(1)).alias("count"))


def excluded(path: Column, parts) -> Column:
    """Whether some component of the path, in any letter case, is one of ``parts``."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, parts)))


def state_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("project", "reachability").agg(F.count(F.lit(1)).alias("n"))


def union_all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
