"""Binding of drafted claims, estimates and sensor bands to their checks, with a reason for every gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.session import cut_lineage

BINDING = ("confirmed", "corrected")
VERDICTS = (*BINDING, "not_verifiable")


def file_pairs(files: DataFrame, path: str, research: str = "-research.json", checks: str = "-checks.json") -> DataFrame:
    """``stem, research, checks``: research files and the check files of the same stem. A draft without its
    checks binds nothing and is left out."""
    side = lambda ending, name: files.where(F.endswith(path, F.lit(ending))).select(F.regexp_replace(path, ending.replace(".", r"\.") + "$", "").alias("stem"), F.col(path).alias(name))
    return side(research, "research").join(side(checks, "checks"), "stem")


def indexed_checks(checks: DataFrame) -> DataFrame:
    """One row per checked claim: ``claim, check, verdict, approved, fault``.

    ``checks`` has ``check, claim, verdict, approved``. A check must name its claim, have a known verdict, be
    the only one of its claim, and carry approved values if it binds; ``fault`` says what is wrong first.
    """
    fault = (
        F.when(~F.col("check").eqNullSafe(F.concat(F.lit("chk-"), "claim")), "check does not name its claim")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
        .when(F.col("verdict").isin(*BINDING) & F.col("approved").isNull(), "no approved values")
    )
    one = F.struct("check", "verdict", "approved", fault.alias("fault"))
    counted = checks.where(F.col("claim").isNotNull()).groupBy("claim").agg(F.count(F.lit(1)).alias("_n"), F.min_by(one, "check").alias("c"))
    return counted.select("claim", "c.check", "c.verdict", "c.approved", F.when(F.col("_n") > 1, "checked twice").otherwise(F.col("c.fault")).alias("fault"))


def require_checks(checks: DataFrame) -> DataFrame:
    """The indexed checks; a faulty one is an error that names its claim."""
    fail = F.raise_error(F.concat(F.col("fault"), F.lit(": "), F.col("claim").cast("string"))).cast("string")
    return checks.withColumn("fault", F.when(F.col("fault").isNull(), F.lit(None).cast("string")).otherwise(fail))


def gap_reason() -> Column:
    """Why a claim joined to its check does not bind, null if it does."""
    return (
        F.when(F.col("check").isNull(), "no check record").when(F.col("fault").isNotNull(), F.col("fault"))
        .when(~F.col("verdict").isin(*BINDING), F.col("verdict"))
    )


def bound_claims(drafts: DataFrame, checks: DataFrame, sources: DataFrame) -> DataFrame:
    """``claim, status, bound, reason, value, check, basis`` of all drafts.

    ``drafts`` has ``claim, status, value, source_ids, basis, reasoning``. A documented one binds with a binding
    check whose claim cites known sources only; it takes the approved value. An estimate binds with its
    reasoning and at least one documented claim that is bound; ``basis`` keeps those. ``checks`` are indexed.
    """
    documented = drafts.where("status = 'documented'").join(checks, "claim", "left")
    cited = documented.select("claim", F.explode("source_ids").alias("source"))
    unknown = cited.join(sources.select("source").distinct(), "source", "left_anti").groupBy("claim").agg(F.array_sort(F.collect_set("source")).alias("_unknown"))
    documented = documented.join(unknown, "claim", "left")
    reason = F.coalesce(gap_reason(), F.when(F.col("_unknown").isNotNull(), F.concat(F.lit("unknown sources: "), F.array_join("_unknown", ","))))
    first = documented.select("claim", "status", reason.alias("reason"), F.when(reason.isNull(), F.col("approved")).alias("value"), F.when(reason.isNull(), F.col("check")).alias("check"), F.lit(None).cast("array<string>").alias("basis"))
    estimates = drafts.where("status = 'estimated'")
    named = estimates.select("claim", F.explode("basis").alias("_on")).distinct()
    held = named.join(first.where("reason IS NULL").select(F.col("claim").alias("_on")), "_on").groupBy("claim").agg(F.array_sort(F.collect_list("_on")).alias("_basis"))
    estimates = estimates.join(held, "claim", "left")
    why = F.when(F.col("_basis").isNull() | (F.coalesce(F.trim("reasoning"), F.lit("")) == ""), "estimate without a documented basis")
    second = estimates.select("claim", "status", why.alias("reason"), F.when(why.isNull(), F.col("value")).alias("value"), F.lit(None).cast("string").alias("check"), F.when(why.isNull(), F.col("_basis")).alias("basis"))
    both = first.unionByName(second)
    return both.select("claim", "status", F.col("reason").isNull().alias("bound"), "reason", "value", "check", "basis")


def bound_bands(bands: DataFrame, checks: DataFrame, sensors: DataFrame, uses: DataFrame) -> DataFrame:
    """``sensor, band, bound, reason, form, uses, check`` of every drafted band.

    ``bands`` has ``sensor, band, claim, uses`` (drafted use ids); its check approves ``center, width, range, uses``.
    ``sensors`` and ``uses`` are those that are bound. A band of a sensor that is not bound is a gap of its
    sensor. Approved values must have one wavelength form, a center with its width or a range, and name no
    use that the draft does not. Of the approved uses the bound ones are kept.
    """
    rows = bands.join(checks, "claim", "left").join(sensors.select("sensor", F.lit(True).alias("_sensor")).distinct(), "sensor", "left")
    a = lambda name: F.col(f"approved.{name}")
    centered, ranged = a("center").isNotNull(), a("range").isNotNull()
    extra = F.array_except(a("uses"), "uses")
    reason = F.coalesce(
        F.when(F.col("_sensor").isNull(), "sensor is not bound"), gap_reason(),
        F.when((centered == ranged) | (centered & a("width").isNull()), "not one wavelength form"), F.when(F.size(extra) > 0, "adds an undrafted use"),
    )
    rows = rows.withColumn("reason", reason).select("sensor", "band", "reason", F.when(centered, "center").otherwise("range").alias("form"), a("uses").alias("_approved"), "check")
    known = uses.select(F.col("use").alias("_use")).distinct()
    kept = rows.where("reason IS NULL").select("sensor", "band", F.explode("_approved").alias("_use")).join(known, "_use").groupBy("sensor", "band").agg(F.array_sort(F.collect_set("_use")).alias("uses"))
    out = rows.join(kept, ["sensor", "band"], "left")
    ok = F.col("reason").isNull()
    return out.select("sensor", "band", ok.alias("bound"), "reason", F.when(ok, F.col("form")).alias("form"), F.when(ok, F.coalesce("uses", F.array().cast(kept.schema["uses"].dataType))).alias("uses"), F.when(ok, F.col("check")).alias("check"))


def cited_closure(references: DataFrame, starts: DataFrame, levels: int = 100) -> DataFrame:
    """``claim, cited, depth``: everything a claim rests on, through any number of steps, at its least depth.

    ``references`` has ``claim, cites``. They are followed from ``starts`` (column ``claim``), all claims a step at a
    time and each pair once a step, until nothing further is cited. Rows are not limited, as those of a recursive
    query are; a chain of more than ``levels`` steps, so a circle of references too, is an error.
    """
    refs = cut_lineage(references.select("claim", "cites").distinct())
    onward = refs.select(F.col("claim").alias("cited"), F.col("cites").alias("_next"))
    step = refs.join(starts.select("claim").distinct(), "claim", "left_semi").select("claim", F.col("cites").alias("cited"), F.lit(1).alias("depth"))
    found = None
    for depth in range(2, levels + 2):
        step = cut_lineage(step)
        if found is not None and step.isEmpty():
            return found.groupBy("claim", "cited").agg(F.min("depth").alias("depth"))
        found = step if found is None else found.unionByName(step)
        step = step.join(onward, "cited").select("claim", F.col("_next").alias("cited")).distinct().withColumn("depth", F.lit(depth))
    if not step.isEmpty():
        raise ValueError(f"references go on after {levels} levels: a circle?")
    return found.groupBy("claim", "cited").agg(F.min("depth").alias("depth"))


def unknown_sources(closure: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``claim, cited`` of what is neither a claim nor a source."""
    known = claims.select(F.col("claim").alias("cited")).unionByName(sources.select(F.col("source").alias("cited"))).distinct()
    return closure.select("claim", "cited").join(known, "cited", "left_anti").select("claim", "cited")


def require_known_sources(closure: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The closure; a claim that rests on an unknown source is an error that names both."""
    bad = unknown_sources(closure, claims, sources).withColumn("_bad", F.lit(True))
    fail = F.raise_error(F.concat_ws(" ", F.lit("unknown source"), "cited", F.lit("of"), "claim")).cast("int")
    joined = closure.join(bad, ["claim", "cited"], "left")
    return joined.withColumn("depth", F.when(F.col("_bad").isNull(), F.col("depth")).otherwise(fail)).drop("_bad")
