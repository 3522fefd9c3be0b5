"""Model replies as data: from raw text to typed verdicts and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.functions.text import strip, strip_fences
from risklens.operators.ordering import chunk_rank

FIELDS = ["vulnerable", "risk_score", "type", "description"]


def truthy(value: Column, compat: bool = True) -> Column:
    """Truth of a JSON value.  With ``compat`` any non-empty string is true, also
    ``"false"``; without, the texts '' and 'false' are false."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    as_text = (text != "") if compat else ~F.lower(strip(text)).isin("", "false")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", as_text)
        .when(kind == "VOID", F.lit(False))
        .when(F.startswith(kind, F.lit("ARRAY")), text != "[]")
        .when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )


def clamp_score(value: Column) -> Column:
    """JSON value to a score: numbers are truncated, whole-number text is read,
    true is 1; clamped to 0..10; null when it cannot be read."""
    kind = F.schema_of_variant(value)
    text = strip(F.try_variant_get(value, "$", "string"))
    whole = F.coalesce(
        text.try_cast("decimal(38,0)"),
        F.when(F.startswith(text, F.lit("-")), F.lit(0)).otherwise(F.lit(10)).cast("decimal(38,0)"),
    )
    number = (
        F.when((kind == "STRING") & F.rlike(text, F.lit(r"^[+-]?\d+$")), whole.cast("double"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
        .when(kind.isin("STRING", "VOID") | F.rlike(kind, F.lit("^(ARRAY|OBJECT)")), F.lit(None).cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )
    # least and greatest skip nulls, so an unreadable value is kept out of them
    clamped = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(10.0), number))).cast("int")
    return F.when(number.isNotNull(), clamped)


def parse_verdict(df: DataFrame, col: str = "reply", compat: bool = True) -> DataFrame:
    """Columns vulnerable, risk_score, type, description, error and extras.

    The reply is read as JSON; failing that, its first brace group is.  A reply
    without a brace group is a default row.  A broken brace group, a value that
    is no object and an unreadable score set ``error`` and leave the rest null.
    Other keys go to ``extras`` and never replace a finding's own columns.
    """
    text = strip_fences(F.col(col))
    s1 = df.withColumn("_text", text)
    s2 = s1.withColumn("_whole", F.try_parse_json("_text")).withColumn(
        "_group", F.regexp_extract("_text", r"(?s)\{[^}]+\}", 0)
    )
    # one generated row each: a filter on the verdict must not be rewritten in
    # terms of the reply, which would parse it once per mention
    parsed = F.struct(
        F.coalesce("_whole", F.try_parse_json("_group")).alias("v"),
        (F.col("_whole").isNull() & (F.col("_group") == "")).alias("missing"),
    )
    s3 = s2.select(*df.columns, F.explode(F.array(parsed)).alias("_p")).select(
        *df.columns, F.col("_p.v").alias("_v"), F.col("_p.missing").alias("_missing")
    )
    value = {f: F.try_variant_get("_v", f"$.{f}", "variant") for f in FIELDS}
    is_object = F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))
    s4 = s3.withColumn("_object", F.coalesce(is_object, F.lit(False)))
    s5 = s4.withColumn(
        "_score", F.when(value["risk_score"].isNull(), F.lit(0)).otherwise(clamp_score(value["risk_score"]))
    )
    reason = (
        F.when(F.col("_missing"), F.lit(None))
        .when(F.col("_v").isNull(), "invalid JSON")
        .when(~F.col("_object"), "reply is not an object")
        .when(F.col("_score").isNull(), "risk_score is not a number")
    )
    s6 = s5.withColumn("error", reason)
    good = F.col("error").isNull()

    def field(default: Column, given: Column) -> Column:
        return F.when(F.col("_missing"), default).when(good, given)

    def text_field(name: str) -> Column:
        return F.when(value[name].isNull(), "unknown").otherwise(F.try_variant_get("_v", f"$.{name}", "string"))

    truth = F.when(value["vulnerable"].isNull(), F.lit(False)).otherwise(truthy(value["vulnerable"], compat))
    everything = F.from_json(F.to_json("_v"), "map<string,string>")
    extras = F.when(F.col("_object"), F.map_filter(everything, lambda k, _: ~k.isin(*FIELDS)))
    return s6.select(
        *df.columns,
        field(F.lit(False), truth).alias("vulnerable"),
        field(F.lit(0), F.col("_score")).alias("risk_score"),
        field(F.lit("error"), text_field("type")).alias("type"),
        field(F.lit("Failed to parse LLM response"), text_field("description")).alias("description"),
        "error",
        extras.alias("extras"),
    )


def with_analysis_errors(df: DataFrame) -> DataFrame:
    """Turn rows whose analysis failed into zero-score error verdicts."""
    bad = F.col("error").isNotNull()
    fixed = {
        "vulnerable": F.when(bad, F.lit(False)).otherwise(F.col("vulnerable")),
        "risk_score": F.when(bad, F.lit(0)).otherwise(F.col("risk_score")),
        "type": F.when(bad, F.lit("analysis_error")).otherwise(F.col("type")),
        "description": F.when(
            bad, F.concat(F.lit("Failed to analyze: Vulnerability analysis failed: "), "error")
        ).otherwise(F.col("description")),
    }
    return df.withColumns(fixed)


def extract_json_strings(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """String fields of broken JSON, one column per key; null unless all are found."""
    found = {
        k: F.regexp_extract_all(col, F.lit(rf'(?s)"{k}"\s*:\s*"((?:[^"\\]|\\.)*+)"'), 1) for k in keys
    }
    complete = F.lit(True)
    for values in found.values():
        complete = complete & (F.size(values) > 0)

    def plain(values: Column) -> Column:
        first = F.get(values, F.lit(0))
        return F.replace(F.replace(first, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))

    return df.withColumns({k: F.when(complete, plain(v)) for k, v in found.items()})


def assemble_findings(units: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every unit with its verdict; a unit without one is an analysis error.

    Keyed by (project_name, file_path, pos); ``pos`` keeps the unit order.
    """
    key = ["project_name", "file_path", "pos"]
    v = verdicts.select(*key, *FIELDS)
    joined = units.select(*key, "name", "start_line", "end_line").join(v, key, "left")
    none = F.col("type").isNull()
    return joined.select(
        "project_name", F.col("file_path").alias("file"), F.col("name").alias("function"), "pos", "start_line", "end_line",
        F.coalesce("vulnerable", F.lit(False)).alias("vulnerable"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
        F.when(none, "analysis_error").otherwise(F.col("type")).alias("type"),
        F.when(none, "Failed to analyze: no verdict").otherwise(F.col("description")).alias("description"),
    )


def resolve_tiers(tiers: DataFrame, key: str, names: Sequence[str] = ("primary", "fallback")) -> DataFrame:
    """First successful reply per key over rows (key, tier, ok, reply, error).

    ``tier`` is the one used, ``switches`` the failed tiers before it; when all
    fail ``error`` lists every tier's error in order.  Any number of tiers; those
    beyond ``names`` go by their number.  A key's list holds one error per tier.
    """
    at = F.when(F.col("ok"), F.col("tier"))
    best = tiers.groupBy(key).agg(
        F.min(at).alias("tier"), F.min_by("reply", at).alias("reply"),
        F.min(at).alias("_first"), F.max("tier").alias("_tiers"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.struct("tier", "error")))).alias("_errors"),
    )
    named = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    lines = F.transform("_errors", lambda e: F.concat(
        F.lit(" Tier "), e["tier"], F.lit(" ("), F.coalesce(F.get(named, e["tier"] - 1), F.concat(F.lit("tier "), e["tier"])),
        F.lit("): "), e["error"], F.lit("."),
    ))
    text = F.concat(F.lit("All tiers failed."), F.array_join(lines, ""))
    return best.select(
        key, "tier", "reply",
        F.coalesce(F.col("_first") - 1, F.col("_tiers")).cast("bigint").alias("switches"),
        F.when(F.col("_first").isNull(), text).alias("error"),
    )


def assemble_chat(messages: DataFrame) -> DataFrame:
    """Ordered messages of every conversation, the system message first.

    Row form (conv_id, position, role, text): a conversation of any length never
    has to be one value.
    """
    return chunk_rank(
        messages, ["conv_id"], "turn", "position", lead=(F.col("role") == "system").cast("int")
    ).select("conv_id", "position", "role", "text")


def user_prompts(messages: DataFrame) -> DataFrame:
    """First user message of every conversation, '' when there is none."""
    at = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("conv_id").agg(F.coalesce(F.min_by("text", at), F.lit("")).alias("user_prompt"))


def render_audit_prompt(units: DataFrame, code: str = "code") -> DataFrame:
    """Column ``prompt``: the audit question around a unit's code, for batch scoring."""
    return units.withColumn("prompt", F.concat(
        F.lit("Analyze this Python function for security vulnerabilities:\n\n```python\n"),
        F.col(code), F.lit("\n```\n\nReturn your analysis as JSON."),
    ))


def split_quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that fail; a null test is a failure."""
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def error_summary(df: DataFrame, key: str, error: str = "error", n: int = 5) -> DataFrame:
    """Counts of good and bad rows, and the first ``n`` errors by key."""
    counts = df.agg(
        F.count_if(F.col(error).isNull()).alias("good"), F.count_if(F.col(error).isNotNull()).alias("bad")
    )
    totals = counts.select(F.explode(F.array(
        F.struct(F.lit("good").alias("kind"), F.col("good").alias("n"), F.lit(None).cast("string").alias("error")),
        F.struct(F.lit("bad").alias("kind"), F.col("bad").alias("n"), F.lit(None).cast("string").alias("error")),
    )).alias("r")).select("r.*")
    sample = df.filter(F.col(error).isNotNull()).orderBy(key).limit(n).select(
        F.lit("error").alias("kind"), F.col(key).cast("bigint").alias("n"), F.col(error).alias("error")
    )
    return totals.unionByName(sample)
