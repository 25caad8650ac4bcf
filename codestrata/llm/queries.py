"""Queries and SQL of the operators in this subpackage; ``__spark_entry__`` adds them if it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import credentials, fingerprints, leaks, provenance, quantiles, sentences, syntax, tokens
from codestrata.session import read_table

FIELDS = ["scan_id", "source", "file", "line", "type", "description"]
PROBS = [0.5, 0.9, 0.99]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_files(read_table(spark, sf, "files")).select("file_id")


def p1_problems(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_files(read_table(spark, sf, "files"))


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(read_table(spark, sf, "files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.found_lines(read_table(spark, sf, "files"))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.scan(read_table(spark, sf, "files")).select("file_id", "n", "kinds", "redacted")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_hand_written(read_table(spark, sf, "files")).select("file_id")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_hand_written(read_table(spark, sf, "files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    fields = fingerprints.finding_fields(read_table(spark, sf, "findings"))
    return fingerprints.copies(fields, "ord", FIELDS).select(F.col("first").alias("ord_a"), F.col("other").alias("ord_b"))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    fields = fingerprints.finding_fields(read_table(spark, sf, "findings"))
    out = fingerprints.distinct_records(fields, "ord", FIELDS)
    return out.select(F.col("first").alias("ord"), "n_copies", *FIELDS)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = read_table(spark, sf, "runs")
    return quantiles.measurements(runs, ["corpus", "stage"], {"total_ms": F.col("total_ms"), "nova_ms": F.col("engine_ms.nova")}, F.col("started_at"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = read_table(spark, sf, "scores")
    return quantiles.measurements(scores, ["tool"], {"duration_ms": F.col("duration_ms")}, F.col("scored_at"), positive=False)


def p7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.radix_percentiles(_runs(spark, sf), ["corpus", "stage"], PROBS, p7_daily(spark, sf))


def p7_scores(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.radix_percentiles(_scores(spark, sf), ["tool"], PROBS, p7_scores_daily(spark, sf))


def p7_daily(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.daily_histograms(_runs(spark, sf), ["corpus", "stage"]).withColumn("day", F.col("day").cast("string"))


def p7_daily_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.percentiles(p7_daily(spark, sf), ["corpus", "stage"], PROBS)


def p7_scores_daily(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.daily_histograms(_scores(spark, sf), ["tool"]).withColumn("day", F.col("day").cast("string"))


def p7_scores_daily_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.percentiles(p7_scores_daily(spark, sf), ["tool"], PROBS)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(read_table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).where("kind = 'verbatim'").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_problems": p1_problems,
        "p1_rates": p1_rates,
        "p2_found": p2_found,
        "p2_redacted": p2_redacted,
        "p5_found": p5_found,
        "p5_classes": p5_classes,
        "p6_found": p6_found,
        "p6_records": p6_records,
        "p7_percentiles": p7_percentiles,
        "p7_scores": p7_scores,
        "p7_daily": p7_daily,
        "p7_daily_percentiles": p7_daily_percentiles,
        "p7_scores_daily": p7_scores_daily,
        "p7_scores_daily_percentiles": p7_scores_daily_percentiles,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p10_found": p10_found,
    }


_FINDINGS = r"""
with f as (
  select ord, scan_id, source,
    regexp_replace(lower(coalesce(coalesce(file, json_extract_string(payload, '$.file')), '')), '[^\p{L}\p{N}]+', '', 'g') as file,
    coalesce(line, try_cast(trim(json_extract_string(payload, '$.line')) as integer), 0) as line,
    regexp_replace(lower(coalesce(coalesce(type, json_extract_string(payload, '$.type')), '')), '[^\p{L}\p{N}]+', '', 'g') as type,
    regexp_replace(lower(coalesce(coalesce(description, json_extract_string(payload, '$.description')), '')), '[^\p{L}\p{N}]+', '', 'g') as description
  from findings)
"""

_RANKED = """
, r as (select *, row_number() over (partition by {g}, metric order by v) as rn, count(*) over (partition by {g}, metric) as n from m)
, q as (select unnest([0.5::double, 0.9::double, 0.99::double]) as p)
select {g}, metric, p, v as value, n, 0.0::double as error_bound
from r, q where rn = greatest(1, ceil(round(p * n, 9))::bigint)
"""


#: Exponent and leading 32 bits of a positive double, by exact powers of two.
_BITS = """
, x as (select *, case when v <= 0 then 0 else floor(log2(v)) end as e0 from m)
, b as (select *, case when v <= 0 then 0 when pow(2.0, e0) > v then e0 - 1 when pow(2.0, e0 + 1) <= v then e0 + 1 else e0 end as e from x)
, k as (select *, case when v <= 0 then 0 else ((e + 1023) * 1048576 + floor((v / pow(2.0, e) - 1.0) * 1048576))::bigint end as prefix from b)
"""
_DAILY = _BITS + "select {g}, metric, day, prefix, count(*) as n from k group by all"
_DAILY_RANKED = (
    _BITS
    + """
, r as (select *, row_number() over (partition by {g}, metric order by v) as rn, count(*) over (partition by {g}, metric) as total from k)
, q as (select unnest([0.5::double, 0.9::double, 0.99::double]) as p)
select {g}, metric, p, case when v <= 0 then 0.0 else floor(v / pow(2.0, e - 20)) * pow(2.0, e - 20) end as value, total as n,
  case when v <= 0 then 4294967295 * pow(2.0, -537) * pow(2.0, -537) else pow(2.0, e - 52) * 4294967295 end as error_bound
from r, q where rn = greatest(1, ceil(round(p * total, 9))::bigint)
"""
)


#: Words of a text: characters of the scripts without spaces stand alone, all else that is no letter or digit separates.
_WORDS = f"regexp_extract_all(regexp_replace(lower(text), '([{leaks._SINGLE}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def oracle_sql() -> dict[str, str]:
    runs = """with m as (
      select corpus, stage, 'total_ms' as metric, total_ms as v, started_at::date::varchar as day from runs
      where total_ms > 0 and not isnan(total_ms) and not isinf(total_ms)
      union all
      select corpus, stage, 'nova_ms', engine_ms.nova, started_at::date::varchar from runs
      where engine_ms.nova > 0 and not isnan(engine_ms.nova) and not isinf(engine_ms.nova))"""
    scores = "with m as (select tool, 'duration_ms' as metric, duration_ms::double as v, scored_at::date::varchar as day from scores where duration_ms >= 0)"
    return {
        "p6_found": _FINDINGS
        + """, g as (select *, min(ord) over (partition by scan_id, source, file, line, type, description) as a from f)
        select a as ord_a, ord as ord_b from g where a <> ord""",
        "p6_records": _FINDINGS
        + """select min(ord) as ord, count(*) as n_copies, scan_id::varchar as scan_id, source, file, line::varchar as line, type, description
        from f group by all""",
        "p9_found": f"""with d as (select doc_id, {_WORDS} as w from documents where text is not null), i as (select item_id, {_WORDS} as w from eval_items where text is not null),
          dg as (select doc_id, array_to_string(list_slice(w, k, k + 19), ' ') as g from (select *, unnest(range(1, greatest(len(w) - 18, 1))) as k from d)),
          ig as (select distinct item_id, array_to_string(list_slice(w, k, k + 19), ' ') as g from (select *, unnest(range(1, greatest(len(w) - 18, 1))) as k from i))
        select distinct doc_id, item_id from dg join ig using (g)""",
        "p7_percentiles": runs + _RANKED.format(g="corpus, stage"),
        "p7_scores": scores + _RANKED.format(g="tool"),
        "p7_daily": runs + _DAILY.format(g="corpus, stage"),
        "p7_scores_daily": scores + _DAILY.format(g="tool"),
        "p7_daily_percentiles": runs + _DAILY_RANKED.format(g="corpus, stage"),
        "p7_scores_daily_percentiles": scores + _DAILY_RANKED.format(g="tool"),
    }
