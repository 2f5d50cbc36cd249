"""Registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquery.functions.keys import point_sim_id
from terraquery.llm import mixing, packing, quantiles, tokens, truncation
from terraquery.session import written

NODATA = -9999.0
#: Where the registered queries find the public tokenizers.
TOKENIZERS = "/opt/tokenizers"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


# 2 - percentiles of very large numeric columns

PROBS = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}
SCOPES = {"sim": ["sim_id"], "sim_day": ["sim_id", "day"], "day": ["day"], "all": []}


def _days(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    good = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < F.lit(float("inf"))) & (t != NODATA)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("time_millis") / 86400000).cast("int"))
    return spark.read.parquet(f"{sf}/geosim_point_data.parquet").where(good).select(point_sim_id(F.col("sim_id")).alias("sim_id"), day.alias("day"), "t")


def daily_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of t per normalised sim_id and UTC day: the rows to keep and combine."""
    return quantiles.sketch(_days(spark, sf), ["sim_id", "day"], "t")


def _percentiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    return quantiles.quantiles(rows, keys, list(PROBS.values()), names=list(PROBS))


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per sim_id over all days, per sim_id and day, per day, and of everything."""
    return _percentiles(quantiles.sketch(_days(spark, sf), ["sim_id", "day"], "t", scopes=SCOPES), ["scope", "sim_id", "day"])


def p2_span(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of a quarter, combined from the kept sketches of its single days."""
    days = written(daily_sketches(spark, sf)).where("day between date'2024-05-01' and date'2024-07-31'")
    return _percentiles(quantiles.merge(days, ["sim_id"]), ["sim_id"])


def p2_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per sim_id and day without rank error: of groups in counters, from their rows."""
    keys = ["sim_id", "day"]
    found = written(_percentiles(daily_sketches(spark, sf), keys))
    sure, large = found.where("rank_error = 0").drop("rank_error"), found.where("rank_error > 0").select(*keys)
    if large.isEmpty():
        return sure
    rows = quantiles.of_groups(_days(spark, sf), large, keys)
    return sure.unionByName(quantiles.exact(rows, keys, "t", list(PROBS.values()), names=list(PROBS)))


# 6 - filling fixed-capacity containers


def p6_packing(spark: SparkSession, sf: str) -> DataFrame:
    words = written(tokens.token_words(_docs(spark, sf), TOKENIZERS))
    return packing.pack(words, TOKENIZERS)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    df = written(p6_packing(spark, sf))
    return df.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"), F.first("fill").alias("fill"))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each document is in the containers once and whole, and none of these is too full."""
    words = written(tokens.token_words(_docs(spark, sf), TOKENIZERS))
    df = written(packing.pack(words, TOKENIZERS))
    full = df.groupBy("container").agg(F.sum("size").alias("used"))
    rows = df.join(full, "container").groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"), F.max("used").alias("used"))
    sound = (F.col("size") == F.col("tokens")) & (F.col("last") + 1 == F.col("parts")) & (F.col("parts") == F.ceil(F.col("tokens") / packing.CAPACITY)) & (F.col("used") <= packing.CAPACITY)
    return rows.join(words.select("doc_id", "tokens"), "doc_id").select("doc_id", sound.alias("sound"))


# 7 - mixing sources to target weights


def _sized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf).withColumn("source", truncation.source_name(F.col("source")))
    items = written(tokens.token_counts(docs, TOKENIZERS, keep=("source",)))
    targets = spark.read.parquet(f"{sf}/source_weight.parquet")
    return items, targets.select(truncation.source_name(F.col("source")).alias("source"), "target_share", "max_repeats")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(*_sized(spark, sf))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    items, targets = _sized(spark, sf)
    return mixing.shares(items, targets, written(mixing.mixture(items, targets)))


def p7_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source keeps to its repetitions, and to its target unless it is used up.

    The sources that are not used up are served to one level; each may lag by a document.
    """
    items, targets = _sized(spark, sf)
    s = written(mixing.shares(items, targets, written(mixing.mixture(items, targets))))
    used_up = (F.col("draws") == F.col("documents") * F.col("max_repeats")) | (F.col("target_share") == 0)
    level = s.where(~used_up).agg(F.max(F.col("tokens") / F.col("target_share"))).first()[0] or 0.0
    largest = items.groupBy("source").agg(F.max("tokens").alias("largest"))
    lag = F.lit(level) * F.col("target_share") - F.col("tokens")
    kept = (F.col("copies") <= F.col("max_repeats")) & (used_up | (lag <= F.col("largest")))
    return s.join(largest, "source", "left").select("source", "target_share", "max_repeats", "documents", kept.alias("kept"))


# 8 - text cut off by field limits


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    ends = written(truncation.endings(_docs(spark, sf)))
    return truncation.flag_truncated(ends, written(truncation.cut_lengths(ends)))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf).where("truncated").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(_docs(spark, sf), _flagged(spark, sf))


def p8_lengths(spark: SparkSession, sf: str) -> DataFrame:
    found = truncation.cut_lengths(written(truncation.endings(_docs(spark, sf))))
    return found.select("source", "unit", "length", "n", F.round("hazard", 6).alias("hazard"), F.round("expected", 4).alias("expected"))


def p8_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts were found by a significant length, and how many by what else."""
    return _flagged(spark, sf).where("truncated").groupBy("source", "why").agg(F.count(F.lit(1)).alias("texts"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_span, p2_days, p6_packing, p6_containers, p6_documents, p7_mixture, p7_shares, p7_limits, p8_found, p8_rates, p8_lengths, p8_reasons)}

_SIM = "regexp_replace(regexp_replace(sim_id,'^[\\x00-\\x20]+|[\\x00-\\x20]+$','','g'),'^([0-9]+)\\.0+$','\\1')"
_PICKED = ", ".join(f"max(t) filter (rk = greatest(ceil({q}::double*n - 1e-9), 1)) {c}" for c, q in PROBS.items())
_HALF = {c: f"pow(2, floor(log2(abs({c}))) - 21)" for c in PROBS}
_MIDDLE = ", ".join(f"sign({c})*(floor(abs({c})/(2*{h}))*2*{h} + {h}) {c}" for c, h in _HALF.items())


def _round_sql(peak: str, source: str) -> str:
    """One round of the length tests over ``source``, whose column ``peak`` marks what is left out of the neighbours."""
    return f"""(with a as (select source, unit, length, n, at_risk,
   sum(case when {peak} then 0 else n end) over near - case when {peak} then 0 else n end around,
   128 - (sum(case when {peak} then 1 else 0 end) over near - case when {peak} then 1 else 0 end) lengths
  from {source} window near as (partition by source, unit order by length range between 64 preceding and 64 following)),
 e as (select *, at_risk*(around+0.5::double)/(lengths/2.0::double*(2*at_risk-n)+1) expected from a),
 q as (select *, case when n>expected then exp(n-expected-n*ln(n/expected)) else 1 end p from e),
 r as (select *, row_number() over (partition by source, unit order by p, length) rk, count(*) over (partition by source, unit) m from q)
 select source, unit, length, n, at_risk, expected, coalesce(rk <= max(case when p <= 0.01::double*rk/m then rk end) over (partition by source, unit), false) peak from r)"""


_CORE = "regexp_replace(regexp_replace(text,'\\n[_=-]{20,}\\n(?:[^\\n]+\\n?){1,3}\\s*$',''),'\\s*(\\[[^\\[\\]\\n]+\\]|\\([^()\\n]+\\)|\\.\\.\\.|…)\\s*$','')"
ORACLES: dict[str, str] = {
    "p6_documents": "select doc_id, true sound from documents where text <> ''",
    "p7_limits": """with d as (select coalesce(lower(trim(source)),'') source, count(*) filter (text <> '') documents from documents group by 1),
 t as (select coalesce(lower(trim(source)),'') source, target_share, max_repeats from source_weight)
select coalesce(t.source, d.source) source, coalesce(target_share,0) target_share, coalesce(max_repeats,0)::int max_repeats, coalesce(documents,0) documents, true kept from t full join d on t.source=d.source""",
    "p8_lengths": f"""with t as (select distinct coalesce(lower(trim(source)),'') source, {_CORE} core from documents where text is not null and not regexp_full_match(text,'\\s*')),
 u as (select source, 'chars' unit, length(core)::int length from t union all select source, 'bytes', strlen(core)::int from t),
 h as (select source, unit, length, count(*) n from u group by all),
 h0 as (select *, sum(n) over (partition by source, unit order by length rows between current row and unbounded following)::bigint at_risk, false peak from h),
 h1 as (select * from {_round_sql("peak", "h0")}), h2 as (select * from {_round_sql("peak", "h1")})
select source, unit, length, n, round(n/at_risk, 6) hazard, round(expected, 4) expected from h2 where peak""",
    "p2_days": f"""with v as (select {_SIM} sim_id, cast(make_timestamp(time_millis*1000) as date) "day", t from geosim_point_data where t is not null and isfinite(t) and t <> -9999),
 r as (select *, row_number() over (partition by sim_id, "day" order by t) rk, count(*) over (partition by sim_id, "day") n from v),
 g as (select sim_id, "day", any_value(n) n, {_PICKED} from r group by 1, 2)
select sim_id, "day", n, {_MIDDLE}, greatest({", ".join(_HALF.values())}) value_error from g""",
}
