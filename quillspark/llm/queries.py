"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, itq, langid, licenses, lm_scoring, minmax, packing, suffix_dedup, tool_calls, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo divisor; null for a row without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def _held_out(divisor: int) -> Column:
    """Whether that remainder is 2; a row without a doc_id is learned from."""
    return F.coalesce(_remainder(divisor) == 2, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), _held_out(7))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    train = docs.where(~_held_out(4)).select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    out = toxicity.score(docs, toxicity.train(train.select("text", "toxic")))
    return out.select("doc_id", _held_out(4).alias("held_out"), "score", "predicted", "n_matches")


#: What the reply tool takes, for the calls read from conversations.
REPLY = {"reply": {"prompt": {"type": "string", "required": True, "min": 1, "max": 300}, "turn": {"type": "integer", "required": True, "min": 0, "max": 1000}}}


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call of the reply tool after the user turn before it; the assistant turn after it is its result. A turn
    without conversation or number has no identifier and is linked with nothing."""
    turns = _table(spark, sf_dir, "conversations")

    def name(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("after"), F.lit("reply").alias("name"), arguments.alias("arguments")
    )
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    out = tool_calls.link(calls, results, REPLY)
    return out.select("conv_id", "turn", "call_id", "depth", "n_calls", "n_results", "errors", "message")


_OP3_SQL = """
with calls as (
  select conv_id, turn, text, conv_id::varchar || ':' || turn::varchar as call_id
  from conversations where role = 'user'
), ids as (
  select distinct conv_id, turn, call_id from calls where call_id is not null
), chains as (
  select *, turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as island from ids
), depths as (
  select call_id, row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as depth from chains
), same as (
  select call_id, count(*) as n_calls from calls where call_id is not null group by 1
), answers as (
  select conv_id::varchar || ':' || (turn - 1)::varchar as call_id, count(*) as n_results, min(text) as result
  from conversations where role = 'assistant' and conv_id is not null and turn is not null group by 1
)
select c.conv_id, c.turn, c.call_id, d.depth::bigint as depth, s.n_calls::bigint as n_calls,
  coalesce(a.n_results, 0)::bigint as n_results,
  concat_ws(',', case when c.text is null then 'prompt:missing' when length(c.text) not between 1 and 300 then 'prompt:range' end,
    case when c.turn is null then 'turn:missing' when c.turn not between 0 and 1000 then 'turn:range' end) as errors,
  '{"arguments":{' || concat_ws(',', '"prompt":' || to_json(c.text)::varchar, '"turn":' || c.turn) || '}'
  || coalesce(',"call_id":' || to_json(c.call_id)::varchar, '') || coalesce(',"depth":' || d.depth, '') || ',"name":"reply"'
  || case when a.result is null then '' else ',"result":' || to_json(a.result)::varchar end || '}' as message
from calls c left join depths d on c.call_id = d.call_id left join same s on c.call_id = s.call_id left join answers a on c.call_id = a.call_id
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", capacity=2048)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs.where(~_held_out(4))))
    return out.select("doc_id", _held_out(4).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), span=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_tool_calls": op3_tool_calls,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op6_ppm_langid": op6_ppm_langid,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_itq_neardup": op9_itq_neardup,
    "op10_minmax_neardup": op10_minmax_neardup,
}

ORACLE_SQL: dict[str, str] = {"op3_tool_calls": _OP3_SQL}
