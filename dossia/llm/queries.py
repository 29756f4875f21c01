"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossia.llm import chat, decontaminate, interactions, jaccard, licenses, packing, periods, pii, quality, shards, suffixes, tokens, warc

END = "<|im_end|><|im_start|>assistant ok"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleaved_shards(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.periodic_runs(periods.with_planted_periods(table(spark, sf_dir, "documents"))))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scans": op2_license_scans,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii": op13_pii,
}

ORACLE: dict[str, str] = {
    "op2_license_scans": licenses.oracle(),
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        s as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as top from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < top then top end as refers_to
        from s""",
    "op10_chat_formatting": f"""
        with t as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '{END}' union all select -1, 1, 'assistant', '{END}'),
        e as (select *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as esc from t)
        select conv_id, count(*)::bigint as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(length(role) + length(esc) + {len("<|im_start|>") + len("<|im_end|>") + 2})::bigint as formatted_chars
        from e group by conv_id""",
    "op11_filter_interactions": interactions.oracle(),
}
