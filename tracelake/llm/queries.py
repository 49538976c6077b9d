"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, divergence_audit, embedding_dedup, fill_in_middle, license_scan, minhash_dedup, mixing, pii, suffix_dedup, token_output, toxicity, warc

from .common import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *_base_columns(), pii.joined("spans").alias("spans"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3, which SQL can express."""
    return pii.spotted(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *_base_columns())


def _base_columns() -> list[F.Column]:
    return [*(pii.counted("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")), F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256")]


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets of op5, which SQL can express."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(mixing.word_count()).alias("source_size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    found = F.coalesce(F.transform("found", lambda f: f.label), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p.label), found)))
    return out.select("doc_id", *_place_columns(), F.array_join(labels, ",").alias("labels"), "score")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7, which SQL can express."""
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", *_place_columns())


def _place_columns() -> list[F.Column]:
    starts = F.transform("places", lambda p: p.start)
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    return [F.col("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(labels, ",").alias("base_labels")]


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    responses = warc.read_archives(spark, folder).where("record_type = 'response'").withColumn("payload_length", F.octet_length("content").cast("long"))
    revisits = warc.read_archives(spark, folder, content=False).where("record_type = 'revisit'")
    return responses.drop("content").unionByName(revisits.drop("content")).select(
        F.col("page_id").try_cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (toxicity.part_of() == 2).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted, stored and read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    chats = saved(chat_format.format_chats(turns), "chats").withColumn("formatted", chat_format.formatted(F.col("segments")))
    back = chat_format.read_back(chats, F.col("formatted")).withColumn("trained", F.array_join(chat_format.trained(F.col("segments")), ""))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "first_error",
    )


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("fim_text"), F.col("fim_form"))
    return out.select("doc_id", F.col("n_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_decontamination, op2_suffix_dedup, op3_pii, op4_embedding_dedup, op5_mixing, op6_minhash_dedup, op7_license_scan, op8_token_output, op9_warc, op10_toxicity, op11_chat_format, op12_divergence_audit, op13_fill_in_middle, pii_base_spans, mix_targets, license_base)
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
