"""The registered queries of the operators: thin digests over what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, pii, quality, runs, sentencepiece_scan, sharding, simhash, substring_dedup, warc, whitening
from .chat_sql import OP3
from .common import Scratch, crc_of_id
from .quality_sql import OP9
from .substring_sql import OP4
from .warc_sql import OP1


#: The vocabulary that is read; another path can be given.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.new_path("archives")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    page_id = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), "page-id: (-?[0-9]*)", 1)
    # Archives are read once; of the payloads, which were digested in that reading, only metadata's are kept.
    records = scratch.write(warc.read_records(spark, path).withColumn("payload", F.when(F.col("type") == "metadata", F.col("payload"))))
    captures = scratch.write(
        warc.assemble(records).select(
            "capture_id", F.when(page_id != "", page_id.cast("long")).alias("page_id"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest"
        )
    )
    first = captures.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    revisits = captures.where("type = 'revisit'").join(first, "refers_to", "left").select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of").alias("refers_to"))
    responses = captures.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionAll(revisits)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(table(spark, sf_dir, "documents"), crc_of_id("doc_id") % 7 == 2)
    return out.withColumnRenamed("id", "doc_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionAll(spark.sql(f"select * from values (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}')"))
    out = chat.render(chat.fold_events(chat.conversation_events(rows)))
    read = out.withColumns({"read": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    whole = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = lambda k: F.array_sort(F.array_distinct(F.transform(k, lambda m: m["item_id"])))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), items("matches").alias("item_ids"), F.size("matches").cast("long").alias("n_matches"), items("short_matches").alias("short_item_ids"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.minimax_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    out = sentencepiece_scan.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file, round_trip="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 3 == 1
    profiles = langid.learn_profiles(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base_spans", "term_spans")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("term_spans").cast("long").alias("n_terms"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    return out.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = runs.find_runs(docs.withColumn("text", runs.with_planted_runs(F.col("text"), crc_of_id("doc_id"))))
    best = lambda k: F.col(f"best_run.{k}").alias(k)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    milli = F.expr("best_run.length * 1000 div best_run.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"), milli, F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_lm_score": op2_lm_score,
    "op3_chat_format": op3_chat_format,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_pii": op11_pii,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1,
    "op3_chat_format": OP3,
    "op4_substring_dedup": OP4,
    "op9_quality_rules": OP9,
}
