"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lm, merkle, negatives, oracles, packing, pii, quality, secrets, simhash, substrings, token_files, toxicity
from .shared import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket(n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, bucket(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))



def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.encode(documents(spark, sf_dir), tokenizer()))




def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm.score_documents(docs, bucket(5) != 1).select("doc_id", (bucket(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", "hits.items_sha256", "hits.contaminated")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined(F.filter("secrets", lambda s: s["kind"] != "novel"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"), of("novel"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    return q.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in counts], failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.select("doc_id", "text", "lang"), bucket(3) != 1)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (bucket(3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by_7 = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 7 == 0
    relabelled = rows.withColumn("label", F.when(by_7, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(negatives.prepared(relabelled), F.col("id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(bucket(3).eqNullSafe(0) & F.col("doc_id").isNotNull(), merkle.leaf(text=F.translate("text", capitals, capitals.lower())))
    leaves = documents(spark, sf_dir).select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("key"), merkle.leaf().alias("leaf"), tampered.alias("tampered"))
    m = merkle.plant(written(leaves, "merkle-hashed"))
    if m is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    proved = merkle.prove(m)
    root, proof = F.lit(m.root), F.col("proof")
    out = proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(merkle.siblings(proof), 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), proof).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit(docs)).select("doc_id", "personal")
    of = lambda kind: F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined(F.filter("personal", lambda s: ~s["kind"].startswith("lstm_")))
    return found.select("doc_id", *[of(k) for k in pii.BASE], F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("personal")).alias("spans"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_lm_score, op4_decontamination, op5_secrets, op6_quality_rules, op7_language_id, op8_simhash, op9_packing, op10_substring_dedup, op11_hard_negatives, op12_merkle_manifest, op13_pii)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
