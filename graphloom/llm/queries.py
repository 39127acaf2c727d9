"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm.common import table


def op1_pii(spark, sf_dir):
    from graphloom.llm import pii

    return pii.digest(pii.find(table(spark, sf_dir, "documents")), *(f"n_{k}" for k in pii.BASE))


def op2_suffix_dedup(spark, sf_dir):
    from graphloom.llm.suffixdedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_fingerprints(spark, sf_dir):
    from graphloom.llm.parsing import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    from graphloom.llm.linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_warc(spark, sf_dir):
    from graphloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_best_fit_packing(spark, sf_dir):
    from graphloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    from graphloom.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark, sf_dir):
    from graphloom.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark, sf_dir):
    from graphloom.llm import pii, secretscan

    return pii.digest(secretscan.find(table(spark, sf_dir, "documents")), *(f"n_{k}" for k in secretscan.BASE))


def op10_decontamination(spark, sf_dir):
    from graphloom.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_fingerprints, op4_line_dedup, op5_warc, op6_best_fit_packing, op7_simhash, op8_toxicity, op9_secrets, op10_decontamination)}
