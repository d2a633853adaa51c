"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.llm import filter_audit, spaced_seeds
from spanloom.session import table


def op1_suffix_tree_lm(spark, sf_dir):
    from spanloom.llm.suffix_tree_lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op2_min_bin_slack(spark, sf_dir):
    import public_tokenizers

    from spanloom.llm.bin_packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op3_compression_bands(spark, sf_dir):
    from spanloom.llm.compression_bands import judge

    return judge(table(spark, sf_dir, "documents"))


def op4_relative_lz(spark, sf_dir):
    from spanloom.llm.relative_lz import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_line_neighbourhood(spark, sf_dir):
    from spanloom.llm.line_neighbourhood import digest, drop_near_lines

    return digest(drop_near_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_spaced_seeds(spark, sf_dir):
    from spanloom.llm.spaced_seeds import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_pivots(spark, sf_dir):
    from spanloom.llm.simhash_pivots import hex_digits, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op8_quality_qda(spark, sf_dir):
    from spanloom.llm.quality_qda import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_bitmask(spark, sf_dir):
    from spanloom.llm.language_bitmask import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    from spanloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_block_lanczos(spark, sf_dir):
    """deviation is null where it does not fit a long (some three million rows of unit vectors); deviation_exact has it."""
    from spanloom.llm.whitening import whiten

    exact = F.col("deviation")
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation_exact", exact).withColumn("deviation", exact.try_cast("long"))


def op12_additive_quantisation(spark, sf_dir):
    from spanloom.llm.additive_quantisation import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op13_bitmap_audit(spark, sf_dir):
    from spanloom.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffix_tree_lm, op2_min_bin_slack, op3_compression_bands, op4_relative_lz, op5_line_neighbourhood, op6_spaced_seeds, op7_simhash_pivots, op8_quality_qda, op9_language_bitmask, op10_warc, op11_block_lanczos, op12_additive_quantisation, op13_bitmap_audit)}
ORACLE_SQL: dict[str, str] = {"op6_spaced_seeds": spaced_seeds.oracle(), "op13_bitmap_audit": filter_audit.ORACLE}
