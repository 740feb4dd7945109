"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from . import decontaminate, filter_audit, hard_negatives, language, license_scan, line_dedup, media, mixing, near_dedup, secrets, suffix_dedup, token_counts, toxicity
from .common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return language.identify_language(table(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.op10(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mine_digest(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark, sf_dir):
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_near_dedup, op4_suffix_dedup, op5_token_counts, op6_language, op7_media_columns, op8_mixing, op9_line_dedup, op10_secret_scan, op11_hard_negatives, op12_license_scan, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.oracle(), "op11_hard_negatives": hard_negatives.oracle(), "op12_license_scan": license_scan.oracle(), "op13_filter_audit": filter_audit.oracle()}
