"""Queries of the training-data operators with their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import byte_bpe, chat_format, crf_langid, dart_minhash, decontamination, exact_dedup, kd_sharding, license_scan, line_dedup, quality_cnn

QUERIES = {
    "op1_crf_langid": crf_langid.op1_crf_langid,
    "pipeline": corpus_pipeline.run,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_decontaminate": decontamination.op4_decontaminate,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_dart_minhash": dart_minhash.op6_dart_minhash,
    "op7_kd_sharding": kd_sharding.op7_kd_sharding,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_quality_classifier": quality_cnn.op9_quality_classifier,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op3_chat_format": chat_format.ORACLE,
    "op4_decontaminate": decontamination.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
