"""The subpackage's queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, lexical, neardup, packing, passages, phrases, quality, suffixes, tokens, toxicity, urls, vectors, warc

QUERIES = {"op1_packing": packing.op1_packing, "op2_urls": urls.op2_urls, "op3_quality": quality.op3_quality, "op4_neardup": neardup.op4_neardup, "op5_tokens": tokens.op5_tokens, "op6_suffixes": suffixes.op6_suffixes, "op7_decontamination": decontamination.op7_decontamination, "op8_passages": passages.op8_passages, "op9_toxicity": toxicity.op9_toxicity, "op10_warc": warc.op10_warc, "op11_phrases": phrases.op11_phrases, "op12_vectors": vectors.op12_vectors, "op13_lexical": lexical.op13_lexical, "quality_measures": quality.quality_measures}
ORACLES = {"op2_urls": urls.SQL, "op4_neardup": neardup.SQL, "op7_decontamination": decontamination.SQL, "op8_passages": passages.SQL, "op10_warc": warc.SQL, "op11_phrases": phrases.SQL, "op12_vectors": vectors.SQL, "op13_lexical": lexical.SQL, "quality_measures": quality.SQL}
