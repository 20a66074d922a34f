"""The numbered queries of this folder and their SQL."""

from __future__ import annotations

from candlewick.llm import alignment, bpe, counts, divergence, langid, licenses, media, merkle, packing, quality, simhash, substring, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_langid": langid.op3_langid,
    "op4_media": media.op4_media,
    "op5_substring": substring.op5_substring,
    "op6_quality": quality.op6_quality,
    "op7_urls": urls.op7_urls,
    "op8_packing": packing.op8_packing,
    "op9_merkle_fingerprint": merkle.op9_merkle_fingerprint,
    "op10_counts": counts.op10_counts,
    "op11_divergence": divergence.op11_divergence,
    "op12_alignment": alignment.op12_alignment,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES = {
    "op5_substring": substring.ORACLE,
    "op9_merkle_fingerprint": merkle.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_licenses": licenses.ORACLE,
}
