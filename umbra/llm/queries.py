"""The queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from umbra.llm import alignment, bpe, collocations, decontaminate, html_text, media, mixing, near_dedup, ppm, sharding, substrings, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_dart_minhash,
        decontaminate.op2_fm_index,
        token_files.op3_packed_token_files,
        ppm.op4_ppm,
        substrings.op5_prefix_free_parsing,
        sharding.op6_consistent_ring,
        html_text.op7_crf_main_text,
        toxicity.op8_boosted_toxicity,
        bpe.op9_forced_split_bpe,
        media.op10_mpeg_audio,
        collocations.op11_phrase_collocations,
        mixing.op12_source_mix,
        alignment.op13_token_alignment,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_fm_index": decontaminate.SQL, "op11_phrase_collocations": collocations.SQL, "op12_source_mix": mixing.SQL}
