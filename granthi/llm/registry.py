"""The queries of this subpackage and their SQL, where SQL can express them."""

from . import bpe, chat, dedup, fim, lm, media, packing, pii, quality, similarity, spelling, tokencount, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_lm_score": lm.op2_lm_score,
    "op3_quality": quality.op3_quality,
    "op4_jaccard_join": similarity.op4_jaccard_join,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_media": media.op6_media,
    "op7_pii": pii.op7_pii,
    "op8_exact_dedup": dedup.op8_exact_dedup,
    "op9_chat_format": chat.op9_chat_format,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_warc": warc.op11_warc,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
SQL = {"op8_exact_dedup": dedup.SQL, "op9_chat_format": chat.SQL, "op11_warc": warc.SQL, "op12_spelling_variants": spelling.SQL, "op13_fill_in_middle": fim.SQL}
