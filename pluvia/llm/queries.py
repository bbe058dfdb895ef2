"""Queries of the corpus operators, and their SQL where SQL can express them."""

from pluvia.llm import cuckoo, decontaminate, mixing, phrases, quality, ranked, repeats, secrets, simhash, tokens, topk, toxicity, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality": quality.op2_quality,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_warc": warc.op8_warc,
    "op9_near_duplicates": simhash.op9_near_duplicates,
    "op10_repeats": repeats.op10_repeats,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_exact_dedup": cuckoo.op12_exact_dedup,
    "op13_collocations": phrases.op13_collocations,
}

ORACLE_SQL = {
    "op5_decontaminate": decontaminate.ORACLE_OP5,
    "op6_exact_topk": topk.ORACLE_OP6,
    "op7_mix_sources": mixing.ORACLE_OP7,
    "op8_warc": warc.ORACLE_OP8,
    "op11_ranked_search": ranked.ORACLE_OP11,
    "op12_exact_dedup": cuckoo.ORACLE_OP12,
    "op13_collocations": phrases.ORACLE_OP13,
}
