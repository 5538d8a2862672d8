"""The registered queries of the subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from wardlight.llm import decontaminate, exact_dedup, hmm_lm, merkle, mixing, mixture_langid, near_dedup, pii, ranked_search, set_join, token_rollup, toxicity, warc

QUERIES = {
    "op1_toxicity_channel": toxicity.query,
    "op2_latent_decontamination": decontaminate.query,
    "op3_warc_boundary_chain": warc.query,
    "op4_order_minhash": near_dedup.query,
    "op5_token_rollup": token_rollup.query,
    "op6_pii_weak_supervision": pii.query,
    "op7_mixture_language": mixture_langid.query,
    "op8_hmm_score": hmm_lm.query,
    "op9_sainte_lague_mix": mixing.query,
    "op10_patricia_exact_dedup": exact_dedup.query,
    "op11_pointer_jumping_merkle": merkle.query,
    "op12_universe_set_join": set_join.query,
    "op13_nra_search": ranked_search.query,
}

ORACLES = {"op3_warc_boundary_chain": warc.ORACLE, "op10_patricia_exact_dedup": exact_dedup.ORACLE, "op11_pointer_jumping_merkle": merkle.ORACLE, "op12_universe_set_join": set_join.ORACLE, "op13_nra_search": ranked_search.ORACLE}
