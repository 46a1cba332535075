"""Registry of the corpus queries and of the SQL that states their results, where SQL can."""

from __future__ import annotations

from curatrix.llm import decontaminate, jpeg, manifest, mixing, packing, pages, pseudonyms, quality, secrets, simhash, substring, toxicity, trie


def queries() -> dict:
    return {
        "op1_low_discrepancy_mix": mixing.op1_low_discrepancy_mix,
        "op2_template_decontamination": decontaminate.op2_template_decontamination,
        "op3_progressive_jpeg": jpeg.op3_progressive_jpeg,
        "op4_recurrent_toxicity": toxicity.op4_recurrent_toxicity,
        "op5_byte_convolution": quality.op5_byte_convolution,
        "op6_feistel_pseudonyms": pseudonyms.op6_feistel_pseudonyms,
        "op7_character_convolution": secrets.op7_character_convolution,
        "op8_block_tree": pages.op8_block_tree,
        "op9_difference_cover": substring.op9_difference_cover,
        "op10_simhash_pigeonring": simhash.op10_simhash_pigeonring,
        "op11_postorder_manifest": manifest.op11_postorder_manifest,
        "op12_large_item_packing": packing.op12_large_item_packing,
        "op13_block_trie": trie.op13_block_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_low_discrepancy_mix": mixing.OP1_SQL,
        "op2_template_decontamination": decontaminate.OP2_SQL,
        "op9_difference_cover": substring.OP9_SQL,
        "op11_postorder_manifest": manifest.OP11_SQL,
        "op13_block_trie": trie.OP13_SQL,
    }
