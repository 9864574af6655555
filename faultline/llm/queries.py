"""The training-data queries, one for each operator, and the pipeline."""

from __future__ import annotations

from . import chat_windows, chunk_recipes, hyperminhash, merkle_manifest, pipeline, run_length_dedup, variant_groups, vector_dedup
from .chat_windows import op2_chat_windows
from .chunk_recipes import op11_chunk_recipes
from .hyperminhash import op8_hyperminhash
from .merkle_manifest import op13_merkle_manifest
from .pair_index_bpe import op3_pair_index_bpe
from .pu_quality import op5_pu_quality
from .run_length_dedup import op4_run_length_dedup
from .simhash_decontam import op7_simhash_decontam
from .token_store import op1_token_store
from .toxicity_gru import op9_toxicity_gru
from .variant_groups import op12_variant_groups
from .vector_dedup import op6_vector_dedup
from .weak_pii import op10_weak_pii


def queries() -> dict:
    return {
        "op1_token_store": op1_token_store,
        "op2_chat_windows": op2_chat_windows,
        "op3_pair_index_bpe": op3_pair_index_bpe,
        "op4_run_length_dedup": op4_run_length_dedup,
        "op5_pu_quality": op5_pu_quality,
        "op6_vector_dedup": op6_vector_dedup,
        "op7_simhash_decontam": op7_simhash_decontam,
        "op8_hyperminhash": op8_hyperminhash,
        "op9_toxicity_gru": op9_toxicity_gru,
        "op10_weak_pii": op10_weak_pii,
        "op11_chunk_recipes": op11_chunk_recipes,
        "op12_variant_groups": op12_variant_groups,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {
        "op2_chat_windows": chat_windows.ORACLE,
        "op4_run_length_dedup": run_length_dedup.ORACLE,
        "op6_vector_dedup": vector_dedup.ORACLE,
        "op8_hyperminhash": hyperminhash.ORACLE,
        "op11_chunk_recipes": chunk_recipes.ORACLE,
        "op12_variant_groups": variant_groups.ORACLE,
        "op13_merkle_manifest": merkle_manifest.ORACLE,
        "pipeline": pipeline.ORACLE_SQL,
    }
    return {k: v for k, v in known.items() if v}
