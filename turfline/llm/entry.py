"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from turfline.llm import align, chosen_path, credentials, imatch, language, merkle, metric_tree, mixing, nearest, oracles, pieces, private, quality, suffixes


def queries() -> dict[str, Callable]:
    return {
        "op1_jaccard": chosen_path.op1_jaccard,
        "op2_imatch": imatch.op2_imatch,
        "op3_quality": quality.op3_quality,
        "op4_mix": mixing.op4_mix,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_nearest": nearest.op6_nearest,
        "op7_suffixes": suffixes.op7_suffixes,
        "op8_private": private.op8_private,
        "op9_secrets": credentials.op9_secrets,
        "op10_language_id": language.op10_language_id,
        "op11_merkle": merkle.op11_merkle,
        "op12_top_products": metric_tree.op12_top_products,
        "op13_align": align.op13_align,
    }


def oracle_sql() -> dict[str, str]:
    """The others need trained models, tokenizers or Spark's hashes; tests compare them with brute force."""
    return {"op11_merkle": oracles.merkle_sql(), "op12_top_products": oracles.products_sql()}
