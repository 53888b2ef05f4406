"""Scalar functions of the dialect as column expressions."""

from chronolith.functions.scalars import asset_class, cosine, cosine_to, hash_bucket, null_concat, round_half_up, safe_divide, sample_std, sample_var, strftime

__all__ = ["asset_class", "cosine", "cosine_to", "hash_bucket", "null_concat", "round_half_up", "safe_divide", "sample_std", "sample_var", "strftime"]
