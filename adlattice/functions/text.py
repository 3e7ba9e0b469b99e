"""String helpers over names and free text."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from adlattice import vocab


def layer_role(name: Column) -> Column:
    """Role by the first matching prefix of the bare, lower-case layer name: one pattern, matched once per name."""
    prefix = F.regexp_extract(F.lower(name), rf"^[\[\] \t]*({'|'.join(re.escape(p) for p, _ in vocab.LAYER_PREFIXES)})", 1)
    roles = F.create_map(*[F.lit(v) for pair in vocab.LAYER_PREFIXES for v in pair])
    return F.coalesce(F.try_element_at(roles, prefix), F.lit("unknown"))


def safe_name(name: Column) -> Column:
    """Everything but word characters (of any script) and hyphens becomes an underscore."""
    return F.regexp_replace(name, r"(?U)[^\w-]", "_")


def analysis_key(file_hash: Column, x: Column, y: Column, w: Column, h: Column, model: Column) -> Column:
    """Cache key of a layer analysis: file, crop box, analysis version and model."""
    return F.sha2(F.concat_ws(":", file_hash, x, y, w, h, F.lit(vocab.ANALYSIS_VERSION), model), 256)


def segment_key(content: Column, prompts: Column, min_confidence: Column) -> Column:
    """Cache key of a segmentation: 32 hex digits over image bytes, prompts and threshold text."""
    return F.substring(F.sha2(F.concat(content, prompts.cast("binary"), min_confidence.cast("binary")), 256), 1, 32)
