"""Column -> Column functions."""

from redline.functions.prompts import chat_messages, marker, prompt, training_text
from redline.functions.readability import (
    flesch_kincaid_grade,
    flesch_reading_ease,
    readability_parts,
    sentence_count,
    syllable_count,
)
from redline.functions.text import (
    clean_spaced_hyphens,
    dataset_name,
    exact_match,
    extract_answer,
    first_reference,
    html_text,
    mask_patterns,
    model_slug,
    normalize_punct,
    normalize_ws,
    route_doc_type,
    strip,
    token_budget,
    truncate_overlong,
    with_fallback,
    word_count,
    words,
)
from redline.functions.tokens import multiset_overlap, ngrams, tokens

__all__ = [name for name in dir() if not name.startswith("_")]
