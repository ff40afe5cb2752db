"""Patterns and tables shared by the Spark code and the SQL oracle.

Every regex here is written in the common subset of java.util.regex (Spark)
and RE2 (DuckDB): no look-around, no back-references, and whitespace spelled
out instead of `\\s` (Java's `\\s` includes \\x0B, RE2's does not).
"""

# ASCII whitespace, identical in Java and RE2.
WS = r"[ \t\n\x0B\f\r]"
WS_RUN = WS + "+"
NOT_WS = r"[^ \t\n\x0B\f\r]"

# Portable word tokenizer: a run of letters/digits, or one other non-blank symbol.
WORD_RE = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"

# Syllable = one vowel group (at least one per word).
VOWEL_RE = r"[aeiouyàâäéèêëîïôöùûü]+"

# A vowel group, or a whole word without one (Java alone: the SQL counts word by word).
_NO_VOWEL = r"[^aeiouyàâäéèêëîïôöùûü \t\n\x0B\f\r]"
SYLLABLE_RE = rf"{VOWEL_RE}|(?<!{NOT_WS}){_NO_VOWEL}++(?!{NOT_WS})"

# Sentence terminator run, used by the readability formulas.
SENT_END_RE = r"[.!?]+"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# M2 annotation line: start, end, (type), replacement.
M2_EDIT_RE = r"^A (\d+) (\d+)\|\|\|[^|]*\|\|\|([^|]*)\|\|\|"
# Replacement text meaning "delete the span".
M2_DELETE_MARKERS = ("", "-NONE-")
# Explicit no-op annotation for a sentence without edits (annotator appended).
M2_NOOP_PREFIX = "A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||"

# Punctuation normalisation (one-to-one, so character offsets are preserved):
# each character of PUNCT_FROM maps to the character at the same place in PUNCT_TO.
PUNCT_FROM = "’´‘′`“”˝¨„『』–—―¬、，：；？！\u0650\u200b"
PUNCT_TO = "'''''\"\"\"\"\"\"\"----,,:;?!  "

# Local-model prompt templates and answer markers.
GRAMMAR_PROMPT_PREFIX = "Correct this text: "
GRAMMAR_MARKER = "Corrected:"
READABILITY_PROMPT_PREFIX = "Simplify this text to make it shorter and easier to read: "
READABILITY_MARKER = "Simplified:"
END_OF_TEXT = "<|endoftext|>"

# Chat prompts for hosted models (system, user template with {input_text}).
GRAMMAR_SYSTEM_PROMPT = """You are an expert grammar correction assistant. Your task is to correct grammatical errors in the provided text while preserving the original meaning and style as much as possible. 

Guidelines:
- Fix spelling mistakes, grammatical errors, and punctuation issues
- Maintain the original tone and intent of the text
- Do not add new information or change the meaning
- Keep corrections minimal and focused on errors only
- Return ONLY the corrected text without explanations or commentary
"""
GRAMMAR_USER_TEMPLATE = """Correct the grammatical errors in the following text:

{input_text}

Corrected text:"""
READABILITY_SYSTEM_PROMPT = """You are an expert text simplification assistant. Your task is to simplify complex text to make it more readable and accessible while preserving the core meaning.

Guidelines:
- Use simpler vocabulary and shorter sentences
- Break down complex ideas into clearer statements
- Remove unnecessary jargon and replace with everyday language
- Maintain factual accuracy and key information
- Aim for clarity and conciseness
- Return ONLY the simplified text without explanations or commentary
"""
READABILITY_USER_TEMPLATE = """Simplify the following text to make it more readable and accessible:

{input_text}

Simplified text:"""

# Personal-data patterns for masking (no \b: word boundaries differ between engines).
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"
POSTCODE_RE = r"[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}"

# Token-chunking and encoding defaults.
CHUNK_MAX_LENGTH = 512
CHUNK_STRIDE = 256
CHUNK_MIN_TOKENS = 5
PAD_TOKEN_ID = 50256

# Over-length guard and output budget for simplification.
OVERLONG_RATIO = 1.5
BUDGET_WORD_FACTOR = 0.8
BUDGET_TOKENS_PER_WORD = 1.3
BUDGET_CAP = 60

# Flesch formulas.
FRE_BASE, FRE_WPS, FRE_SPW = 206.835, 1.015, 84.6
FKGL_WPS, FKGL_SPW, FKGL_BASE = 0.39, 11.8, 15.59

# F-beta for edit scores.
EDIT_BETA = 0.5
