"""Word lists, patterns, weights and default thresholds.

These are constants of the task.  Results only agree with other implementations when
they are exactly these, so they are stated here, together, and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: words -----------------------------------------------------------

STOP_WORDS = tuple(
    dict.fromkeys(
        """a about above after again against all am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further had has have
    having he her here hers herself him himself his how i if in into is it its itself just me more most my
    myself no nor not now of off on once only or other our ours ourselves out over own same she should so
    some such than that the their theirs them themselves then there these they this those through to too
    under until up very was we were what when where which while who whom why will with would you your
    yours yourself yourselves tell show give explain describe please list do does much many""".split()
    )
)

# Suffixes in the order they are tried; the last two of the "ie" family end in "y".
STEM_SUFFIXES = ("ingly", "edly", "ing", "ies", "ied", "ed", "es", "s", "ly")
STEM_TO_Y = ("ies", "ied")

# ---- fixed values: patterns --------------------------------------------------------

# Case-insensitive matching of a-z over Unicode text also accepts these four letters.
WORD_CHARS = "A-Za-z0-9İıſK"
TOKEN = rf"[{WORD_CHARS}]+(?:[._'\-][{WORD_CHARS}]+)*"
SENTENCE_START = r"[A-Z0-9\"'(\[]"
QUOTED_OR_CODE = (
    r'"[^"]{2,80}"'
    r"|\b[A-Z]{2,}[-_]?\d+\b"
    r"|\b\w*\d\w*[-_.]\w+\b"
    r"|\b[a-z]+_[a-z0-9_]+\b"
    r"|\b[a-z]+[A-Z][A-Za-z0-9]+\b"
    r"|\b\d{3,}\b"
)
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
RAW_WORD = r"[a-z0-9][a-z0-9\-]+"
KEYWORD = r"[A-Za-z0-9][\w\-\.]*"
ACRONYM = r"\(([A-Z]{2,8})\)"
OVERRIDE_TEXT = (
    r"(?i)(ignore (all |any )?(previous|prior|above) (instructions|prompts)|disregard (the )?(system|previous)|"
    r"you are now (a|an|in)|new instructions:|system prompt|reveal your (instructions|prompt)|"
    r"<\s*/?\s*(system|assistant)\s*>|act as (an? )?(unrestricted|jailbroken))"
)
SMALL_TALK = (
    r"(?i)^\s*(hi|hello|hey|hiya|yo|thanks|thank you|thx|ty|cheers|bye|goodbye|see you|"
    r"good (morning|afternoon|evening|night)|how are you|ok|okay|cool|great|nice|got it|"
    r"you'?re welcome|who are you|what can you do|help)\b[\s!.,?:)]*"
    r"(there|again|so much|a lot|bot)?[\s!.,?:)]*$"
)
GREETING = (
    r"(?i)^\s*(hi|hello|hey|thanks|thank you|good (morning|evening|afternoon)|how are you)\b[\s!.?]*$"
)
COMPARISON = r"\b(compare|difference|differ|versus|vs\.?|both|each)\b"
SECOND_QUESTION = (
    r"\band (also |then )?(what|how|which|who|when|where|why|is|are|does|do|can)\b"
)
QUESTION_BREAK = (
    r"(?i)\?|;|\band (?:also |then )?(?=(?:what|how|which|who|when|where|why|is|are|does|do|can)\b)"
)
RESEARCH_OPENING = (
    r"^(analy[sz]e|research|write a report|give (me )?an overview|summari[sz]e everything)"
)
RECENCY = r"\b(latest|today|current|right now|recent|news)\b"
NOT_FOUND_EXPECTED = r"(?i)\b(not (found|available|mentioned)|no information|unknown)\b"
ABSTAINED = r"(?i)(could not|couldn't|not able|no evidence|not find|unanswered)"
NUMBERED_HEADING = r"^(\d+(\.\d+)*\.?|[IVX]+\.|Chapter \d+|Section \d+)\s+\S"
LIST_LINE = r"^\s*([-*•]|\d+[.)])\s+"

# ---- fixed values: HTML elements that are no content, and those without an end tag ----

HTML_CHROME = frozenset("script style noscript nav footer header aside form svg iframe".split())
HTML_VOID = frozenset(
    """area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem
    meta nextid param source spacer track wbr""".split()
)

# ---- fixed values: file types ------------------------------------------------------

FILE_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".html": "text/html",
    ".htm": "text/html",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
}
MAX_FILE_BYTES = 50 * 1024 * 1024
TOKENS_PER_PAGE = 500

# ---- fixed values: weights and thresholds ------------------------------------------

BM25_K1 = 1.2
BM25_B = 0.75
FEEDBACK_WEIGHTS = {"explicit": 1.0, "copy": 0.5, "citation_click": 0.3, "rephrase": 0.7}
RETRIEVER_WEIGHTS = {"bm25": 1.0, "dense": 1.0, "exact": 0.8, "web": 0.6}
CLUSTER_SIMILARITY = 0.82
REPHRASE_SECONDS = 180
REPHRASE_JACCARD = 0.5
SUPPORTED_SHARE = 0.8
PASS_SCORE = 0.7
RECRAWL_MIN_SECONDS = 300
RECRAWL_MAX_SECONDS = 7 * 86400
RECRAWL_DEFAULT_SECONDS = 3600
FIX_RISK = {
    "augment_chunk": "low",
    "add_alias": "low",
    "rechunk_doc": "low",
    "recrawl_doc": "low",
    "set_tier": "low",
    "doc_boost": "medium",
    "gate_threshold": "medium",
    "improve_prompt": "high",
    "quarantine_doc": "high",
    "unquarantine_doc": "high",
    "content_gap": "high",
}
CONFIG_FIXES = ("add_alias", "doc_boost", "gate_threshold", "improve_prompt")
STAGED_FIXES = ("augment_chunk", "rechunk_doc")
# metric, good, acceptable, higher is better
OBJECTIVES = (
    ("verified_rate", 0.85, 0.6, True),
    ("groundedness", 0.9, 0.75, True),
    ("contradiction_rate", 0.02, 0.1, False),
    ("heal_success_rate", 0.7, 0.4, True),
    ("repeat_failure_rate", 0.1, 0.3, False),
    ("negative_signal_rate", 0.05, 0.15, False),
)


@dataclass(frozen=True)
class ChunkStrategy:
    name: str = "structured"
    target_tokens: int = 500
    max_tokens: int = 800
    min_tokens: int = 120
    overlap_tokens: int = 60


DEFAULT_STRATEGY = ChunkStrategy()
LARGE_STRATEGY = ChunkStrategy("structured-large", 900, 1400, 250, 120)


@dataclass(frozen=True)
class Tunables:
    """Defaults of every number an operator may be given."""

    gate_threshold: float = 0.3
    long_context_max_tokens: int = 200_000
    retrieve_k: int = 150
    stage1_k: int = 50
    final_k: int = 20
    generate_k: int = 12
    rrf_k: int = 60
    quality_prior_weight: float = 0.15
    helpfulness_prior_weight: float = 0.2
    max_chunks_per_doc: int = 6
    dedupe_jaccard: float = 0.9
    freshness_boost: float = 0.1
    min_groundedness: float = 0.9
    max_contradiction: float = 0.1
    min_coverage: float = 0.8
    canary_pct: float = 0.2
    canary_min_samples: int = 20
    eval_regression_tolerance: float = 0.02
    eval_golden_sample: int = 50
    fast_calls: int = 8
    standard_calls: int = 30
    deep_calls: int = 120
    fast_heal_rounds: int = 1
    standard_heal_rounds: int = 3
    standard_subquestions: int = 5


DEFAULTS = Tunables()
