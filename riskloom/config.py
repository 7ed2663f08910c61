"""Domains, thresholds, word lists and defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: domains -------------------------------------------------
DOMAIN_NAMES = {
    "medicine": "Medicine",
    "math": "Math",
    "finance": "Finance",
    "is_agents": "IS",
    "psychology": "Psychology",
}
DOMAINS = list(DOMAIN_NAMES.values())


@dataclass(frozen=True)
class DatasetSpec:
    """Where a domain's raw table keeps its columns."""

    key: str
    prompt_column: str
    answer_column: str
    documents_column: str | None = None
    has_labels: bool = False
    label_column: str = "hallucination_label"
    extra_columns: tuple[str, ...] = ()

    @property
    def domain(self) -> str:
        return DOMAIN_NAMES[self.key]


# --- fixed values: column map per dataset ----------------------------------
DATASETS = {
    "medicine": DatasetSpec("medicine", "question", "correct_answer",
                            extra_columns=("options", "correct_index")),
    "math": DatasetSpec("math", "question", "answer"),
    "finance": DatasetSpec("finance", "question", "answer", documents_column="context"),
    "is_agents": DatasetSpec("is_agents", "question", "answer", documents_column="documents"),
    "psychology": DatasetSpec("psychology", "Question", "Best Answer"),
}

SEED = 42
TRAIN_RATIO = 0.8
MIN_ROWS_PER_DOMAIN = 500
MIN_ROWS_PER_DOMAIN_MODEL = 50

# --- fixed values: labelling -----------------------------------------------
MATH_TOLERANCE = 1e-6
FINANCE_TOLERANCE = 0.05
FINANCE_TEXT_THRESHOLD = 0.35
MEDICAL_TEXT_THRESHOLD = 0.30
MEDICAL_MAX_CONTAINED_WORDS = 5
SEMANTIC_THRESHOLD = 0.7
WORD_OVERLAP_THRESHOLD = 0.5
GROUNDED_THRESHOLD = 0.45

UNITS = (
    ("trillion", 1e12),
    ("billion", 1e9),
    ("million", 1e6),
    ("thousand", 1e3),
    ("bn", 1e9),
    ("mn", 1e6),
    ("k", 1e3),
)
PROMPT_UNITS = (
    ("usd millions", "million"),
    ("usd million", "million"),
    ("in millions", "million"),
    ("usd billions", "billion"),
    ("usd billion", "billion"),
    ("in billions", "billion"),
    ("in thousands", "thousand"),
    ("usd thousands", "thousand"),
)
QUALITATIVE_MARKS = ("yes", "no", "because", "due to", "primarily", "evident from")
QUALITATIVE_LENGTH = 50

FINANCE_STOPWORDS = [
    "the", "a", "an", "is", "was", "are", "were", "be", "been", "to", "of", "and", "in", "for", "on", "with",
]
GROUNDED_STOPWORDS = [
    "the", "a", "an", "is", "was", "are", "were", "be", "been", "being", "to", "of", "and", "in", "for", "on", "with",
    "at", "by", "from", "that", "this", "it", "its", "as", "or", "but", "not", "no", "so", "if", "has", "had", "have",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "shall", "there", "their", "they",
    "them", "he", "she", "him", "her", "his", "we", "us", "our", "you", "your", "i", "me", "my", "which", "who",
    "whom", "what", "when", "where", "how", "than", "then", "also", "just", "about",
]

# --- fixed values: features ------------------------------------------------
ENTITY_TYPES = ["PERSON", "ORG", "GPE", "LOC", "PRODUCT", "EVENT"]
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who", "which"]
COMMON_ENTITIES = [
    "usa", "us", "united states", "america", "europe", "china",
    "google", "apple", "microsoft", "amazon", "facebook",
    "new york", "london", "paris", "tokyo",
    "john", "mary", "david", "sarah",
]
RARITY_SMOOTHING = 1.0
RARE_FREQUENCY = 0.25
CLUSTER_SIMILARITY = 0.7
LOG_FLOOR = 1e-10

METADATA_COLUMNS = ["prompt_id", "domain", "ground_truth", "primary_response",
                    "split", "hallucination_label"]
EPISTEMIC_COLUMNS = [
    "semantic_entropy", "num_semantic_clusters", "avg_cluster_size",
    "semantic_energy", "mean_logprob", "min_logprob", "std_logprob",
    "naive_max_prob", "naive_perplexity", "naive_top_k_entropy",
]
MCQ_COLUMNS = [
    "mcq_letter_consistency", "mcq_num_unique_letters", "mcq_parseable_ratio",
    "mcq_mode_letter_count", "mcq_letter_entropy",
    "mcq_first_token_logprob", "mcq_first_token_prob",
]
CONTEXT_COLUMNS = (
    ["avg_entity_rarity", "max_entity_rarity", "min_entity_rarity",
     "num_entities", "num_rare_entities"]
    + [f"entity_type_{t}" for t in ENTITY_TYPES]
    + ["token_count", "unique_token_ratio", "avg_word_length", "lexical_diversity"]
    + [f"qtype_{w}" for w in QUESTION_WORDS + ["other"]]
)
DOMAIN_COLUMNS = [f"domain_{d}" for d in DOMAINS]

# --- fixed values: sampling and evaluation ---------------------------------
@dataclass(frozen=True)
class SamplingSpec:
    n_samples: int = 5
    low: float = 0.7
    high: float = 1.0
    max_tokens: int = 1024
    top_p: float = 0.95
    logprobs: int = 5


@dataclass(frozen=True)
class BoosterSpec:
    """Boosted-tree defaults and the tuning ranges."""

    max_depth: int = 3
    step_size: float = 0.05
    n_trees: int = 100
    subsample: float = 0.8
    column_sample: float = 0.8
    min_child: int = 3
    gamma: float = 0.5
    weight_multiplier: float = 1.0
    ranges: dict = field(default_factory=lambda: {
        "max_depth": (4, 10),
        "step_size": (0.01, 0.1),
        "n_trees": (100, 300),
        "min_child": (1, 5),
        "subsample": (0.7, 0.9),
        "column_sample": (0.7, 0.9),
        "gamma": (0.0, 5.0),
    })


K_BEST = 15
SWEEP = (0.3, 0.35, 0.4, 0.45, 0.5)
ARC_POINTS = 20
ARC_MAX_REJECTION = 0.5
ECE_BINS = 10
VARIATION_FLAG = 0.3
SEMANTIC_GAIN = 0.05
SPLIT_GAP_POINTS = 5.0
