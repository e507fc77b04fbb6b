"""Values fixed from outside: results depend on them being exactly these."""

# The English stop words of pyspark.ml.feature.StopWordsRemover.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()

# Marks that never count as terms.
SPECIAL_TOKENS = [
    ",", ".", "(", ")", "'", "’", ";", ":", "!", "@", "#", "$", "%", "^", "&", "*", "-", "_",
    "+", "=", "[", "]", "}", "{", "<", ">", "/", "~", "``", "\\",
]

# The probability given to a term a corpus lacks (double machine epsilon).
EPSILON = 2.220446049250313e-16

# Profile limits and weights.
TOP_TERMS = 10_000
EMBED_MAX_WORDS = 4_000
EMBED_KEEP_CHARS = 4_000
PARSE_CHUNK_CHARS = 100_000
DEPENDENCY_LENGTH_WEIGHT = 0.7
TREE_DEPTH_WEIGHT = 0.3

# The prompt put before every text of a fine-tuning set.
INSTRUCTION = (
    "You are an expert at summarizing long articles. "
    "Proceed to summarize the following text: \n"
)

# Column names of the pair feature table.
PAIR_KEYS = ["da-type", "source", "target", "ft"]
DIFFICULTY = "learning_difficult"
DISTANCES = [
    "vocab-overlap",
    "tf-idf-overlap",
    "source_shannon_entropy",
    "target_shannon_entropy",
    "kl-divergence",
    "js-divergence",
    "contextual-overlap",
]
METRICS = [
    "rouge1", "rouge2", "rougeL", "bert_precision", "bert_recall", "bert_f1", "vocab_overlap",
    "Relevance", "Coherence", "Consistency", "Fluency", "fs_grounded",
]
DOMAIN_FEATURES = [
    "learning_difficult",
    "vocab-overlap",
    "kl-divergence",
    "js-divergence",
    "tf-idf-overlap",
    "source_shannon_entropy",
    "target_shannon_entropy",
]
BASELINE_METRICS = ["rouge1", "rouge2", "rougeL"]

# Adaptation types.
IN_DOMAIN = "in-domain-adapt"
SINGLE_DOMAIN = "single-domain-adapt"
NO_DOMAIN = "no-domain-adapt"

# Value range of every rescaled column, found by the first name part it contains.
VALUE_RANGES = {
    "bert": (-1, 1),
    "overlap": (0, 100),
    "entropy": (0, 100),
    "learning_difficult": (0, 100),
    "kl-divergence": (0, 100),
    "js-divergence": (0, 100),
    "Fluency": (1, 3),
    "Relevance": (1, 5),
    "Coherence": (1, 5),
    "Consistency": (1, 5),
}

# Metrics rescaled on either side (ROUGE and grounding scores are left alone).
RESCALED_METRICS = [
    "bert_precision", "bert_recall", "bert_f1", "vocab_overlap",
    "Relevance", "Coherence", "Consistency", "Fluency",
]

# Groups of metrics that the reduced feature set replaces by their mean.
METRIC_GROUPS = {
    "bert": ["bert_f1"],
    "rouge": ["rouge1", "rouge2", "rougeL"],
    "vocab_overlap_": ["vocab_overlap"],
    "llm_eval": ["Relevance", "Coherence", "Consistency", "Fluency"],
    "fs_grounded_": ["fs_grounded"],
}

# Settings of the models and of the sweep.
RIDGE_PENALTIES = (0.1, 1.0, 10.0)
LASSO_PATH_LENGTH = 100
LASSO_PATH_EPS = 1e-3
LASSO_FOLDS = 5
SCORE_FOLDS = 3
HOLDOUT_PERCENT = 33
VALIDATION_PERCENT = 10
BOOSTING_ROUNDS = 20
BOOSTING_FOLD_ROUNDS = 100
BOOSTING_DEPTH = 6
BOOSTING_STEP = 0.3
SWEEP_DOMAIN_COUNTS = (10, 11, 12, 13, 14)

# Columns that the design matrix of each mode leaves out (target scores, keys, means).
MEAN_COLUMNS = ["weighted_y_target", "weighted_y_source"]
REDUNDANT_COLUMNS = ["js-divergence", "vocab-overlap", "source_shannon_entropy"]
EXCLUDED = {
    "baseline-raw": [*MEAN_COLUMNS, "target", *[f"target_{m}" for m in BASELINE_METRICS]],
    "baseline-norm": [*MEAN_COLUMNS, "target", *[f"target_{m}" for m in BASELINE_METRICS]],
    "baseline-norm-red": [*MEAN_COLUMNS, *REDUNDANT_COLUMNS, "target", "rouge_target"],
    "all-raw": [*MEAN_COLUMNS, *PAIR_KEYS, "source_shannon_entropy", *[f"target_{m}" for m in METRICS]],
    "all-norm": [*MEAN_COLUMNS, *PAIR_KEYS, "source_shannon_entropy", *[f"target_{m}" for m in METRICS]],
    "all-red": [*MEAN_COLUMNS, *REDUNDANT_COLUMNS, "target", *[f"target_{g}" for g in METRIC_GROUPS]],
}
