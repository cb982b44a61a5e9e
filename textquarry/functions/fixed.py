"""Lists, patterns and formats that results depend on. They must stay as they are."""

# Subject labels with the names that stand for each.
TOPIC_ALIASES = (
    ("turbofan engines", ("turbofan engines",)),
    ("navigation database", ("navigation database",)),
    ("weight and balance", ("weight and balance",)),
    ("airspeed and mach", ("airspeed and mach",)),
    ("energy management", ("energy management",)),
    ("flight director", ("flight director",)),
    ("ceo/neo distinction", ("ceo/neo distinction", "ceo and neo")),
    ("a320 family", ("a320 family",)),
    ("a321neo", ("a321neo",)),
    ("electrical system", ("electrical system",)),
    ("hydraulic system", ("hydraulic system",)),
    ("pneumatic system", ("pneumatic system",)),
    ("fuel system", ("fuel system",)),
    ("autopilot", ("autopilot",)),
    ("autothrust", ("autothrust",)),
    ("anti-ice", ("anti-ice",)),
    ("fmgs", ("fmgs",)),
    ("mcdu", ("mcdu",)),
    ("fcu", ("fcu",)),
    ("fma", ("fma",)),
    ("ils", ("ils",)),
    ("sidestick", ("sidestick",)),
    ("fly-by-wire", ("fly-by-wire",)),
    ("sids and stars", ("sids and stars",)),
    ("rnav and rnp", ("rnav and rnp", "rnav/rnp")),
    ("dispatch", ("dispatch",)),
    ("lift and drag", ("lift and drag",)),
    ("pressurization", ("pressurization",)),
)
UNKNOWN_TOPIC = "<unknown>"

# Wording that is counted as boilerplate, by label; in any case, `.` up to a line's end.
BOILERPLATE = (
    ("generic training context", r"in this training context, during .*? where the learner is focusing on .*? while checking .*?\."),
    ("simulator caveat", r"a simulator can help explore the relationship, but its default behavior is not automatically an approved real-aircraft procedure\."),
    ("configuration caveat", r"exact behavior depends on aircraft standard, software, engine option, database, operator procedure, and the current flight condition\."),
    ("learning-angle label", r"the learning angle here is [^.]+\."),
    ("training-variation label", r"training variation \d+:"),
    ("scenario scaffolding", r"scenario: imagine a study example .*? the trainee observes unexpected behavior involving .*?\."),
)

# Words that carry no information of their own.
STOPWORDS = tuple(
    """
    a an and are as at be because by can could does for from has have how i if
    in is it its keep more not of on or should so that the their them then
    this to was what when where which while why with would you your
    """.split()
)
GENERIC_WORDS = tuple(
    """
    user assistant scenario imagine study training variation context learner
    focusing checking question answer angle perspective explanation beginner
    useful understand think reason aircraft state otherwise unchanged expected
    observed result concept learned memorizing general principle exact
    configuration software standard procedure modeled model system topic
    """.split()
)
INFORMATIVE_WORD = "[a-zA-Z][a-zA-Z'-]{2,}"
LOW_INFORMATION = 12

# How the records of a preamble begin.
PREAMBLE_PREFIXES = (
    "this is an educational language-model corpus",
    "it is not an fcom",
    "the source corpus was cleaned",
    "public source basis:",
)

# Template slots in order, and what stands for each. TOPICS marks the step that masks topics.
TOPICS = object()
SLOTS = (
    (r"training variation\s+\d+:\s*[^.]+\.", "training variation <variation>."),
    (r"in this training context, during [^,]+, where the learner is focusing on [^,]+ while checking [^.]+\.", "in this training context, <context>."),
    (r"from (?:a|the) [^?.,]+ perspective", "from <perspective>"),
    (r"from the angle of [^?.,]+", "from the angle of <angle>"),
    (r"during [a-z][^?.,]+? study", "during <study> study"),
    (r"after a small configuration change — exercise \d+", "after <change>"),
    (r"exercise \d+", "exercise <num>"),
    (TOPICS, "<topic>"),
    (r"\b\d+\b", "<num>"),
)
VARIATION = r"training variation\s+\d+:\s*(.+)"
ASSISTANT_SPAN = r"Assistant:\s*(.*?)(?=\s+(?:User|Scenario):|$)"
SHINGLE_WORDS, NEAR_DUPLICATE = 5, 0.85
TOP_SENTENCES, REPEATED_SENTENCE = 30, 20

# Splits, seeds and sizes.
SPLIT_SEED, TRAIN_RATIO, VALIDATION_RATIO, TEST_RATIO = 1337, 0.90, 0.05, 0.05
INSTRUCTION_VALIDATION_RATIO = 0.2
SPLITS = ("train", "validation", "test")

# The subword vocabulary.
BYTES, EOS_ID, PAD_ID, SPECIALS = 256, 256, 257, 2
EOS, PAD, USER, ASSISTANT, END = "<|eos|>", "<|pad|>", "<|user|>", "<|assistant|>", "<|end|>"
VOCABULARY, SAMPLE_BYTES, LONGEST_PHRASE, LEAST_COUNT, REGION_BYTES = 4096, 4_000_000, 12, 2, 256

# Formats and identifiers of artifacts.
REPORT_FORMAT, FAMILIES_FORMAT = "corpus-quality-report-v1", "corpus-family-manifest-v1"
DATASET_FORMAT, TOKENIZER_FORMATS = "document-split-v2", ("byte-subword-v1", "byte-subword-v2")
INSTRUCTION_FORMAT, TOKENIZER_ALGORITHM = "instruction-dataset-v1", "byte-subword-frequency-v1"
UNSUPERVISED = -100

# Words that anchor a sentence of an answer; a sentence needs as many words to be judged.
ANCHORS = ("check", "monitor", "approved", "procedure", "depends", "configuration")
JUDGED_WORDS = 6
DIMENSIONS = ("relevance", "factual_correctness", "completeness", "hallucination", "question_following")

# Evaluation windows and the behavioural benchmark.
FIXED_FORMAT, BEHAVIORAL_FORMAT = "fixed-evaluation-v1", "a320-behavioral-benchmark-v1"
BEHAVIORAL_CATEGORIES = (
    "factual",
    "why",
    "how",
    "comparisons",
    "troubleshooting",
    "system_explanations",
    "mcdu_fmgs",
    "fcu_fma",
    "flight_phases",
    "performance",
    "simulator_scenarios",
)
PROHIBITED_USES = (
    "tokenizer_training",
    "model_training",
    "hyperparameter_selection",
    "checkpoint_selection",
    "prompt_engineering",
    "instruction_fine_tuning_decisions",
)
