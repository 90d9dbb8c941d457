"""Parameters of the registered queries, shared by both of their forms."""

DATASET_START, DATASET_END = "2024-01", "2031-01"
POST_VALUE = "MentalHealth"
EVENT_VALUES = "Click, error ,view"
LINE_VALUE = "i"
MONTH_START, MONTH_END = "2024-02", "2024-04"
TOP_FILES = 5
MAX_DEPTH = 1
SEED = 42
CUSTOM_STOPWORDS = ["", "post", "see", "Share"]
BAYES_SMOOTHING = 1e-7
FOREST = {"trees": [100], "depth": [20], "min_split": [2], "min_leaf": [1]}
MACHINE = {"c": [1.0], "tol": [1e-3], "iterations": [1000]}
FOLDS = 10
