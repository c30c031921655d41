"""They must equal the published behaviour for right results."""

# Texts that stand for a missing value in delimited files.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

# What counts as an integer or a number in text.
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
NUMBER_PATTERN = (
    r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
)

# Role rules of the feature profile.
MAX_CATEGORIES = 255
MAX_CATEGORY_SHARE = 0.2
MIN_FILL_RATE = 0.6

# Provider defaults.
MAX_QUERIES_PER_SECOND = 100
PROVIDER_DEFAULTS = {
    "queries_per_second": 20, "n_connections": 100, "n_retry": 3,
    "retry_wait_time": 3, "timeout": 10.0,
}

# Training defaults.
DEFAULT_SEED = 123456
TREE_DEFAULTS = {"stepSize": 0.01, "maxIter": 125, "minInstancesPerNode": 2, "maxLeaves": 50}
MAX_QUANTILES = 1000
DECILE_LABELS = (
    "1-10", "11-20", "21-30", "31-40", "41-50",
    "51-60", "61-70", "71-80", "81-90", "91-100",
)
