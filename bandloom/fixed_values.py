"""Constants, word lists and tables that results depend on.

Everything here is data, stated plainly and in natural order.
"""

# Raster conventions.
NODATA_DEFAULT = -9999
NO_CONFIDENCE = -1
UNLABELLED = 0
CLASS_BYTE_MAX = 255
CLASS_COUNT_MIN = 0
CLASS_COUNT_MAX = 10_000

# Replacements for non-finite band values.
NAN_FILL = 0.0
POS_INF_FILL = 1e10
NEG_INF_FILL = -1e10

# Imbalance handling.
RATIO_CLASS_WEIGHTS = 2.0
RATIO_SMOTE = 5.0
SMOTE_TRIGGER = 1.5
SMOTE_NEIGHBORS = 5

# Fast mode of the parameter search.
FAST_SAMPLES = 20_000
FAST_RATIO = 50
FAST_MIN_CLASS = 30
FAST_FOLDS = 2
FAST_SUBSET = 15_000
FAST_TRIALS = 25
DEFAULT_FOLDS = 3
DEFAULT_TRIALS = 100

# Boosting search shrinks on large or very uneven data.
SMALL_GRID_SAMPLES = 30_000
SMALL_GRID_RATIO = 100

# Gaussian classifier.
MIN_EIGENVALUE = 1e-6
TINY = 1e-10
CONDITION_FLOOR = 1e-15
SINGLE_SAMPLE_VARIANCE = 1e-6

# Attribution limits.
SHAP_SAMPLES = 1000
SHAP_BACKGROUND = 100

# Report thresholds.
ACCURACY_EXCELLENT = 0.90
ACCURACY_GOOD = 0.80
ACCURACY_MEDIUM = 0.70
ACCURACY_FAIR = 0.60
LOW_ACCURACY = 0.60
LOW_SUPPORT = 10
BALANCE_CLOSE = 5.0
BALANCE_MODERATE = 10.0
SUPPORT_RATIO_SEVERE = 10
SUPPORT_RATIO_MODERATE = 5

# Confidence bands.
CONFIDENCE_LOW = 0.5
CONFIDENCE_HIGH = 0.8
CONFIDENCE_BINS = 20
PERCENT_SCALE_ABOVE = 1.5

# Training data checks.
QUALITY_SMALL_DATASET = 50
QUALITY_RATIO_CRITICAL = 50
QUALITY_RATIO_WARNING = 10
QUALITY_RATIO_INFO = 3
QUALITY_CLASS_CRITICAL = 10
QUALITY_CLASS_WARNING = 30
QUALITY_INVALID_PERCENT = 10
QUALITY_DUPLICATE_PERCENT = 5
QUALITY_SPATIAL_FEATURES = 10

# Split preview warnings.
PREVIEW_RATIO = 10
PREVIEW_MIN_TEST = 5

# Sensor names by file name pattern; the first sensor that matches wins.
SENSOR_PATTERNS = {
    "sentinel2": [r"sentinel[\-_]?2", r"s2[a-z]?[\-_]", r"_t\d{2}[a-z]{3}_"],
    "landsat8": [r"landsat[\-_]?8", r"lc08", r"lo8", r"_b\d{1,2}\.tif"],
    "landsat9": [r"landsat[\-_]?9", r"lc09", r"lo9"],
    "planet": [r"planet", r"_analytic"],
    "modis": [r"mod\d{2}[a-z]\d", r"myd\d{2}[a-z]\d"],
    "spot": [r"spot[\-_]?\d"],
}

# Land cover by file name pattern; the first match wins.
LANDCOVER_PATTERNS = {
    "agriculture": [r"crop", r"agri", r"farm", r"field"],
    "forest": [r"forest", r"tree", r"wood", r"canopy"],
    "urban": [r"urban", r"city", r"built", r"settlement"],
    "water": [r"water", r"lake", r"river", r"ocean", r"coast"],
    "wetland": [r"wetland", r"marsh", r"swamp"],
}

# Keywords reported as hints when a file name contains them.
HINT_KEYWORDS = [
    "sentinel",
    "landsat",
    "planet",
    "modis",
    "spot",
    "crop",
    "agriculture",
    "forest",
    "urban",
    "water",
    "rgb",
    "multispectral",
    "hyperspectral",
    "ndvi",
    "classified",
    "ortho",
]
LANDSAT_CODES = ["lc08", "lc09", "lo8", "lo9"]
SENTINEL_CODE = "s2"

# Recipe words that fit a land cover.
LANDCOVER_RECIPE_WORDS = {
    "agriculture": ["crop", "agri", "farm"],
    "forest": ["forest", "tree", "vegetation"],
    "urban": ["urban", "city", "built"],
    "water": ["water", "aquatic"],
}
FAST_CLASSIFIERS = ["RF", "ET", "XGB"]
SLOW_CLASSIFIERS = ["SVM", "MLP"]

# Match levels of a recipe score, highest first.
SCORE_LEVELS = [
    (95, "Excellent match"),
    (80, "Good match"),
    (60, "Possible match"),
    (40, "Low confidence"),
]
SCORE_LOWEST = "Not recommended"

# Output names spell these codes out.
CODE_LABELS = {"XGB": "XGBoost", "CB": "CatBoost"}
DEFAULT_CODE = "CLASS"
MASK_SUFFIX = "_mask"
OUTPUT_PREFIX = "classified_"

# Feature tags of a recipe: flag in the extra settings, tag.
RECIPE_TAGS = [
    ("USE_OPTUNA", "Optuna"),
    ("COMPUTE_SHAP", "SHAP"),
    ("USE_SMOTE", "SMOTE"),
    ("USE_CLASS_WEIGHTS", "Class weights"),
    ("USE_NESTED_CV", "Nested CV"),
]

# Recipe document, schema version 2.
RECIPE_SCHEMA_VERSION = 2
RECIPE_LEGACY_VERSION = 1
RECIPE_SECTIONS = {
    "provenance": '{"source":"local","author":"","created_at":"","updated_at":""}',
    "constraints": '{"offline_compatible":true,"requires_gpu":false}',
    "compat": '{"min_plugin_version":"","max_plugin_version":""}',
}
RECIPE_TEXT_DEFAULTS = {
    "expected_runtime_class": "medium",
    "expected_accuracy_class": "high",
    "dataset_fingerprint": "",
    "signature": "",
}

# Classifiers: code, name, gives probabilities, tuned by search, attributable, takes class weights.
CLASSIFIERS = [
    ("GMM", "Gaussian Mixture Model", True, False, False, False),
    ("RF", "Random Forest", True, True, True, True),
    ("SVM", "Support Vector Machine", True, True, True, True),
    ("KNN", "K-Nearest Neighbors", True, True, True, False),
    ("XGB", "XGBoost", True, True, True, True),
    ("CB", "CatBoost", True, True, True, True),
    ("ET", "Extra Trees", True, True, True, True),
    ("GBC", "Gradient Boosting Classifier", True, True, True, True),
    ("LR", "Logistic Regression", True, True, True, True),
    ("NB", "Gaussian Naive Bayes", True, False, True, False),
    ("MLP", "Multi-layer Perceptron", True, True, True, False),
]

# Default search grids.
DEFAULT_GRIDS = {
    "GMM": {"tau": [0.0]},
    "SVM": {"gamma": [0.25, 0.5, 1.0, 2.0, 4.0], "C": [0.1, 1.0, 10.0, 100.0]},
    "KNN": {"n_neighbors": [1, 3, 10]},
    "XGB": {"n_estimators": [100], "max_depth": [9], "learning_rate": [0.01]},
    "CB": {
        "iterations": [100, 300],
        "depth": [4, 6, 8],
        "learning_rate": [0.01, 0.1, 0.2],
        "l2_leaf_reg": [1, 3, 5],
    },
    "GBC": {"n_estimators": [50, 200], "max_depth": [3, 7], "learning_rate": [0.01, 0.2]},
    "LR": {"C": [0.01, 1.0, 100.0], "solver": ["liblinear", "lbfgs"]},
    "NB": {"var_smoothing": [1e-9, 1e-6, 1e-3]},
    "MLP": {
        "hidden_layer_sizes": [(50,), (100, 50)],
        "alpha": [0.0001, 0.01],
        "learning_rate_init": [0.001, 0.01],
    },
}
SMALL_CB_GRID = {
    "iterations": [100, 200],
    "depth": [4, 6],
    "learning_rate": [0.05, 0.1],
    "l2_leaf_reg": [3],
}
# Trees of the forests; feature counts step through 1..d by d/3 or d/2.
FOREST_TREES = {"RF": [100], "ET": [50, 200]}
FOREST_STEP_PARTS = {"RF": 3, "ET": 2}
MLP_FAST_GRID = {"hidden_layer_sizes": [(50,)], "alpha": [0.0001], "learning_rate_init": [0.001]}

# Random search spaces: ("int", low, high, step), ("float", low, high), ("log", low, high), ("choice", values).
SEARCH_SPACES = {
    "RF": {
        "n_estimators": ("int", 50, 500, 50),
        "max_depth": ("int", 3, 30, 1),
        "min_samples_split": ("int", 2, 20, 1),
        "min_samples_leaf": ("int", 1, 10, 1),
        "max_features": ("choice", ["sqrt", "log2", None]),
    },
    "SVM": {
        "C": ("log", 0.1, 100.0),
        "gamma_type": ("choice", ["fixed", "float"]),
        "gamma": ("choice", ["scale", "auto"]),
        "gamma_value": ("log", 0.001, 1.0),
        "kernel": ("choice", ["rbf", "poly", "sigmoid"]),
    },
    "KNN": {
        "n_neighbors": ("int", 1, 30, 1),
        "weights": ("choice", ["uniform", "distance"]),
        "algorithm": ("choice", ["auto", "ball_tree", "kd_tree", "brute"]),
        "leaf_size": ("int", 10, 50, 1),
    },
    "XGB": {
        "n_estimators": ("int", 50, 500, 50),
        "max_depth": ("int", 3, 15, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
        "gamma": ("float", 0.0, 5.0),
        "min_child_weight": ("int", 1, 10, 1),
    },
    "CB": {
        "iterations": ("int", 50, 500, 50),
        "depth": ("int", 4, 10, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "l2_leaf_reg": ("float", 1.0, 10.0),
    },
    "ET": {
        "n_estimators": ("int", 50, 500, 50),
        "max_depth": ("int", 3, 30, 1),
        "min_samples_split": ("int", 2, 20, 1),
        "min_samples_leaf": ("int", 1, 10, 1),
        "max_features": ("choice", ["sqrt", "log2", None]),
    },
    "GBC": {
        "n_estimators": ("int", 50, 500, 50),
        "max_depth": ("int", 3, 15, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.6, 1.0),
        "min_samples_split": ("int", 2, 20, 1),
        "min_samples_leaf": ("int", 1, 10, 1),
    },
    "LR": {
        "C": ("log", 0.001, 100.0),
        "penalty": ("choice", ["l1", "l2", "elasticnet", None]),
        "solver": ("choice", ["lbfgs", "liblinear", "saga"]),
        "max_iter": ("int", 100, 1000, 100),
    },
    "MLP": {
        "n_layers": ("int", 1, 3, 1),
        "layer_size": ("int", 50, 300, 50),
        "activation": ("choice", ["relu", "tanh", "logistic"]),
        "alpha": ("log", 0.0001, 0.1),
        "learning_rate": ("choice", ["constant", "adaptive"]),
        "max_iter": ("int", 200, 1000, 100),
    },
    "NB": {"var_smoothing": ("log", 1e-10, 1e-6)},
}
