import numpy as np

SAMPLES = "sample_id bigint, label int, bands array<double>"


def samples(spark, x, y, start=0):
    """A sample table from a matrix and labels."""
    rows = [(start + i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SAMPLES)


def blobs(classes=3, per_class=30, d=4, gap=5.0, seed=0, codes=None):
    rng = np.random.RandomState(seed)
    x = np.concatenate([rng.normal(size=(per_class, d)) + gap * c for c in range(classes)])
    y = np.repeat(codes if codes else np.arange(1, classes + 1), per_class)
    return x, y


def pairs(spark, label, prediction):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(label, prediction)], "label int, prediction int")


def cells(spark, matrix, first=1):
    rows = [(i + first, j + first, int(n)) for i, r in enumerate(matrix) for j, n in enumerate(r)]
    return spark.createDataFrame(rows, "label int, prediction int, n bigint")


def labels(spark, counts):
    rows = [(int(c),) for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "label int")
