import numpy as np

ROWS = "row_key string, block_id int, u bigint, label int, x array<double>"


def block_rows(spark, n_blocks=3, n=120, dim=3, seed=0, labels=2):
    """Random labelled vectors; block 0 holds twice the rows of the others."""
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(n_blocks):
        m = n * 2 if b == 0 else n
        x = rng.normal(size=(m, dim))
        score = x @ np.arange(1, dim + 1) + rng.normal(scale=0.5, size=m)
        y = np.digitize(score, np.quantile(score, np.arange(1, labels) / labels))
        u = rng.choice(1 << 60, size=m, replace=False)
        rows += [(f"{b}-{i}", b, int(u[i]), int(y[i]), [float(v) for v in x[i]]) for i in range(m)]
    return spark.createDataFrame(rows, ROWS), rows


def arrays(rows, block=None):
    mine = [r for r in rows if block is None or r[1] == block]
    return np.array([r[4] for r in mine]), np.array([r[3] for r in mine]), np.array([r[2] for r in mine])
