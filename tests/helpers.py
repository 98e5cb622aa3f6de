import numpy as np


def dense(cells, n, re="re", im="im"):
    """Cell table to a complex array."""
    pdf = cells.toPandas()
    out = np.zeros((n, n), dtype=complex)
    out[pdf["y"], pdf["x"]] = pdf[re] + (1j * pdf[im] if im else 0)
    return out


def cells_of(spark, array):
    import pandas as pd
    y, x = np.divmod(np.arange(array.size), array.shape[1])
    return spark.createDataFrame(pd.DataFrame(
        {"y": y, "x": x, "re": array.real.ravel().astype(float),
         "im": array.imag.ravel().astype(float)}))


def point(u, v, w, l, m):
    return np.exp(-2j * np.pi * (u * l + v * m + w * (np.sqrt(1 - l * l - m * m) - 1)))
