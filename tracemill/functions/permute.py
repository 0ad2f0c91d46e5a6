"""A keyed permutation of 0..n-1 as a column: the value at one place, without making the others.

A Feistel network over the digits of a number to two radices a * b >= n mixes one digit with a function of the other, in ROUNDS rounds. It
permutes 0..a*b-1, which has fewer than a numbers beyond n; a value there goes through the network again until it is below n
(cycle walking), so 0..n-1 is permuted, for any n. The values at the first m places are a draw of m without replacement.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .draws import Part

ROUNDS, PRIME = 8, 2_147_483_647


def mixed(digit: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The round function; all numbers stay below 2^62."""
    t = (digit + key * 2053 + 1) % PRIME
    t = (t * t + key) % PRIME
    return (t * 48271 + 11) % PRIME


def values(place: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The permutations' values at places below n, for keys of ROUNDS numbers a row; the walk goes on for those that are not below n yet."""
    a = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.int64)
    b = -(-n // a)
    out, todo = place.copy(), np.arange(len(place))
    while len(todo):
        left, right = np.divmod(out[todo], b[todo])
        for i in range(ROUNDS):
            if i % 2:
                right = (right + mixed(left, keys[todo, i])) % b[todo]
            else:
                left = (left + mixed(right, keys[todo, i])) % a[todo]
        out[todo] = left * b[todo] + right
        todo = todo[out[todo] >= n[todo]]
    return out


@F.pandas_udf(LongType())
def _permuted(place: pd.Series, n: pd.Series, high: pd.Series, low: pd.Series) -> pd.Series:
    shifts = np.arange(ROUNDS // 2)[::-1] * 12
    keys = np.concatenate([(k.to_numpy()[:, None] >> shifts) & 4095 for k in (high, low)], axis=1)
    return pd.Series(values(place.to_numpy(), n.to_numpy(), keys))


def permuted(place: Column, n: Column | int, *key: Part) -> Column:
    """The value at `place` (0 <= place < n < 2^53) of a permutation of 0..n-1 that the key's parts name."""
    h = F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in key)))
    digits = [F.conv(F.substring(h, at, 12), 16, 10).cast("long") for at in (1, 13)]
    return _permuted(place.cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long"), *digits)
