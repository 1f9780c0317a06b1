"""Arrow UDFs: the few rules that built-in expressions cannot state."""

from __future__ import annotations

import ast
import difflib
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: two texts match from this sequence-matcher ratio on.
FUZZY_RATIO = 0.9


def fuzzy_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_equal(a, b, ignore_case: bool = True) -> bool:
    """Scalar rule behind :func:`fuzzy_match`; bounds on the ratio are tried first."""
    if a is None or b is None:
        return False
    a, b = str(a), str(b)
    if ignore_case:
        a, b = a.lower(), b.lower()
    if a == b:
        return True
    total = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / total < FUZZY_RATIO:
        return False
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= FUZZY_RATIO and matcher.ratio() >= FUZZY_RATIO


@F.pandas_udf(T.BooleanType())
def fuzzy_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """Case-insensitive fuzzy equality; null never matches."""
    return pd.Series([fuzzy_equal(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_call(text: pd.Series) -> pd.Series:
    """Keyword arguments of one call expression; bad syntax gives an empty map.

    A value that is no literal is null.
    """

    def one(s):
        try:
            node = ast.parse(s or "", mode="eval").body
        except (SyntaxError, ValueError):
            return {}
        if not isinstance(node, ast.Call):
            return {}
        out = {}
        for kw in node.keywords:
            if kw.arg is None:
                continue
            try:
                value = ast.literal_eval(kw.value)
            except ValueError:
                value = None
            out[kw.arg] = None if value is None else str(value)
        return out

    return text.map(one)


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """JSON text of the outermost braces: valid JSON, or a literal dict re-encoded."""
    import json

    def one(s):
        found = re.search(r"\{.*\}", s or "", re.DOTALL)
        if not found:
            return None
        body = found.group()
        try:
            return json.dumps(json.loads(body), ensure_ascii=False)
        except ValueError:
            pass
        try:
            return json.dumps(ast.literal_eval(body), ensure_ascii=False)
        except (SyntaxError, ValueError, TypeError):
            return None

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Default vectoriser: hashed bag of words, 64 buckets, unit length."""
    width = 64
    for batch in text:
        out = []
        for s in batch:
            v = np.zeros(width)
            for word in (s or "").lower().split():
                v[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % width] += 1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("float32"))
        yield pd.Series(out)


def scorer(score: Callable[[pd.DataFrame], pd.Series], schema: str):
    """``mapInPandas`` function that adds a ``score`` column with a plug-in scorer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=score(pdf))

    return run, schema + ", score double"


# Fixed value: side of the low-frequency block of a perceptual hash.
HASH_SIDE = 16


@F.pandas_udf(T.StringType())
def phash(pixels: pd.Series) -> pd.Series:
    """256-bit perceptual hash, as hex, of a square grey image given as raw bytes.

    Bytes that are no square image have no hash (null).

    The image is reduced to its low cosine frequencies and each is compared with
    their median, so small changes of single pixels change few bits.
    """

    return pd.Series([_phash(raw, math.isqrt(len(raw or b"")), None) for raw in pixels])


@F.pandas_udf(T.StringType())
def phash_image(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """:func:`phash` of a grey image of any width and height, its rows one after the other; null if the bytes are not as many."""
    return pd.Series([_phash(raw, w, h) for raw, w, h in zip(pixels, width, height)])


def _phash(raw: bytes | None, width: int, height: int | None) -> str | None:
    if raw is None or pd.isna(width) or (height is not None and pd.isna(height)):
        return None
    width, height = int(width), int(width if height is None else height)
    if width <= 0 or width * height != len(raw):
        return None
    img = np.frombuffer(raw, dtype=np.uint8).reshape(height, width).astype(float)
    basis = lambda side: np.cos(np.pi / side * (np.arange(side)[None, :] + 0.5) * np.arange(HASH_SIDE)[:, None])
    low = basis(height) @ img @ basis(width).T
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex().upper()
