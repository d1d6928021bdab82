"""Tables of the news domain. `seq` is the explicit order of rows wherever the first of several wins."""

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _fields(text: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in text.split()]


NEWS = T.StructType([
    T.StructField("seq", T.LongType()),
    *_fields("title content source published_at url category name code impact_direction impact_band confidence influence_scope", _S),
    T.StructField("market_impact_score", T.DoubleType()),
    *_fields("affected_sectors affected_stocks", _A),
    T.StructField("cluster_weight", T.DoubleType()),
])
SIGNATURE = T.StructType([*_fields("stocks entities events numbers sectors", _A), *_fields("scope title_norm", _S)])
JUDGEMENT = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("push", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    *_fields("direction scope reason title", _S),
])
SEEN = T.StructType([T.StructField("fp", _S), T.StructField("t", T.TimestampType()), T.StructField("pushed", T.BooleanType()), T.StructField("title", _S)])
PENDING = T.StructType([T.StructField("fp", _S), T.StructField("t", T.TimestampType()), T.StructField("retry", T.IntegerType()), *_fields("title payload", _S)])

BANDS = ("bullish", "mildly_bullish", "neutral", "mixed", "mildly_bearish", "bearish")
SCOPES = ("market", "sector", "stock")
CONFIDENCE = ("high", "medium", "low")
