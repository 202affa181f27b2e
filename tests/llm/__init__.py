from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that operators or stages use themselves, or did once.
NAMES = "_id _h _row _kept _times _copies _copy _label _text _lang id h key row whole place bucket guest code to size taken times copies shard due removed_spans spans asked again words node band bands label component held_out lang_pred score predicted n_tokens carries rest kind seq at e said message_id".split()


def clashing(df: DataFrame) -> DataFrame:
    """df with further columns under such names, null or of a type of their own."""
    extra = [F.lit(None if i % 3 == 0 else f"x{i}").cast("string").alias(n) if i % 2 else F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in df.columns]
    return df.select("*", *extra)
