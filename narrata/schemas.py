"""One explicit schema per table; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Posts and comments as a collector lands them: raw text, epoch seconds.
POST_LANDED = _struct(
    ("post_id", _S), ("subreddit", _S), ("author", _S), ("title", _S), ("selftext", _S),
    ("score", _I), ("num_comments", _I), ("created_utc", T.DoubleType()), ("flair", _S), ("url", _S),
    ("listing", _S), ("listing_rank", _I),
)
COMMENT_LANDED = _struct(
    ("comment_id", _S), ("post_id", _S), ("subreddit", _S), ("author", _S), ("body", _S),
    ("score", _I), ("created_utc", T.DoubleType()), ("parent_id", _S), ("comment_seq", _I),
)

POSTS = _struct(
    ("post_id", _S), ("subreddit", _S), ("author", _S), ("title", _S), ("selftext", _S),
    ("score", _I), ("num_comments", _I), ("created_utc", _TS), ("flair", _S), ("url", _S),
    ("collection_date", _TS), ("seq", _L), ("tags", T.ArrayType(_S)),
    ("top_comments", T.ArrayType(_S)), ("cluster_label", _I),
)
COMMENTS = _struct(
    ("comment_id", _S), ("post_id", _S), ("subreddit", _S), ("author", _S), ("raw_body", _S),
    ("body", _S), ("score", _I), ("created_utc", _TS), ("parent_id", _S),
    ("collection_date", _TS), ("comment_seq", _I),
)
VECTORS = _struct(("post_id", _S), ("embedding", T.ArrayType(T.FloatType())))
LABELS = _struct(("post_id", _S), ("cluster_label", _I))
