"""Who is told of a post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fanout(posts: DataFrame, mentions: DataFrame, key: str, author: str, parent: str, mentioned: str) -> DataFrame:
    """(key, recipient, kind): of each post the author of the post that it answers, by reply, and everyone that it mentions; nobody is told twice of a post (a reply goes before a mention) or of one of their own.

    mentions: (key, mentioned), a row each time. Posts without author, answers to no known post and null mentions tell nobody; an unknown post's mentions neither.
    """
    own = posts.select(key, F.col(author).alias("_by"), parent)
    above = posts.select(F.col(key).alias(parent), F.col(author).alias("recipient"))
    replies = own.join(above, parent).select(key, "_by", "recipient", F.lit(True).alias("reply"))
    named = mentions.select(key, F.col(mentioned).alias("recipient")).distinct().join(own.select(key, "_by"), key).select(key, "_by", "recipient", F.lit(False).alias("reply"))
    told = replies.unionByName(named).filter("recipient IS NOT NULL AND NOT (recipient <=> _by) AND _by IS NOT NULL")
    return told.groupBy(key, "recipient").agg(F.when(F.bool_or("reply"), "reply").otherwise("mention").alias("kind"))
