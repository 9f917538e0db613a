"""Table shapes. Every table carries ``network_id``: one owner's contact network."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

PERSON = T.StructType(
    [
        T.StructField("network_id", T.StringType()),
        T.StructField("person_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("bio", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("is_me", T.BooleanType()),
        T.StructField("is_wishlist", T.BooleanType()),
        T.StructField("tags", _strings),
        T.StructField("skills", _strings),
        T.StructField("companies", _strings),
        T.StructField("cities", _strings),
        T.StructField("needs", _strings),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("network_id", T.StringType()),
        T.StructField("edge_id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("target_id", T.LongType()),
        T.StructField("strength", T.IntegerType()),
        T.StructField("context", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("introduced_by_id", T.LongType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("network_id", T.StringType()),
        T.StructField("person_id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

GOAL = T.StructType(
    [
        T.StructField("goal_id", T.LongType()),
        T.StructField("network_id", T.StringType()),
        T.StructField("original", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("roles", _strings),
        T.StructField("industries", _strings),
        T.StructField("skills", _strings),
        T.StructField("keywords", _strings),
        T.StructField("cities", _strings),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

# The five multi-valued attributes of a person.
ATTRIBUTES = ("tags", "skills", "companies", "cities", "needs")
