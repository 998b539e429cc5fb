"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

PROMPT_ITEM = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("metadata", T.StringType())])
PROMPT = T.ArrayType(PROMPT_ITEM)
#: The canonical row: a post, the turns before a target text, and who wrote it when.
INTERACTION = T.StructType(
    [
        T.StructField("prompt", PROMPT), T.StructField("completion", T.StringType()), T.StructField("post_id", T.StringType()),
        T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("metadata", T.StringType()),
    ]
)
_STRINGS = T.ArrayType(T.StringType())
DEMOGRAPHICS = ("age group", "gender", "location", "occupation", "nationality", "other")
PERSONA_LISTS = ("interests", "values", "communication", "statistics")
PERSONA = T.StructType(
    [T.StructField("demographics", T.StructType([T.StructField(x, T.StringType()) for x in DEMOGRAPHICS])), *(T.StructField(x, _STRINGS) for x in PERSONA_LISTS)]
)
EMAIL = T.ArrayType(
    T.StructType(
        [
            T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType()), T.StructField("is_forwarded", T.BooleanType()),
            T.StructField("is_reply", T.BooleanType()), T.StructField("is_original", T.BooleanType()), T.StructField("depth", T.IntegerType()), T.StructField("email_index", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
        ]
    )
)
SUBMISSION = T.StructType(
    [
        T.StructField(x, T.StringType())
        for x in (
            "timestamp worker_id user_profile persona_prompt persona_output user_response base_model_response tuned_model_response user_model_response "
            "model_order evaluation_a evaluation_b evaluation_c humanlikeness_reason overall_preference additional_feedback"
        ).split()
    ]
)
