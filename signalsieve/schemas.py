"""Types of the tables that cross the library's border."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = T.StructType(
    [
        T.StructField("signal_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("entity_key", T.StringType()),
        T.StructField("entity_name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_title", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("signal_date", T.DateType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_snippet", T.BooleanType()),
    ]
)

BRIEFS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("product_url", T.StringType()),
        T.StructField("promised_outcome", T.StringType()),
        T.StructField("primary_user", T.StringType()),
        T.StructField("economic_buyer", T.StringType()),
        T.StructField("job_to_be_done", T.StringType()),
        T.StructField("current_alternative", T.StringType()),
        T.StructField("adoption_trigger", T.StringType()),
        T.StructField("geography", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("target_customer", T.StringType()),
        T.StructField("disqualifiers", T.ArrayType(T.StringType())),
        T.StructField("mode", T.StringType()),
        T.StructField("as_of", T.DateType()),
        T.StructField("scope_months", T.IntegerType()),
    ]
)

ICP_TERMS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("icp_role", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("phrase", T.StringType()),
    ]
)
