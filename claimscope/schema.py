"""Schemas of the fact table and its dimensions."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Column names of the raw claims-summary CSV, in file order, and the names
# they get in the fact table.
SOURCE_COLUMNS = [
    ("BILLING_PROVIDER_NPI_NUM", "billing_npi"),
    ("SERVICING_PROVIDER_NPI_NUM", "servicing_npi"),
    ("HCPCS_CODE", "hcpcs"),
    ("CLAIM_FROM_MONTH", "month"),
    ("TOTAL_PATIENTS", "patients"),
    ("TOTAL_CLAIM_LINES", "claim_lines"),
    ("TOTAL_PAID", "paid"),
]

# Every source column is read as text and cast explicitly (ANSI: a bad value
# fails the job instead of turning into null).
SOURCE_SCHEMA = T.StructType([T.StructField(src, T.StringType()) for src, _ in SOURCE_COLUMNS])

SPENDING_RAW = T.StructType([
    T.StructField("billing_npi", T.StringType()),
    T.StructField("servicing_npi", T.StringType()),
    T.StructField("hcpcs", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("patients", T.LongType()),
    T.StructField("claim_lines", T.LongType()),
    T.StructField("paid", MONEY),
])

SPENDING = T.StructType(SPENDING_RAW.fields + [T.StructField("billing_state", T.StringType())])

NPI_LOOKUP = T.StructType([
    T.StructField("npi", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("state", T.StringType()),
])

# The eight columns of a raw-row listing, in output order.
ROW_COLUMNS = ["billing_npi", "billing_state", "servicing_npi", "hcpcs", "month",
               "patients", "claim_lines", "paid"]

MEASURES = ["paid", "patients", "claim_lines"]
