"""Column builders: filters, sector rules and scalar expressions."""

from claimscope.functions.expressions import (measure_sums, money, paid_bucket, round2,
                                              valid_state, zero_if_null)
from claimscope.functions.filters import NO_FILTER, Filter, parse_codes
from claimscope.functions.sectors import OTHER, SECTORS, classify, code_sectors

__all__ = ["Filter", "NO_FILTER", "parse_codes", "code_sectors", "classify",
           "SECTORS", "OTHER", "paid_bucket", "money", "round2", "zero_if_null",
           "valid_state", "measure_sums"]
