"""Readers, writers and dimension joins."""

from claimscope.sources.fixture import code_desc, npi_lookup, spending, spending_raw
from claimscope.sources.joins import add_billing_state, with_names

__all__ = ["spending", "spending_raw", "npi_lookup", "code_desc",
           "add_billing_state", "with_names"]
