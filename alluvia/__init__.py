"""Incremental warehousing and array-column analytics on Spark."""

from alluvia.functions.lists import agg_of_range, aggregate_elementwise, aggregate_list_col_elementwise, list_ext, mean_of_range, operate_scalar_on_list
from alluvia.functions.signal import apply_fft, fft_freqs, fft_freqs_linspace, interpolate_columns
from alluvia.operators.contract import SchemaError, SchemaViolation, schema
from alluvia.operators.maintenance import maintain
from alluvia.plans.pipeline import IncrementalPipeline, incremental
from alluvia.sources.arrow import make_lazy
from alluvia.sources.core import Batch, Source, from_frame, from_query
from alluvia.sources.table import VersionedTable

__all__ = [
    "Batch", "IncrementalPipeline", "SchemaError", "SchemaViolation", "Source", "VersionedTable", "agg_of_range", "aggregate_elementwise", "aggregate_list_col_elementwise", "apply_fft",
    "fft_freqs", "fft_freqs_linspace", "from_frame", "from_query", "incremental", "interpolate_columns", "list_ext", "maintain", "make_lazy", "mean_of_range", "operate_scalar_on_list", "schema",
]
