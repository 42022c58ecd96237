"""Every query of the engine, by family."""

from voxlake.plans import archive_queries, event_queries, graph_queries, interval_queries, metric_queries, model_queries, more_queries, source_queries, stream_queries, table_queries, text_queries
from voxlake.plans.registry import Registry

PLANS = Registry()
for part in (table_queries, interval_queries, metric_queries, graph_queries, text_queries, source_queries, stream_queries, more_queries, event_queries, archive_queries, model_queries):
    PLANS.queries |= part.R.queries
    PLANS.oracle |= part.R.oracle
