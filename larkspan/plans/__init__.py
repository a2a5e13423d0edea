"""Named queries that bind the operators to the driver's tables, with their SQL counterparts."""

from larkspan.plans import decision_queries, entity_queries, panel_queries, simulation_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (panel_queries, entity_queries, decision_queries, simulation_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
