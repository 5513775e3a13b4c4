"""The registered query on runs of tasks."""

from __future__ import annotations

from tallyforge.plans.catalogue import FOUND, query
from tallyforge.sources.workspace import Workspace
from tallyforge.tasks.registry import TASKS, coverage

#: Tasks of each kind of source: events, order lines, products, ads, comments.
SHOWN = ("note_funnel", "search_efficiency_diagnosis", "channel_structure_diagnosis", "product_opportunity_matrix", "ad_data_quality_check", "comment_demand_mining")
_RESULTS = " UNION ALL ".join(f"SELECT '{t}' AS task_id, EXISTS(SELECT 1 FROM ({FOUND[r.query].sql})) AS ok" for t in SHOWN for r in TASKS[t].values())


@query("task_coverage", f"SELECT task_id, count(*) AS results, count(*) FILTER (ok) AS judgable, bool_or(ok) AS producible FROM ({_RESULTS}) GROUP BY task_id")
def _(spark, d):
    workspace = d if isinstance(d, Workspace) else Workspace(spark, d)
    return coverage(workspace, SHOWN).drop("reasons")
