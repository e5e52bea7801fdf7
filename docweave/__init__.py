"""docweave: document retrieval and chat analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or builds Columns); the heavy
lifting runs as Catalyst expressions, joins, windows and aggregates. Python
only runs inside Arrow-batched ``mapInArrow`` / ``applyInPandas`` /
``pandas_udf`` helpers where the semantics need it: the HTML event
collector, the recursive and sentence chunkers, per-row BLEU and ROUGE-L
(LCS), and numpy block kernels for exact nearest neighbours and radius
graphs.
"""

from docweave.session import get_session, reliable_checkpoint, scratch_dir, ship_package, table

__all__ = ["get_session", "reliable_checkpoint", "scratch_dir", "ship_package", "table"]
