"""casebook: composable Spark operators for end-to-end case-study analytics.

Every operator takes and returns Spark ``DataFrame``s or ``Column``s and is lazy:
no action runs inside an operator unless its docstring names a metadata pass
(a one-row aggregate or ``df.columns``) that decides the output schema.
"""

from casebook.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
