"""The named queries, one module per report page.

Every query is a function from the canonical tables (and the reader's choices,
such as a limit or a date range) to a DataFrame. Queries neither run nor cache
anything by themselves.
"""
