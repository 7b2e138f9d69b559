"""DataFrame operators.

Every operator takes ``by``: columns (account, tenant, workspace) put before its
own grouping, join and window keys.  With ``by=()`` a summary is one row for the
whole table; with keys it is one row per key.
"""
