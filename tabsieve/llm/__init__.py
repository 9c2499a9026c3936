"""Operators of a training-data pipeline: language ID, mixing, license scans, PII, URL filters, exact
top-k search, quality rules, near-duplicates, WARC archives and byte-level BPE.

Every operator works on a DataFrame with a general interface (column names are parameters); the thin
queries over the driver's tables live in ``tabsieve.llm.queries``.  Nothing else imports this package.
"""
