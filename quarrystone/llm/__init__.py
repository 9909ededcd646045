"""Training-data operators: filtering, deduplication, mixing, sharding, tokenising and extraction.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries,
``oracles`` the SQL that checks those which SQL can express.
"""
